"""Helpers the text operators share."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: A key with more than one in so many rows is answered by a broadcast; at most that many keys exist.
HOT_SHARE = 1_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir`` for files of this application."""
    return f"{checkpoint_dir(spark).rstrip('/')}/gridsmith/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def whole(text: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def residue(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def spread_join(rows: DataFrame, labels: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``rows`` with ``labels``, a written table of one row per text ``key``.

    ``weight`` is the number of rows a key has. Keys above 1/``HOT_SHARE`` of all rows
    (so at most ``HOT_SHARE`` of them) are answered by a broadcast, the others by a
    shuffle in which answered rows and rows without a key are dealt evenly. ``weight``
    stays in the result.
    """
    values = [c for c in labels.columns if c != key]
    total = labels.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = labels.where(is_hot).select(F.col(key).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    cold = labels.where(~is_hot).select(F.col(key).alias("_cold_key"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    even = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    out = out.withColumn("_route", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(even))
    out = out.join(cold, F.col("_route") == F.col("_cold_key"), "left")
    found = [F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v) for v in values]
    return out.select(*[F.col(c) for c in rows.columns], *found)


class Shelf:
    """Tables that one operator writes and deletes itself: those it drops early, and all
    others when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame) -> DataFrame:
        """``df``, written once and read from the files."""
        path = scratch(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path, _ = self.paths.pop(id(table))
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[table for _, table in list(self.paths.values())])
