"""Session settings, size limits and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Limits:
    """Sizes up to which the one-task or broadcast form of an operator is used.

    Every operator that has such a form checks the size first and has an exact
    distributed form beyond it.
    """

    single_task_rows: int = 2_000_000
    broadcast_bytes: int = 32 * 1024 * 1024
    hot_share: int = 1_000
    spread_rows: int = 50_000


LIMITS = Limits()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridsmith")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRIDSMITH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gridsmith-"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dirs: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="gridsmith-")
    return _local_dirs[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so later uses share the work and the
    plan starts at the written files."""
    spark = df.sparkSession
    path = f"{_app_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``materialize`` for rows that many passes read: from ``spread_rows`` rows on they are
    dealt over all cores by ``key``, as a few bytes a row would leave them to a few tasks."""
    written = materialize(df)
    if written.count() < LIMITS.spread_rows:
        return written
    return materialize(written.repartition(df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(F.col(f"`{key}`"))))


def _app_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/gridsmith/{spark.sparkContext.applicationId}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete the tables this application wrote; call when no result reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    folder.getFileSystem(conf).delete(folder, True)


def table_bytes(df: DataFrame) -> int:
    """Upper estimate of the size of ``df``: 16 bytes a field plus its text."""
    text = [
        F.coalesce(F.sum(F.octet_length(F.col(f"`{f.name}`").cast("string")).cast("long")), F.lit(0))
        for f in df.schema.fields
        if f.dataType.simpleString() not in ("vector",)
    ]
    row = df.agg(F.count(F.lit(1)), *text).first()
    return row[0] * 16 * len(df.columns) + sum(row[1:])


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint only after measuring that the table is within the limit."""
    return F.broadcast(df) if table_bytes(df) <= LIMITS.broadcast_bytes else df
