"""Class balancing of a training split."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.distributed import hash_rank, lookup_join
from .neighbors import as_points, knn
from .profile import class_distribution

# Neighbours of a synthetic row and the smallest class that allows them.
SMOTE_NEIGHBORS = 5
SMOTE_ROWS = 6
_CHUNK = 10_000


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(col(label).isNotNull()).groupBy(col(label)).agg(F.count(F.lit(1)).alias("_n"))


def _repeat(df: DataFrame, copies: Column, key: str) -> DataFrame:
    """Each row ``copies`` times with ``copy`` 1.. . Large counts are spread: a row
    first yields chunks, the chunks are shuffled, then each chunk yields its rows."""
    df = df.withColumn("_copies", copies).where(F.col("_copies") > 0)
    most = df.agg(F.max("_copies")).first()[0] or 0
    if most <= _CHUNK:
        out = df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long"))))
        return out.drop("_copies")
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_copies") / _CHUNK) - 1).cast("int"))))
    chunks = chunks.repartition(col(key), F.col("_chunk"))
    first = F.col("_chunk").cast("long") * _CHUNK
    out = chunks.withColumn("copy", F.explode(F.sequence(first + 1, F.least(first + _CHUNK, F.col("_copies").cast("long")))))
    return out.drop("_copies", "_chunk")


def _extremes(df: DataFrame, label: str) -> tuple[int, int, int]:
    row = class_counts(df, label).agg(F.max("_n"), F.min("_n"), F.count(F.lit(1))).first()
    return row[0] or 0, row[1] or 0, row[2]


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class grown to the largest: all rows in full copies, then the first
    rows in hash order once more. Counts are exact."""
    most, _, _ = _extremes(df, label)
    counts = class_counts(df, label).withColumn("_size", F.col("_n"))
    ranked = lookup_join(hash_rank(df, key, seed, [label], "_rn"), counts, [label], "_n")
    copies = F.floor(F.lit(most) / F.col("_size")) + (F.col("_rn") <= F.pmod(F.lit(most), F.col("_size"))).cast("long")
    return _repeat(ranked, copies, key).drop("_rn", "_size")


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class cut to the smallest in hash order."""
    _, least, _ = _extremes(df, label)
    return hash_rank(df, key, seed, [label], "_rn").where(F.col("_rn") <= least).drop("_rn")


def smote(df: DataFrame, label: str, key: str, features: str = "features", seed: int = 42) -> DataFrame:
    """Every class grown to the largest by points between a row and one of its
    nearest rows of the class. Result: key, label, features, synthetic."""
    most, least, _ = _extremes(df, label)
    if least < SMOTE_ROWS:
        raise ValueError(f"needs at least {SMOTE_ROWS} rows in the smallest class, found {least}")
    parts = [df.select(col(key), col(label), col(features), F.lit(False).alias("synthetic"))]
    for r in class_counts(df, label).where(F.col("_n") < most).collect():
        value, n = r[0], r["_n"]
        rows = df.where(col(label) == F.lit(value))
        points = as_points(rows, key, features)
        held = points.withColumn("at", F.col("x"))
        near = knn(points, held, min(SMOTE_NEIGHBORS, n - 1), exclude_same_key=True, carry=["at"])
        # a row has at most five neighbours, so the list is bounded
        near = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "at"))).alias("near"))
        base = hash_rank(points, "key", seed, name="_rn").join(near, "key")
        need = most - n
        copies = F.floor(F.lit(need) / F.lit(n)) + (F.col("_rn") <= F.lit(need % n)).cast("long")
        many = _repeat(base, copies, "key")
        draw = lambda salt: F.pmod(F.xxhash64("key", "copy", F.lit(seed), F.lit(salt)), F.lit(1_000_003))
        pick = F.element_at("near", (F.pmod(draw("pick"), F.size("near")) + 1).cast("int"))["at"]
        gap = draw("gap") / F.lit(1_000_003.0)
        made = many.withColumns({"_other": pick, "_gap": gap})
        mixed = F.zip_with("x", "_other", lambda a, b: a + (b - a) * F.col("_gap"))
        parts.append(
            made.select(
                F.col("key").alias(key), F.lit(value).cast(df.schema[label].dataType).alias(label),
                array_to_vector(mixed).alias(features), F.lit(True).alias("synthetic"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


STRATEGIES = ("none", "oversample", "undersample", "smote")


def apply(train: DataFrame, label: str, strategy: str, key: str, seed: int = 42) -> tuple[DataFrame, dict | None]:
    """Balanced split and a report (strategy, applied, warning, distribution and ratio before)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy '{strategy}'; one of {STRATEGIES}")
    if strategy == "none":
        return train, None
    most, least, _ = _extremes(train, label)
    report = {
        "strategy": strategy, "applied": True, "warning": None,
        "distribution_before": class_distribution(train, label), "imbalance_ratio_before": most / least if least else math.inf,
    }
    if strategy == "undersample":
        return undersample(train, label, key, seed), report
    if strategy == "smote" and least < SMOTE_ROWS:
        report["warning"] = f"the smallest class has {least} rows; rows were repeated instead of synthesized"
        strategy = "oversample"
    if strategy == "oversample":
        return oversample(train, label, key, seed).drop("copy"), report
    return smote(train, label, key, seed=seed).drop("synthetic"), report


def report_frame(train: DataFrame, label: str, strategy: str) -> DataFrame:
    """The class part of the report with the rows each class gets."""
    counts = class_counts(train, label).withColumnRenamed("_n", "n")
    goal = {"oversample": F.max("n"), "smote": F.max("n"), "undersample": F.min("n")}
    if strategy not in goal:
        return counts.withColumn("n_after", F.col("n"))
    return counts.withColumn("n_after", counts.agg(goal[strategy]).scalar())
