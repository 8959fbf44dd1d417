"""Reproducible splits, folds and samples in hash order of an explicit key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.distributed import hash_rank, hash_sample, lookup_join, running_totals
from ..session import materialize
from .clean import drop_missing


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return drop_missing(df, [target])


def can_stratify(df: DataFrame, target: str) -> bool:
    """More than one class and at least two rows in each."""
    counts = df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).first()
    return row["classes"] > 1 and row["least"] >= 2


def test_quotas(df: DataFrame, stratify: str, test_size: float) -> DataFrame:
    """Test rows per class that add up to ceil(n * test_size): whole parts, then the
    largest remainders. One row per class."""
    counts = df.groupBy(col(stratify)).agg(F.count(F.lit(1)).alias("_n"))
    total, classes = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    total = total or 0
    wanted = math.ceil(total * test_size)
    exact = F.col("_n") * F.lit(wanted) / F.lit(max(total, 1))
    base = counts.withColumn("_whole", F.floor(exact)).withColumn("_part", exact - F.floor(exact))
    left = F.lit(wanted) - base.agg(F.sum("_whole")).scalar()
    base = base.withColumns({"_order": F.struct(-F.col("_part"), col(stratify)), "_one": F.lit(1)})
    placed = running_totals(base, [], "_order", ["_one"], classes)
    return placed.select(col(stratify), "_n", (F.col("_whole") + (F.col("cum__one") <= left).cast("long")).alias("_quota"))


def assign(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Adds ``split`` ('train' or 'test'). ``key`` identifies a row."""
    if stratify is None:
        wanted = math.ceil(df.count() * test_size)
        ranked = hash_rank(df, key, seed, name="_rn")
        return ranked.withColumn("split", F.when(F.col("_rn") <= wanted, "test").otherwise("train")).drop("_rn")
    quotas = test_quotas(df, stratify, test_size)
    ranked = lookup_join(hash_rank(df, key, seed, [stratify], name="_rn"), quotas, [stratify], "_n")
    part = F.when(F.col("_rn") <= F.col("_quota"), "test").otherwise("train")
    return ranked.withColumn("split", part).drop("_rn", "_quota")


def train_test(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    rows = materialize(assign(df, key, test_size, seed, stratify))
    return tuple(rows.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Adds ``fold`` 0..k-1, dealt in hash order; when stratified class after class, each
    from where the one before it ended, so folds differ by one row at most and no fold
    is empty that a row is there for."""
    if k < 2:
        raise ValueError("needs at least 2 folds")
    ranked = hash_rank(df, key, seed, [stratify] if stratify else [], name="_rn")
    place = F.col("_rn") - 1
    if stratify:
        counts = materialize(df.groupBy(col(stratify)).agg(F.count(F.lit(1)).alias("_n")))
        one = counts.select(col(stratify), "_n", F.struct(col(stratify).isNotNull(), col(stratify)).alias("_order"))
        upto = running_totals(one, [], "_order", ["_n"], counts.count())
        begins = upto.select(col(stratify), "_n", (F.col("cum__n") - F.col("_n")).alias("_begin"))
        ranked = lookup_join(ranked, begins, [stratify], "_n")
        place = place + F.coalesce(F.col("_begin"), F.lit(0))  # rows without a class come first
    return ranked.withColumn("fold", F.pmod(place, F.lit(k)).cast("int")).drop("_rn", "_begin")


def evaluation_sample(df: DataFrame, target: str, key: str, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows with a target, in hash order."""
    return hash_sample(drop_missing_target(df, target), key, rows, seed)
