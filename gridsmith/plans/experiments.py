"""Experiment history as an append-only table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "experiment string, target string, task string, model string, metric string, value double"


def record(leaderboard: DataFrame, path: str, experiment: str, target: str, task: str) -> None:
    """Append one leaderboard in long form."""
    to_long(leaderboard, experiment, target, task).write.mode("append").parquet(path)


def to_long(leaderboard: DataFrame, experiment: str, target: str, task: str) -> DataFrame:
    name, *scores = leaderboard.columns
    cells = [F.struct(F.lit(s).alias("metric"), F.col(f"`{s}`").cast("double").alias("value")) for s in scores]
    return leaderboard.select(
        F.lit(experiment).alias("experiment"), F.lit(target).alias("target"), F.lit(task).alias("task"),
        F.col(f"`{name}`").alias("model"), F.inline(F.array(*cells)),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def compare(history: DataFrame, metric: str) -> DataFrame:
    """Models ranked by a metric within each target, best first. A target has a few
    models an experiment."""
    w = Window.partitionBy("target").orderBy(F.desc_nulls_last("value"), "experiment", "model")
    return history.where(F.col("metric") == metric).withColumn("rank", F.row_number().over(w))
