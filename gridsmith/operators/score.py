"""Batch scoring of new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .mlprep import missing_features
from .train import ModelBundle


def supervised(bundle: ModelBundle, df: DataFrame, key: str | None = None) -> DataFrame:
    """Input columns plus ``Prediction``; absent features are an error."""
    return bundle.score(df, key)


def unsupervised(bundle, df: DataFrame, key: str | None = None) -> DataFrame:
    """Input columns plus ``Cluster``, or ``Anomaly_Label`` and ``Anomaly_Score``.
    Density clusters need the ``key`` that names a row."""
    return bundle.score(df, key)


def check_columns(df: DataFrame, features: list[str]) -> list[str]:
    return missing_features(df, features)


def peers(assigned: DataFrame, cluster: str, key: str, rows: int = 10, label: str = "Cluster") -> DataFrame:
    """Training rows of the same cluster, first by key."""
    return assigned.where(col(label) == F.lit(str(cluster))).orderBy(col(key)).limit(rows)
