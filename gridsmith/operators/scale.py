"""Scaling with fitted centre and width per column; a zero width counts as 1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_numeric
from ..functions.distributed import quantiles


@dataclass
class ScaleModel:
    params: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {
            c: (col(c).cast("double") - F.lit(centre)) / F.lit(width)
            for c, (centre, width) in self.params.items()
            if c in df.columns
        }
        return df.withColumns(out) if out else df


def fit(df: DataFrame, cols: list[str], method: str = "standard", allow_missing: bool = False) -> ScaleModel:
    """``standard`` uses the population deviation, ``minmax`` the range, ``robust``
    the median and quartile distance. Missing values are refused."""
    if method not in ("standard", "minmax", "robust"):
        raise ValueError(f"unknown method '{method}'")
    cols = [c for c in cols if c in df.columns and is_numeric(df.schema[c].dataType)]
    if not cols:
        return ScaleModel({})
    aggs = []
    for c in cols:
        x = col(c).cast("double")
        low, high = (F.avg(x), F.stddev_pop(x)) if method == "standard" else (F.min(x), F.max(x))
        aggs += [F.count(x), low, high]
    row = df.agg(F.count(F.lit(1)), *aggs).first()
    stats = {c: row[1 + 3 * i : 4 + 3 * i] for i, c in enumerate(cols)}
    gaps = [c for c in cols if stats[c][0] < row[0]]
    if gaps and not allow_missing:
        raise ValueError(f"columns with missing values cannot be scaled: {gaps}")
    if method == "robust":
        q = quantiles(df, cols, [0.25, 0.5, 0.75])
        pairs = {c: (q[c][1], q[c][2] - q[c][0]) for c in cols if q[c][1] is not None}
    elif method == "minmax":
        pairs = {c: (s[1], s[2] - s[1]) for c, s in stats.items() if s[1] is not None}
    else:
        pairs = {c: (s[1], s[2]) for c, s in stats.items() if s[1] is not None}
    return ScaleModel({c: (float(a), float(w) if w else 1.0) for c, (a, w) in pairs.items()})
