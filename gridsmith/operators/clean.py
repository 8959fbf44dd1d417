"""Cleaning steps. A step's ``fit`` reads statistics of the whole table as one
scalar per column; the fitted step is a row-local projection, so it also runs on
new batches and on streams."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs
from ..functions.columns import col, is_numeric, parsed_timestamp, require_numeric
from ..functions.distributed import quantiles, top_value, value_counts
from ..session import broadcast_if_small
from . import profile


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops the named columns; absent names are ignored."""
    return df.drop(*names)


def select_active(df: DataFrame, names: list[str] | None) -> DataFrame:
    """The chosen columns that still exist, in the chosen order; all when none are chosen."""
    return df if names is None else df.select(*[col(n) for n in names if n in df.columns])


def between(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    return df.where(col(name).between(low, high))


def member(df: DataFrame, name: str, values: list) -> DataFrame:
    """Rows whose value is in the list; an empty list keeps all rows."""
    return df.where(col(name).isin(list(values))) if values else df


def first_values(df: DataFrame, name: str, rows: int = 10) -> list:
    """Default selection of a category filter: the first distinct values in order."""
    return [r[0] for r in df.select(col(name)).where(col(name).isNotNull()).distinct().orderBy(col(name)).limit(rows).collect()]


def drop_missing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.na.drop(subset=names)


CASTS = ("numeric", "datetime", "category", "string")


def cast_expr(df: DataFrame, name: str, kind: str) -> Column:
    c = col(name)
    if kind == "numeric":
        if isinstance(df.schema[name].dataType, T.BooleanType):
            return c.cast("int").cast("double")
        return exprs.no_nan(c.cast("string").try_cast("double"))
    if kind == "datetime":
        return parsed_timestamp(df, name)
    if kind in ("category", "string"):
        return c.cast("string")
    raise ValueError(f"unknown type '{kind}'; one of {CASTS}")


def cast_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Cast one column; values that do not convert become NULL."""
    if name not in df.columns:
        return df
    return df.withColumn(name, cast_expr(df, name, kind))


def cast_loss(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Values that a cast would turn into NULL, per column, in one aggregate."""
    cols = list(kinds)
    agg = df.agg(
        *[
            F.coalesce(F.sum((col(c).isNotNull() & cast_expr(df, c, kinds[c]).isNull()).cast("long")), F.lit(0)).alias(f"{i}_lost")
            for i, c in enumerate(cols)
        ]
    )
    return profile._spread(agg, cols, ["lost"])


@dataclass
class Filler:
    """Fitted replacement value per column. Columns in ``as_text`` become text first,
    when a text constant fills a column of another type."""

    values: dict[str, object]
    as_text: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for name, value in self.values.items():
            if name not in df.columns or value is None:
                continue
            kind = df.schema[name].dataType
            if name in self.as_text:
                out[name] = F.coalesce(col(name).cast("string"), F.lit(value))
            elif isinstance(kind, T.IntegralType) and float(value) != math.floor(float(value)):
                out[name] = F.coalesce(col(name).cast("double"), F.lit(float(value)))
            else:
                out[name] = F.coalesce(col(name), F.lit(value).cast(kind))
        return df.withColumns(out) if out else df


@dataclass
class Imputer:
    """Fill missing values: median, mean, mode, constant, drop_rows, or auto
    (median for numbers, mode otherwise, 'Unknown' when there is no value)."""

    strategy: str
    cols: list[str] | None = None
    fill_value: object = None

    def fit(self, df: DataFrame):
        cols = [c for c in (self.cols or df.columns) if c in df.columns]
        numeric = [c for c in cols if is_numeric(df.schema[c].dataType)]
        other = [c for c in cols if c not in numeric]
        if self.strategy == "auto":
            return Filler({**_medians(df, numeric), **_modes(df, other)})
        if self.strategy == "median":
            require_numeric(df, *cols)
            return Filler(_medians(df, cols))
        if self.strategy == "mean":
            require_numeric(df, *cols)
            row = df.agg(*[F.avg(col(c).cast("double")) for c in cols]).first()
            return Filler(dict(zip(cols, row)))
        if self.strategy == "mode":
            return Filler(_modes(df, cols))
        if self.strategy == "constant":
            value = "Missing" if self.fill_value is None else self.fill_value
            texts = tuple(c for c in other if not isinstance(df.schema[c].dataType, T.StringType))
            return Filler({c: (_number(value, c) if c in numeric else str(value)) for c in cols}, texts)
        if self.strategy == "drop_rows":
            return RowDropper(cols)
        raise ValueError(f"unknown strategy '{self.strategy}'")


@dataclass
class RowDropper:
    cols: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return drop_missing(df, self.cols)


def _number(value: object, name: str) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise ValueError(f"'{value}' is not a number for numeric column '{name}'") from None


def _medians(df: DataFrame, cols: list[str]) -> dict:
    return {c: q[0] for c, q in quantiles(df, cols, [0.5]).items()}


def _modes(df: DataFrame, cols: list[str]) -> dict:
    if not cols:
        return {}
    tops = value_counts(df, cols).groupBy("column").agg(top_value().alias("t")).collect()
    found = {r["column"]: r["t"]["value"] for r in tops}
    out = {}
    for c in cols:
        if c in found:
            out[c] = found[c]  # as text; the filler casts it to the column's type
        elif isinstance(df.schema[c].dataType, T.StringType):
            out[c] = "Unknown"
    return out


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row distinct; which copy is kept does not matter. Rows whose digest occurs once
    stay where they are, only the others are compared as a whole."""
    marked, seen = profile.repeated_digests(df)
    small = broadcast_if_small(seen)
    names = [col(c) for c in df.columns]
    once = marked.join(small, ["_d0", "_d1"], "left_anti").select(*names)
    return once.unionByName(marked.join(small, ["_d0", "_d1"], "left_semi").select(*names).dropDuplicates())


def drop_constant_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    names = profile.constant_columns(df)
    return df.drop(*names), names


@dataclass
class Clipper:
    """Fitted lower and upper limits per column."""

    limits: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        live = {c: v for c, v in self.limits.items() if c in df.columns}
        return df.withColumns({c: exprs.clip(col(c), *v) for c, v in live.items()}) if live else df

    def changed(self, df: DataFrame, cols: list[str]) -> DataFrame:
        """Applied/skipped report: rows changed per requested column, one aggregate."""
        aggs = []
        for i, c in enumerate(cols):
            hit = F.lit(False)
            if c in self.limits:
                low, high = self.limits[c]
                hit = (col(c) < F.lit(low)) | (col(c) > F.lit(high))
            aggs.append(F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias(f"{i}_changed"))
        out = profile._spread(df.agg(*aggs), cols, ["changed"])
        return out.withColumn("status", F.when(F.col("changed") > 0, "applied").otherwise("skipped"))


@dataclass
class OutlierCap:
    """Cap numeric columns by quartile fences (``iqr``) or mean and deviation (``zscore``)."""

    cols: list[str]
    method: str = "iqr"
    factor: float | None = None

    def fit(self, df: DataFrame) -> Clipper:
        cols = [c for c in self.cols if c in df.columns and is_numeric(df.schema[c].dataType)]
        if not cols:
            return Clipper({})
        if self.method == "iqr":
            factor = 1.5 if self.factor is None else self.factor
            counts = df.agg(*[F.count(col(c)) for c in cols]).first()
            fences = profile.fit_fences(df, cols)
            enough = [c for i, c in enumerate(cols) if counts[i] >= 4]
            return Clipper({c: fences.limits(c, factor) for c in enough})
        if self.method == "zscore":
            t = 3.0 if self.factor is None else self.factor
            row = df.agg(*[e for c in cols for e in (F.avg(col(c).cast("double")), F.stddev_samp(col(c).cast("double")))]).first()
            limits = {}
            for i, c in enumerate(cols):
                mean, std = row[2 * i], row[2 * i + 1]
                if std is not None and std == std and std != 0:
                    limits[c] = (mean - t * std, mean + t * std)
            return Clipper(limits)
        raise ValueError(f"unknown method '{self.method}'")


def apply_log1p(df: DataFrame, name: str) -> DataFrame:
    """In place log(1 + x) with negatives taken as 0; other types are left alone."""
    if name not in df.columns or not is_numeric(df.schema[name].dataType):
        return df
    return df.withColumn(name, exprs.log_clipped(col(name)))


def auto_clean(df: DataFrame) -> DataFrame:
    """Impute every column, drop repeated rows, then drop constant columns."""
    filled = Imputer("auto").fit(df).transform(df)
    return drop_constant_columns(remove_duplicates(filled))[0]
