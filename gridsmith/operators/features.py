"""New columns from existing ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..functions.columns import col, is_datetime, parsed_timestamp, require, require_numeric
from ..functions.distributed import group_quantiles, lookup_join, quantiles

DATE_PARTS = ("year", "month", "day", "dayofweek", "is_weekend")


def datetime_features(df: DataFrame, name: str, parts: list[str] | None = None) -> DataFrame:
    """Date parts as ``<name>_<part>``; Monday is day 0, a missing date is no weekend."""
    require(df, name)
    ts = parsed_timestamp(df, name)
    if not is_datetime(df.schema[name].dataType) and df.where(ts.isNotNull()).limit(1).count() == 0:
        raise ValueError(f"column '{name}' holds no date or time")
    return df.withColumns({f"{name}_{p}": exprs.date_part(ts, p) for p in (parts or DATE_PARTS)})


# Names of the generated interaction columns.
_INTERACTIONS = {"multiply": "x", "divide": "div", "add": "plus", "subtract": "minus"}


def interaction_expr(a: str, b: str, operation: str) -> Column:
    x, y = col(a).cast("double"), col(b).cast("double")
    if operation == "multiply":
        return x * y
    if operation == "divide":
        return exprs.ratio(x, y)
    if operation == "divide_smooth":
        return exprs.smooth_ratio(x, y)
    if operation == "add":
        return x + y
    if operation == "subtract":
        return x - y
    raise ValueError(f"unknown operation '{operation}'")


def interaction(df: DataFrame, a: str, b: str, operation: str = "multiply", name: str | None = None) -> DataFrame:
    """Product, quotient (NULL for a zero denominator), sum or difference."""
    require_numeric(df, a, b)
    e = interaction_expr(a, b, operation)
    return df.withColumn(name or f"{a}_{_INTERACTIONS.get(operation, 'd')}_{b}", e)


def named_interaction(df: DataFrame, a: str, b: str, operation: str, name: str | None = None) -> DataFrame:
    """As ``interaction`` with the smoothed quotient a / (b + 1e-5) and a free name,
    by default the operation's first letter between the columns."""
    operation = "divide_smooth" if operation == "divide" else operation
    return interaction(df, a, b, operation, name or f"{a}_{operation[0]}_{b}")


@dataclass
class BinModel:
    """Fitted bin edges; codes are right-closed and the first bin holds the minimum."""

    column: str
    edges: list[float]
    output: str
    labels: bool = False

    def code(self) -> Column:
        return exprs.bin_code(col(self.column), self.edges)

    def transform(self, df: DataFrame) -> DataFrame:
        code = self.code()
        return df.withColumn(self.output, exprs.bin_label(code, self.edges) if self.labels else code)


def bins(df: DataFrame, name: str, num_bins: int = 4, strategy: str = "quantile", labels: bool = False, output: str | None = None) -> BinModel:
    require_numeric(df, name)
    output = output or f"{name}_binned"
    if strategy == "quantile":
        q = quantiles(df, [name], [i / num_bins for i in range(num_bins + 1)])[name]
        edges = sorted({float(v) for v in q if v is not None})
        return BinModel(name, edges, output, labels)
    if strategy == "uniform":
        low, high = df.agg(F.min(col(name).cast("double")), F.max(col(name).cast("double"))).first()
        return BinModel(name, uniform_edges(low, high, num_bins), output, labels)
    raise ValueError(f"unknown strategy '{strategy}'; quantile or uniform")


def uniform_edges(low: float | None, high: float | None, num_bins: int) -> list[float]:
    """Equal-width edges with the first lowered by 0.1 % of the range; a constant
    gets edges 0.1 % around it."""
    if low is None:
        return []
    if low == high:
        gap = 0.001 * abs(low) if low else 0.001
        low, high = low - gap, high + gap
        return [low + (high - low) * i / num_bins for i in range(num_bins + 1)]
    step = (high - low) / num_bins
    return [low - (high - low) * 0.001, *[low + step * i for i in range(1, num_bins)], high]


@dataclass
class ShiftModel:
    """log1p or sqrt after subtracting a fitted negative minimum."""

    column: str
    method: str
    minimum: float | None

    def transform(self, df: DataFrame) -> DataFrame:
        x = exprs.shifted(col(self.column), self.minimum)
        # a new batch may go below the fitted minimum: outside the domain is NULL
        safe = F.when(x >= 0, x) if self.method == "sqrt" else F.when(x > -1, x)
        out = F.sqrt(safe) if self.method == "sqrt" else F.log1p(safe)
        return df.withColumn(f"{self.column}_{self.method}", out)


def log_transform(df: DataFrame, name: str, method: str = "log1p") -> ShiftModel:
    require_numeric(df, name)
    if method not in ("log1p", "sqrt"):
        raise ValueError(f"unknown method '{method}'; log1p or sqrt")
    return ShiftModel(name, method, df.agg(F.min(col(name).cast("double"))).first()[0])


def transform_column(df: DataFrame, name: str, kind: str, output: str | None = None) -> DataFrame:
    """Clipped log1p or sqrt, square, smoothed reciprocal, or sample z-score."""
    require_numeric(df, name)
    x = col(name).cast("double")
    if kind == "log1p":
        e = exprs.log_clipped(x)
    elif kind == "sqrt":
        e = F.sqrt(exprs.clip(x, 0.0, None))
    elif kind == "square":
        e = x * x
    elif kind == "reciprocal":
        e = F.try_divide(F.lit(1.0), x + F.lit(1e-5))
    elif kind == "zscore":
        mean, std = df.agg(F.avg(x), F.stddev_samp(x)).first()
        e = (x - F.lit(mean)) / F.lit(std if std else 1.0)
    else:
        raise ValueError(f"unknown transformation '{kind}'")
    return df.withColumn(output or f"{name}_transformed", e)


AGGREGATES = ("mean", "std", "sum", "count", "median", "max", "min")


def aggregate_expr(value: Column, how: str) -> Column:
    """Aggregate column for every function but the median, which needs a sort."""
    table = {
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "sum": F.sum(value),
        "count": F.count(value),
        "max": F.max(value),
        "min": F.min(value),
    }
    if how not in table:
        raise ValueError(f"unknown aggregation '{how}'; one of {AGGREGATES}")
    return table[how]


def grouped(df: DataFrame, keys: list[str], value: str, funcs: list[str]) -> DataFrame:
    """keys..., _n (rows), and one column _<function> each. NULL keys are a group."""
    x = col(value).cast("double")
    out = df.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_n"), *[aggregate_expr(x, f).alias(f"_{f}") for f in funcs if f != "median"]
    )
    if "median" not in funcs:
        return out
    med = group_quantiles(df, keys, value, [0.5])
    med = med.select(*[col(k).alias(f"_m_{k}") for k in keys], F.col("q")[0].alias("_median"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & col(k).eqNullSafe(col(f"_m_{k}"))
    return out.join(med, cond, "left").select(*[col(k) for k in keys], "_n", *[f"_{f}" for f in funcs])


@dataclass
class GroupModel:
    """Fitted aggregates per group, looked up by row; no group or an unseen one is NULL."""

    group: str
    target: str
    funcs: list[str]
    table: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        names = {f: f"{self.target}_by_{self.group}_{f}" for f in self.funcs}
        side = self.table.select(col(self.group), F.col("_n"), *[F.col(f"_{f}").alias(n) for f, n in names.items()])
        return lookup_join(df.drop(*names.values()), side, [self.group], "_n")


def group_features(df: DataFrame, group: str, target: str, funcs: list[str] | None = None) -> GroupModel:
    """Aggregates of ``target`` by ``group`` as columns of every row of the group.

    The groups are aggregated first and looked up, so a group holding a large
    share of the rows is never gathered in one task.
    """
    require(df, group)
    require_numeric(df, target)
    funcs = list(funcs or ["mean", "std"])
    return GroupModel(group, target, funcs, grouped(df.where(col(group).isNotNull()), [group], target, funcs))


def text_stats(df: DataFrame, name: str) -> DataFrame:
    """Characters and whitespace-separated words of a text column."""
    require(df, name)
    return df.withColumns(
        {f"{name}_len": exprs.text_length(col(name)), f"{name}_word_count": exprs.word_count(col(name))}
    )
