"""The query behind each chart: a small frame, aggregated or sampled on the cluster.

Color and facet columns are extra group keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, is_numeric, numeric_columns, require, require_numeric
from ..functions.distributed import group_quantiles, hash_rank, hash_sample, lookup_join, melt, running_totals, value_counts
from ..functions.exprs import order_hash
from ..session import materialize
from ..sources.tables import preview
from . import encode, features, profile, relate

# Default bins and categories.
BINS = 35
TOP = 25
DASHBOARD_TOP = 15
# Columns up to which a pivot is made wide.
PIVOT_COLUMNS = 200
# Largest rank filter that Spark applies before the shuffle.
GROUP_LIMIT = 1_000


def _keys(*names: str | None) -> list[str]:
    return list(dict.fromkeys(n for n in names if n))


def _same(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out


def histogram(df: DataFrame, x: str, bins: int = BINS, color: str | None = None, facet: str | None = None, density: bool = False) -> DataFrame:
    """Counts of equal-width bins over the range of ``x``, empty bins included."""
    require_numeric(df, x)
    keys = _keys(color, facet)
    v = col(x).cast("double")
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        fields = "".join(f"`{k}` string, " for k in keys)
        return df.sparkSession.createDataFrame([], f"{fields}bin int, left double, right double, count long")
    width = (high - low) / bins or 1.0
    code = F.least(F.floor((v - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.where(v.isNotNull()).groupBy(*[col(k) for k in keys], code.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    groups = counts.groupBy(*[col(k) for k in keys]).agg(F.sum("count").alias("total"))
    spine = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counts = counts.select(*[col(k).alias(f"_k_{k}") for k in keys], F.col("bin").alias("_bin"), "count")
    cond = _same([col(k) for k in keys], [col(f"_k_{k}") for k in keys]) & (F.col("bin") == F.col("_bin"))
    full = spine.join(counts, cond, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    left = F.lit(low) + F.col("bin") * F.lit(width)
    out = [*[col(k) for k in keys], F.col("bin"), left.alias("left"), (left + F.lit(width)).alias("right"), F.col("count")]
    if density:
        out.append((F.col("count") / (F.col("total") * F.lit(width))).alias("density"))
    return full.select(*out)


def density(df: DataFrame, x: str, bins: int = BINS, color: str | None = None, facet: str | None = None) -> DataFrame:
    return histogram(df, x, bins, color, facet, density=True)


def _quartiles(df: DataFrame, y: str, keys: list[str]) -> DataFrame:
    """keys..., _n, q1, median, q3, low_fence, high_fence."""
    q = group_quantiles(df, keys, y, [0.25, 0.5, 0.75])
    n = df.groupBy(*[col(k).alias(f"_n_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    both = q.join(n, _same([col(k) for k in keys], [col(f"_n_{k}") for k in keys]))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    return both.select(
        *[col(k) for k in keys], "_n", q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
        (q1 - 1.5 * (q3 - q1)).alias("low_fence"), (q3 + 1.5 * (q3 - q1)).alias("high_fence"),
    )


def _with_fences(df: DataFrame, y: str, x: str | None, color: str | None, facet: str | None) -> tuple[DataFrame, list[str]]:
    require_numeric(df, y)
    keys = _keys(x, color, facet)
    rows = df.where(col(y).isNotNull())
    for k in keys:
        rows = rows.where(col(k).isNotNull())
    rows = rows.select(*[col(k) for k in keys], col(y).cast("double").alias("_y"))
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit("all")), ["_all"]
    return lookup_join(rows, _quartiles(rows, "_y", keys), keys, "_n"), keys


def box(df: DataFrame, y: str, x: str | None = None, color: str | None = None, facet: str | None = None) -> DataFrame:
    """Quartiles, fences, whisker ends and outlier count per group."""
    rows, keys = _with_fences(df, y, x, color, facet)
    v = F.col("_y")
    inside = (v >= F.col("low_fence")) & (v <= F.col("high_fence"))
    stats = ["q1", "median", "q3", "low_fence", "high_fence"]
    out = rows.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("count"),
        *[F.first(s).alias(s) for s in stats],
        F.min(F.when(inside, v)).alias("low_whisker"),
        F.max(F.when(inside, v)).alias("high_whisker"),
        F.sum((~inside).cast("long")).alias("outliers"),
    )
    return out.drop("_all")


def box_outliers(df: DataFrame, y: str, x: str | None = None, color: str | None = None, facet: str | None = None) -> DataFrame:
    """The points drawn beyond the fences."""
    rows, keys = _with_fences(df, y, x, color, facet)
    v = F.col("_y")
    out = rows.where((v < F.col("low_fence")) | (v > F.col("high_fence")))
    return out.select(*[col(k) for k in keys if k != "_all"], v.alias("value"))


def violin(df: DataFrame, y: str, x: str | None = None, bins: int = BINS, color: str | None = None, facet: str | None = None) -> DataFrame:
    """Density bins with quartiles, of the whole table or of each group, color and facet;
    rows without one of them are left out."""
    keys = _keys(x, color, facet)
    rows = df.where(col(y).isNotNull())
    for k in keys:
        rows = rows.where(col(k).isNotNull())
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit("all")), ["_all"]
    group = keys[0] if len(keys) == 1 else "_group"
    if len(keys) > 1:
        rows = rows.withColumn("_group", F.struct(*[col(k) for k in keys]))
    q = _quartiles(rows.select(col(group), col(y).cast("double").alias("_y")), "_y", [group])
    out = density(rows, y, bins, color=group).join(q.select(col(group), "q1", "median", "q3"), group)
    if len(keys) > 1:
        return out.select(*[F.col("_group")[k].alias(k) for k in keys], *[c for c in out.columns if c != "_group"])
    return out.drop("_all")


def bar(df: DataFrame, x: str, y: str | None = None, agg: str = "mean", color: str | None = None, top_n: int = TOP, by_value: bool = False) -> DataFrame:
    """Count or aggregate by category; missing is a category.

    With a color every pair is given. Counts keep the largest categories; an
    aggregate keeps the first keys, or the largest values with ``by_value``.
    """
    keys = _keys(x, color)
    if y is None:
        out = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))
        return out if color else out.orderBy(F.desc("count"), col(x).asc_nulls_last()).limit(top_n)
    out = features.grouped(df, keys, y, [agg]).select(*[col(k) for k in keys], F.col(f"_{agg}").alias("value"))
    if color:
        return out
    order = [F.desc_nulls_last("value"), col(x).asc_nulls_last()] if by_value else [col(x).asc_nulls_last()]
    return out.orderBy(*order).limit(top_n)


def share(df: DataFrame, x: str, top_n: int = TOP) -> DataFrame:
    """Largest categories with their part of the shown total."""
    shown = bar(df, x, top_n=top_n)
    return shown.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def trend(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Least-squares line per color group over every complete row."""
    require_numeric(df, x, y)
    rows = df.where(col(x).isNotNull() & col(y).isNotNull())
    a, b = col(x).cast("double"), col(y).cast("double")
    varies = F.min(a) < F.max(a)
    return rows.groupBy(*[col(k) for k in _keys(color)]).agg(
        F.count(F.lit(1)).alias("count"),
        F.when(varies, F.regr_slope(b, a)).alias("slope"),
        F.when(varies, F.regr_intercept(b, a)).alias("intercept"),
        F.when(varies & (F.min(b) < F.max(b)), F.regr_r2(b, a)).alias("r2"),
    )


def points(df: DataFrame, cols: list[str], key: str, limit: int | None = None, seed: int = 42, complete: bool = True, extra: list[str] = ()) -> DataFrame:
    """Rows of a scatter: complete over ``cols``, in a hash sample of at most ``limit``."""
    require(df, *cols, key)
    rows = df.na.drop(subset=list(cols)) if complete else df
    rows = rows.select(*[col(c) for c in _keys(key, *cols, *extra)])
    return rows if limit is None else hash_sample(rows, key, limit, seed)


def strip(df: DataFrame, y: str, key: str, x: str | None = None, per_group: int | None = None, seed: int = 42, color: str | None = None) -> DataFrame:
    """Points by group: all rows, or a hash sample of at most ``per_group`` each."""
    rows = df.select(*[col(c) for c in _keys(key, x, y, color)])
    if per_group is None:
        return rows
    if per_group > GROUP_LIMIT:
        return hash_rank(rows, key, seed, _keys(x), "_rn").where(F.col("_rn") <= per_group).drop("_rn")
    # a map task passes on at most per_group rows of a group
    w = Window.partitionBy(*[col(k) for k in _keys(x)]).orderBy(order_hash(col(key), seed), col(key))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_group).drop("_rn")


def parallel_coordinates(df: DataFrame, cols: list[str], key: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Complete rows over ``cols``, all or a hash sample of at most ``limit``."""
    if len(cols) < 2:
        raise ValueError("needs at least two columns")
    return points(df, cols, key, limit, seed)


def scatter_matrix(df: DataFrame, cols: list[str], key: str, limit: int | None = None, seed: int = 42, color: str | None = None) -> DataFrame:
    """Complete rows over ``cols``, all or a hash sample of at most ``limit``."""
    if len(cols) < 2:
        raise ValueError("needs at least two columns")
    return points(df, cols, key, limit, seed, extra=_keys(color))


def series(df: DataFrame, x: str, y: str, color: str | None = None, buckets: int | None = None) -> DataFrame:
    """Line or area: rows in the order of a numeric x, or means of x buckets."""
    keys = _keys(color)
    if buckets is None:
        rows = df.select(*[col(k) for k in _keys(x, y, color)])
        return rows.orderBy(col(x)) if is_numeric(df.schema[x].dataType) else rows
    require_numeric(df, x, y)
    v = col(x).cast("double")
    low, high = df.agg(F.min(v), F.max(v)).first()
    width = ((high - low) / buckets or 1.0) if low is not None else 1.0
    code = F.least(F.floor((v - F.lit(low or 0.0)) / F.lit(width)).cast("int"), F.lit(buckets - 1))
    return (
        df.where(v.isNotNull())
        .groupBy(*[col(k) for k in keys], code.alias("bucket"))
        .agg(F.min(v).alias("x_from"), F.max(v).alias("x_to"), F.avg(col(y).cast("double")).alias("y"), F.count(col(y)).alias("count"))
    )


corr = relate.corr


def pivot(df: DataFrame, row: str, column: str, value: str, agg: str = "mean", form: str = "wide") -> DataFrame:
    """Aggregate by row and column value: a ``wide`` table with empty cells 0, of at most
    ``PIVOT_COLUMNS`` columns, or the filled cells of any number in ``long`` form."""
    if form not in ("wide", "long"):
        raise ValueError(f"unknown form '{form}'")
    cells = features.grouped(df.where(col(row).isNotNull() & col(column).isNotNull()), [row, column], value, [agg])
    cells = cells.where(F.col(f"_{agg}").isNotNull()).select(
        col(row).alias("row"), col(column).cast("string").alias("column"), F.col(f"_{agg}").cast("double").alias("value")
    )
    if form == "long":
        return cells
    if profile.distinct_counts(df, [column])[column] > PIVOT_COLUMNS:
        raise ValueError(f"more than {PIVOT_COLUMNS} columns: use form='long'")
    names = encode.levels(cells, "column")
    return cells.groupBy("row").pivot("column", names).agg(F.first("value")).na.fill(0.0)


def hierarchy(df: DataFrame, path: list[str], value: str | None = None) -> DataFrame:
    """Totals at every level of the path, the grand total included. ``level`` is the
    number of path columns that are set."""
    if not path:
        raise ValueError("needs at least one level")
    total = F.count(F.lit(1)) if value is None else F.sum(col(value).cast("double"))
    gid = F.grouping_id()
    level = F.lit(len(path)) - F.bit_count(gid)
    return df.rollup(*[col(p) for p in path]).agg(level.cast("int").alias("level"), total.alias("value"))


def ecdf(df: DataFrame, x: str, color: str | None = None) -> DataFrame:
    """Share of rows at or below each distinct value, per color group."""
    require_numeric(df, x)
    keys = _keys(color)
    rows = df.where(col(x).isNotNull())
    counts = rows.groupBy(*[col(k) for k in keys], col(x).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts)
    upto = running_totals(counts, keys, "value", ["n"], counts.count())
    totals = counts.groupBy(*[col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("n").alias("_total"))
    if not keys:
        return upto.select("value", "n", (F.col("cum_n") / totals.scalar()).alias("share"))
    both = upto.join(totals, _same([col(k) for k in keys], [col(f"_t_{k}") for k in keys]))
    return both.select(*[col(k) for k in keys], "value", "n", (F.col("cum_n") / F.col("_total")).alias("share"))


def missing_matrix(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """0/1 missing flags of all rows, or of the first ``limit`` by key."""
    first = df if limit is None else preview(df, key, limit)
    return first.select(col(key).alias("_key"), *[col(c).isNull().cast("int").alias(c) for c in df.columns if c != key])


def top_categories(df: DataFrame, cols: list[str], top_n: int = DASHBOARD_TOP) -> DataFrame:
    """Largest categories of each column with their percent of all rows."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.col("value").asc_nulls_last())
    counts = value_counts(df, cols, nulls=True).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return counts.select("column", "value", F.col("n").alias("count"), "rank", (F.col("n") * 100.0 / rows).alias("percent"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and percent of all rows per class; missing is a class."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    out = df.groupBy(col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("percent", F.col("count") * 100.0 / rows).orderBy(F.desc("count"), "class")


def missing_bar(df: DataFrame) -> DataFrame:
    return profile.missing_table(df).select("column", "missing", "missing_pct").orderBy("missing_pct", "column")


def cardinality_bar(df: DataFrame) -> DataFrame:
    return profile.cardinality(df).select("column", "distinct").orderBy("distinct", "column")


def feature_by_class(df: DataFrame, feature: str, target: str, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Box and overlaid histogram of a numeric feature per target class."""
    return box(df, feature, x=target), histogram(df, feature, bins, color=target)


def prediction_distribution(scored: DataFrame, prediction: str = "Prediction", bins: int = BINS) -> DataFrame:
    """Histogram of numeric predictions, counts of class predictions."""
    if is_numeric(scored.schema[prediction].dataType):
        return histogram(scored, prediction, bins)
    return scored.groupBy(col(prediction)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col(prediction))


def outlier_overview(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Box summary of every numeric column side by side."""
    return box(melt(df, cols or numeric_columns(df)).where(F.col("value").isNotNull()), "value", x="column")
