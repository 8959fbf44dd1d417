"""Building blocks that stay exact and spread when a group or value is huge.

Each has a one-pass form for inputs whose size was checked, and a distributed
form with the same result beyond ``LIMITS.single_task_rows``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import LIMITS, broadcast_if_small, materialize, table_bytes
from .columns import col
from .exprs import order_hash


def melt(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Long form of numeric columns: keep..., column, value (double)."""
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("value")) for c in cols]
    return df.select(*[col(k) for k in keep], F.inline(F.array(*cells)))


def value_counts(df: DataFrame, cols: list[str], nulls: bool = False) -> DataFrame:
    """Rows per distinct value of each column; missing is a value only with ``nulls``.

    Columns: column, value (text), num (numeric value or NULL), n. Partial counts
    are combined before the shuffle, so a value held by many rows costs one entry
    a task.
    """
    def cell(name: str) -> Column:
        kind = df.schema[name].dataType
        typed = {"l": "long", "d": "double", "s": "string"}
        own = "l" if isinstance(kind, T.IntegralType) else "d" if isinstance(kind, T.FractionalType) else "s"
        own = "s" if isinstance(kind, T.DecimalType) else own
        parts = [(col(name) if k == own else F.lit(None)).cast(t).alias(k) for k, t in typed.items()]
        return F.struct(F.lit(name).alias("column"), *parts)

    # values are grouped in their own type; only the distinct ones become text
    long = df.select(F.inline(F.array(*[cell(c) for c in cols])))
    if not nulls:
        long = long.where("l is not null or d is not null or s is not null")
    counts = long.groupBy("column", "l", "d", "s").agg(F.count(F.lit(1)).alias("n"))
    decimals = [c for c in cols if isinstance(df.schema[c].dataType, T.DecimalType)]
    num = F.coalesce(F.col("l").cast("double"), "d", F.when(F.col("column").isin(decimals), F.col("s").try_cast("double")))
    text = F.coalesce(F.col("l").cast("string"), F.col("d").cast("string"), "s")
    return counts.select("column", text.alias("value"), num.alias("num"), "n")


def top_value() -> Column:
    """Aggregate over ``value_counts`` rows: most frequent value, ties to the smallest."""
    return F.min(F.struct((-F.col("n")).alias("neg"), F.col("num"), F.col("value")))


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Left join of ``df`` with a table holding one row per key.

    A table measured as small is broadcast. Otherwise the few keys that hold more
    than 1/``hot_share`` of all rows (at most that many keys exist) are broadcast
    and the rest is joined by shuffle; rows already answered, and rows with a NULL
    key, are spread over all tasks by a salt. ``weight`` is the table's row count
    per key; it is not part of the result.
    """
    table = materialize(table)
    values = [c for c in table.columns if c not in keys and c != weight]
    if table_bytes(table) <= LIMITS.broadcast_bytes:
        joined = df.join(F.broadcast(table.drop(weight)), keys, "left")
        return joined.select(*[col(c) for c in df.columns], *[col(v) for v in values])
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.where(F.col(weight) * LIMITS.hot_share > F.lit(total))
    hot_side = F.broadcast(
        hot.select(
            *[col(k).alias(f"_hk_{k}") for k in keys],
            *[col(v).alias(f"_hv_{v}") for v in values],
            F.lit(True).alias("_hot"),
        )
    )
    match = _all([col(k) == col(f"_hk_{k}") for k in keys])
    step = df.join(hot_side, match, "left")
    open_key = F.col("_hot").isNull() & _all([col(k).isNotNull() for k in keys])
    spread = F.monotonically_increasing_id() % 4096  # by row: equal rows are spread as well
    step = step.withColumns(
        {f"_ck_{k}": F.when(open_key, col(k)) for k in keys} | {"_salt": F.when(open_key, F.lit(0)).otherwise(spread)}
    )
    cold_side = table.join(F.broadcast(hot.select(*[col(k) for k in keys])), keys, "left_anti").select(
        *[col(k).alias(f"_tk_{k}") for k in keys],
        *[col(v).alias(f"_cv_{v}") for v in values],
        F.lit(0).cast("long").alias("_tsalt"),
    )
    cond = _all([col(f"_ck_{k}") == col(f"_tk_{k}") for k in keys] + [F.col("_salt") == F.col("_tsalt")])
    joined = step.join(cold_side, cond, "left")
    return joined.select(
        *[col(c) for c in df.columns],
        *[F.coalesce(col(f"_hv_{v}"), col(f"_cv_{v}")).alias(v) for v in values],
    )


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list]:
    """Exact linear-interpolation quantiles of each column as driver scalars."""
    if not cols:
        return {}
    rows = df.count()
    if rows <= LIMITS.single_task_rows:
        # sorted arrays of a counted number of cells, far cheaper than percentile()
        width, out = max(1, _ARRAY_CELLS // max(rows, 1)), {}
        for start in range(0, len(cols), min(width, 16)):
            some = cols[start : start + min(width, 16)]
            arrays = df.agg(*[F.sort_array(F.collect_list(col(c).cast("double"))).alias(f"a{i}") for i, c in enumerate(some)])
            row = arrays.select(*[F.array(*[_at(F.col(f"a{i}"), p) for p in probs]) for i in range(len(some))]).first()
            out |= dict(zip(some, row))
        return out
    found = _refined_quantiles(melt(df, cols), ["column"], probs).collect()
    out = {c: [None] * len(probs) for c in cols}
    for r in found:
        out[r["column"]] = list(r["q"])
    return out


_ARRAY_CELLS = 4_000_000


def _at(ordered: Column, p: float) -> Column:
    """Linear interpolation in a sorted array; NULL for an empty one."""
    spot = F.lit(float(p)) * (F.size(ordered) - 1)
    low, high = (F.get(ordered, f(spot).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (spot - F.floor(spot))


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles of ``value`` per group: keys..., q (array). NULL keys are a group."""
    long = df.select(*[col(k) for k in keys], col(value).cast("double").alias("value"))
    if df.count() <= LIMITS.single_task_rows:
        return long.groupBy(*keys).agg(F.percentile("value", probs).alias("q"))
    return _refined_quantiles(long, keys, probs)


_GRID = 200


def _refined_quantiles(long: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Narrow a value bracket around each wanted rank with bounded sketches, then
    count the distinct values that remain in it.

    A pass cuts the bracket to about 3/200 of its rows. Ranks are exact because
    rows below the bracket are counted, not estimated.
    """
    given, keys = keys, [f"_g{i}" for i in range(len(keys))]
    rows = long.where(F.col("value").isNotNull()).select(*[col(c).alias(k) for c, k in zip(given, keys)], "value")
    grid = [i / _GRID for i in range(_GRID + 1)]
    sketch = F.percentile_approx("value", grid, F.lit(10_000)).alias("g")

    def bracket(state: DataFrame) -> DataFrame:
        spot = lambda rank: (rank - F.col("below")) / F.col("inside") * _GRID
        low = F.greatest(F.floor(spot(F.floor("k"))).cast("int") - 1, F.lit(0))
        high = F.least(F.ceil(spot(F.ceil("k") + 1)).cast("int") + 1, F.lit(_GRID))
        return state.withColumns({"lo": F.col("g")[low], "hi": F.col("g")[high]}).drop("g", "inside", "below")

    first = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("inside"), sketch)
    first = first.withColumns({"p": F.explode(F.array(*[F.lit(float(p)) for p in probs])), "below": F.lit(0)})
    first = first.withColumn("k", F.col("p") * (F.col("inside") - 1))
    state = materialize(bracket(first))
    while True:
        named = state.select(*[col(k).alias(f"_s_{k}") for k in keys], "p", "k", "lo", "hi")
        cond = _all([col(k).eqNullSafe(col(f"_s_{k}")) for k in keys])
        near = rows.join(broadcast_if_small(named), cond).where(F.col("value") <= F.col("hi"))
        in_bracket = F.when(F.col("value") >= F.col("lo"), F.col("value"))
        tally = materialize(
            near.groupBy(*[col(k) for k in keys], "p", "k", "lo", "hi", in_bracket.alias("v")).agg(
                F.count(F.lit(1)).alias("c")
            )
        )
        widest = tally.groupBy(*keys, "p").count().agg(F.max("count")).first()[0] or 0
        if widest <= LIMITS.single_task_rows:
            break
        # the sketch needs the rows, not the counts: it has no weights
        inner = near.where(F.col("value") >= F.col("lo")).groupBy(*keys, "p", "k").agg(
            F.count(F.lit(1)).alias("inside"), sketch
        )
        under = tally.groupBy(*keys, "p").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"))
        under = under.select(*[col(k).alias(f"_u_{k}") for k in keys], F.col("p").alias("_u_p"), "below")
        cond = _all([col(k).eqNullSafe(col(f"_u_{k}")) for k in keys] + [F.col("p") == F.col("_u_p")])
        state = materialize(bracket(inner.join(under, cond)).select(*keys, "p", "k", "lo", "hi"))
    order = Window.partitionBy(*keys, "p").orderBy(F.col("v").asc_nulls_first())
    ranked = tally.withColumn("upto", F.sum("c").over(order))
    pick = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    one = ranked.groupBy(*keys, "p", "k").agg(pick(F.floor("k")).alias("a"), pick(F.ceil("k")).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("k") - F.floor("k"))
    place = F.create_map(*[x for i, p in enumerate(probs) for x in (F.lit(float(p)), F.lit(i))])[F.col("p")]
    listed = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(place.alias("i"), value.alias("v")))).alias("s"))
    return listed.select(*[col(k).alias(c) for c, k in zip(given, keys)], F.col("s.v").alias("q"))


def running_totals(
    df: DataFrame, group: list[str], order: str, amounts: list[str], rows: int, descending: bool = False
) -> DataFrame:
    """Adds ``cum_<amount>``: the running total in the order of ``order`` per group.

    ``df`` holds one row per (group, order value); ``rows`` bounds its size. Beyond
    the limit the rows are range-partitioned, totalled per range, and each range is
    summed on its own with the total of the ranges before it.
    """
    direction = col(order).desc() if descending else col(order).asc()
    if rows <= LIMITS.single_task_rows:
        w = Window.partitionBy(*group).orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"cum_{a}": F.sum(a).over(w) for a in amounts})
    parts = max(2, math.ceil(rows / max(LIMITS.single_task_rows // 4, 1)))
    cut = df.repartitionByRange(parts, *[col(g) for g in group], direction).withColumn("_part", F.spark_partition_id())
    cut = materialize(cut)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*group, "_part").agg(*[F.sum(a).alias(f"_t_{a}") for a in amounts])
    base = base.select(
        *[col(g).alias(f"_b_{g}") for g in group],
        F.col("_part").alias("_bpart"),
        *[F.coalesce(F.sum(f"_t_{a}").over(before), F.lit(0)).alias(f"_o_{a}") for a in amounts],
    )
    base = broadcast_if_small(materialize(base))
    inside = Window.partitionBy(*group, "_part").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    cond = _all([col(g).eqNullSafe(col(f"_b_{g}")) for g in group] + [F.col("_part") == F.col("_bpart")])
    joined = cut.withColumns({f"_c_{a}": F.sum(a).over(inside) for a in amounts}).join(base, cond)
    return joined.select(
        *[col(c) for c in df.columns],
        *[(F.col(f"_c_{a}") + F.col(f"_o_{a}")).alias(f"cum_{a}") for a in amounts],
    )


def hash_rank(df: DataFrame, key: str, seed: int, strata: list[str] = (), name: str = "rn") -> DataFrame:
    """Adds the 1-based rank of each row in hash order, per stratum.

    ``key`` identifies a row. Beyond the limit, rows are cut by the leading hex
    digits of the hash; a rank is the count of earlier cuts plus the rank inside
    the cut, so a stratum of any size is ranked by many tasks.
    """
    strata = list(strata)
    n = df.count()
    h = order_hash(col(key), seed)
    if n <= LIMITS.single_task_rows:
        w = Window.partitionBy(*[col(s) for s in strata]).orderBy(h, col(key))
        return df.withColumn(name, F.row_number().over(w))
    digits = max(1, math.ceil(math.log(n / max(LIMITS.single_task_rows // 8, 1), 16)))
    cut = df.withColumns({"_h": h, "_cut": F.substring(h, 1, digits)})
    counts = cut.groupBy(*strata, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        *[col(s).alias(f"_b_{s}") for s in strata],
        F.col("_cut").alias("_bcut"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
    )
    base = broadcast_if_small(materialize(base))
    cond = _all([col(s).eqNullSafe(col(f"_b_{s}")) for s in strata] + [F.col("_cut") == F.col("_bcut")])
    w = Window.partitionBy(*[col(s) for s in strata], "_cut").orderBy("_h", col(key))
    ranked = cut.withColumn("_r", F.row_number().over(w)).join(base, cond)
    return ranked.select(*[col(c) for c in df.columns], (F.col("_r") + F.col("_base")).alias(name))


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows in hash order of the key: a sampling operator."""
    return df.orderBy(order_hash(col(key), seed), col(key)).limit(rows)
