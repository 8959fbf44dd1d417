"""Column and table profiles. Each returns a small frame computed by aggregates
over the whole table; fitted scalars are one value per column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import IDENTIFIER_ENDINGS, categorical_columns, col, is_numeric, numeric_columns
from ..functions.distributed import quantiles, top_value, value_counts
from ..functions.exprs import adjusted_skew
from ..session import broadcast_if_small, materialize

FENCE = 1.5
COLUMNS_PER_PASS = 6


def _spread(agg: DataFrame, cols: list[str], fields: list[str], name: str = "column") -> DataFrame:
    """One aggregate row with fields named <i>_<field> to one row per column."""
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias(name), *[F.col(f"{i}_{f}").alias(f) for f in fields])
        for i, c in enumerate(cols)
    ]
    return agg.select(F.inline(F.array(*cells)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


# Bytes of a fixed-width cell; text counts its own bytes.
_WIDTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def data_size(df: DataFrame) -> DataFrame:
    """Estimated size of the values in bytes and MB, in one aggregate."""
    fixed, text = 0, []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            text.append(F.coalesce(F.sum(F.octet_length(col(f.name)).cast("long")), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType):
            wide = _WIDTHS.get(f.dataType.elementType.simpleString(), 8)
            text.append(F.coalesce(F.sum((F.size(col(f.name)) * wide).cast("long")), F.lit(0)))
        else:
            fixed += _WIDTHS.get(f.dataType.simpleString(), 8)
    total = F.count(F.lit(1)) * F.lit(fixed)
    for t in text:
        total = total + t
    return df.agg(total.cast("long").alias("bytes")).withColumn("size_mb", F.col("bytes") / (1024.0 * 1024.0))


def missing(df: DataFrame) -> DataFrame:
    """Missing cells per column, most first."""
    cols = df.columns
    agg = df.agg(
        *[F.count(col(c)).alias(f"{i}_present") for i, c in enumerate(cols)], F.count(F.lit(1)).alias("_rows")
    )
    agg = agg.withColumns({f"{i}_total": F.col("_rows") for i in range(len(cols))})
    long = _spread(agg, cols, ["present", "total"])
    count = F.col("total") - F.col("present")
    return long.select(
        "position",
        "column",
        count.alias("missing"),
        F.coalesce(F.try_divide(count * 100.0, F.col("total")), F.lit(0.0)).alias("missing_pct"),
    ).orderBy(F.desc("missing_pct"), "position")


def missing_cells(df: DataFrame) -> DataFrame:
    return missing(df).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"))


def missing_table(df: DataFrame) -> DataFrame:
    """Only the columns with gaps, with their types, in table order."""
    types = [F.lit(t) for f in df.schema.fields for t in (f.name, f.dataType.simpleString())]
    return (
        missing(df)
        .where(F.col("missing") > 0)
        .select("position", "column", "missing", "missing_pct", F.create_map(*types)[F.col("column")].alias("dtype"))
        .orderBy("position")
    )


def top_missing(df: DataFrame, rows: int = 10) -> DataFrame:
    gaps = missing(df).where(F.col("missing") > 0)
    return gaps.orderBy(F.desc("missing_pct"), "position").limit(rows)


def type_counts(df: DataFrame) -> DataFrame:
    rows = [("Numeric Features", len(numeric_columns(df))), ("Categorical Features", len(categorical_columns(df)))]
    return df.sparkSession.createDataFrame(rows, "type string, count long")


def repeated_digests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` with a 128-bit digest of each row (``_d0``, ``_d1``), and the digests that
    occur more than once, written. Only rows with such a digest can have an equal."""
    names = [col(c) for c in df.columns]
    marked = df.select(*names, *[F.xxhash64(F.lit(i), *names).alias(f"_d{i}") for i in range(2)])
    seen = marked.groupBy("_d0", "_d1").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d0", "_d1")
    return marked, materialize(seen)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows. Digests are counted first; whole
    rows are compared only where a digest repeats."""
    marked, seen = repeated_digests(df)
    again = marked.join(broadcast_if_small(seen), ["_d0", "_d1"], "left_semi")
    groups = again.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def cardinality(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column: exact by a two-level count, or by sketch."""
    cols = cols or df.columns
    if approximate:
        agg = df.agg(*[F.approx_count_distinct(col(c)).alias(f"{i}_distinct") for i, c in enumerate(cols)])
        return _spread(agg, cols, ["distinct"])
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    counted = value_counts(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("_d"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counted, "column", "left").select(
        order[F.col("column")].alias("position"), "column", F.coalesce("_d", F.lit(0)).alias("distinct")
    )


def distinct_counts(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> dict[str, int]:
    return {r["column"]: r["distinct"] for r in cardinality(df, cols, approximate).collect()}


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one value when missing counts as a value.

    Needs only the extremes and the counts, so no distinct count is made.
    """
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(F.struct(c))
        aggs += [F.count(c).alias(f"n{i}"), F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"s{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    return [f.name for i, f in enumerate(df.schema.fields) if row[f"s{i}"] and row[f"n{i}"] in (0, row["n"])]


def named_like_identifier(name: Column) -> Column:
    """Literal rule on the column name; it also matches words such as 'paid'."""
    low = F.lower(name)
    out = F.lit(False)
    for ending in IDENTIFIER_ENDINGS:
        out = out | low.endswith(ending)
    return out


def column_flags(df: DataFrame) -> DataFrame:
    """Cardinality of every column with the constant, identifier and
    high-cardinality rules applied."""
    kinds = F.create_map(
        *[x for f in df.schema.fields for x in (F.lit(f.name), F.lit("numeric" if is_numeric(f.dataType) else "categorical"))]
    )
    gaps = missing(df)
    rows = df.agg(F.count(F.lit(1))).scalar()
    wide = cardinality(df).join(gaps.drop("position"), "column").withColumns(
        {"kind": kinds[F.col("column")], "rows": rows}
    )
    with_missing = F.col("distinct") + (F.col("missing") > 0).cast("long")
    n = F.col("rows")
    return wide.select(
        "position", "column", "kind", "rows", "missing", "missing_pct", "distinct",
        (with_missing <= 1).alias("is_constant"),
        (
            named_like_identifier(F.col("column"))
            | ((F.col("distinct") >= F.greatest(n * 0.95, F.lit(1.0))) & (n > 10))
        ).alias("is_identifier"),
        (
            (F.col("kind") == "categorical") & (F.col("distinct") > F.greatest(F.lit(20.0), n * 0.05))
        ).alias("is_high_cardinality"),
    )


def skewness(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Adjusted skewness of each numeric column that has more than two values."""
    cols = cols or numeric_columns(df)
    agg = df.agg(*[adjusted_skew(col(c)).alias(f"{i}_skew") for i, c in enumerate(cols)])
    return _spread(agg, cols, ["skew"]).where(F.col("skew").isNotNull())


@dataclass
class Fences:
    """Quartiles and outlier limits of numeric columns."""

    quartiles: dict[str, tuple] = field(default_factory=dict)

    def limits(self, name: str, factor: float = FENCE) -> tuple[float, float] | None:
        q1, q3 = self.quartiles[name]
        if q1 is None or q3 - q1 < 0:
            return None
        return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def fit_fences(df: DataFrame, cols: list[str]) -> Fences:
    return Fences({c: tuple(q) for c, q in quantiles(df, cols, [0.25, 0.75]).items()})


def outlier_count(name: str, fences: Fences) -> Column:
    limits = fences.limits(name)
    if limits is None:
        return F.lit(0).cast("long")
    c = col(name).cast("double")
    return F.coalesce(F.sum(((c < F.lit(limits[0])) | (c > F.lit(limits[1]))).cast("long")), F.lit(0))


def outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Values strictly outside the quartile fences; columns with none are left out."""
    cols = cols or numeric_columns(df)
    fences = fit_fences(df, cols)
    live = [c for c in cols if fences.quartiles[c][0] is not None and fences.quartiles[c][1] > fences.quartiles[c][0]]
    if not live:
        return df.sparkSession.createDataFrame([], "position int, column string, outliers long")
    agg = df.agg(
        *[F.when(F.count(col(c)) > 2, outlier_count(c, fences)).alias(f"{i}_outliers") for i, c in enumerate(live)]
    )
    return _spread(agg, live, ["outliers"]).where(F.col("outliers") > 0)


def numeric_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column: count, missing, mean, median, spread, skew, outliers.

    Two passes: quartiles, then moments and outlier counts. A few columns share an
    aggregate, so that it stays in generated code; each reads only its columns.
    """
    cols = cols or numeric_columns(df)
    qs = quantiles(df, cols, [0.25, 0.5, 0.75])
    out = None
    for start in range(0, len(cols), COLUMNS_PER_PASS):
        part = _summary(df, cols[start : start + COLUMNS_PER_PASS], qs).withColumn("position", F.col("position") + start)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the table has no numeric column")
    return out


def _summary(df: DataFrame, cols: list[str], qs: dict[str, list]) -> DataFrame:
    fences = Fences({c: (qs[c][0], qs[c][2]) for c in cols})
    fields = ["count", "missing", "mean", "median", "std", "min", "max", "iqr", "skew", "outliers"]
    aggs = []
    for i, name in enumerate(cols):
        c = col(name).cast("double")
        q1, q2, q3 = qs[name]
        n = F.count(c)
        parts = {
            "count": n,
            "missing": F.count(F.lit(1)) - n,
            "mean": F.avg(c),
            "median": F.lit(q2).cast("double"),
            "std": F.when(n > 1, F.stddev_samp(c)).when(n == 1, F.lit(0.0)),
            "min": F.min(c),
            "max": F.max(c),
            "iqr": F.lit(None if q1 is None else q3 - q1).cast("double"),
            "skew": F.coalesce(adjusted_skew(c), F.when(n > 0, F.lit(0.0))),
            "outliers": outlier_count(name, fences),
        }
        aggs += [e.alias(f"{i}_{k}") for k, e in parts.items()]
    return _spread(df.agg(*aggs), cols, fields)


def categorical_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per categorical column: count, missing, unique, top value and its share."""
    cols = cols or categorical_columns(df)
    tops = (
        value_counts(df, cols)
        .groupBy("column")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), top_value().alias("t"))
    )
    top_n = -F.col("t.neg")
    return (
        missing(df.select(*[col(c) for c in cols]))
        .join(tops, "column", "left")
        .select(
            "position", "column",
            F.coalesce("count", F.lit(0)).alias("count"),
            "missing",
            F.coalesce("unique", F.lit(0)).alias("unique"),
            F.col("t.value").alias("top"),
            F.coalesce(top_n, F.lit(0)).alias("top_freq"),
            F.try_divide(top_n * 100.0, F.col("count")).alias("top_pct"),
        )
    )


def input_domain(df: DataFrame, cols: list[str], values: int = 50) -> DataFrame:
    """Allowed input per feature: numeric range and median (a constant's range is
    widened by 1), or the first values in order."""
    numeric = [c for c in cols if is_numeric(df.schema[c].dataType)]
    other = [c for c in cols if c not in numeric]
    parts = []
    if numeric:
        med = {c: q[0] for c, q in quantiles(df, numeric, [0.5]).items()}
        aggs = []
        for i, name in enumerate(numeric):
            c = col(name).cast("double")
            low, high = F.coalesce(F.min(c), F.lit(0.0)), F.coalesce(F.max(c), F.lit(100.0))
            aggs += [
                low.alias(f"{i}_min"),
                F.when(high <= low, low + 1.0).otherwise(high).alias(f"{i}_max"),
                F.lit(med[name] if med[name] is not None else 0.0).alias(f"{i}_default"),
            ]
        parts.append(
            _spread(df.agg(*aggs), numeric, ["min", "max", "default"])
            .drop("position")
            .withColumn("values", F.lit(None).cast("array<string>"))
        )
    for name in other:
        # per column: the distinct values are ordered and cut before they are gathered
        first = df.select(col(name).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(values)
        parts.append(
            first.agg(F.sort_array(F.collect_list("v")).alias("values")).select(
                F.lit(name).alias("column"),
                *[F.lit(None).cast("double").alias(x) for x in ("min", "max", "default")],
                F.when(F.size("values") == 0, F.array(F.lit("Unknown"))).otherwise(F.col("values")).alias("values"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def health(df: DataFrame) -> DataFrame:
    """Headline numbers of a table in one row."""
    return shape(df).select(
        "rows",
        "columns",
        data_size(df).select("size_mb").scalar().alias("size_mb"),
        duplicate_rows(df).scalar().alias("duplicates"),
        missing_cells(df).scalar().alias("missing_cells"),
        outliers(df).agg(F.count(F.lit(1))).scalar().alias("outlier_columns"),
    )


def detect_task(df: DataFrame, target: str) -> DataFrame:
    """Classification or regression, by type and distinct values of the target."""
    c = col(target)
    counted = df.groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("v").alias("distinct")
    )
    if not is_numeric(df.schema[target].dataType):
        task = F.lit("Classification")
    else:
        few = (F.col("distinct") <= 20) & (F.col("distinct") / F.greatest("rows", F.lit(1)) < 0.05)
        task = F.when(few, "Classification").otherwise("Regression")
    return counted.select(F.lit(target).alias("target"), "rows", "distinct", task.alias("task"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share of each class of a target, most first."""
    counts = (
        df.where(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = counts.agg(F.sum("count")).scalar()
    return counts.select(
        "class", "count", F.round(F.col("count") * 100.0 / total, 2).alias("percent")
    ).orderBy(F.desc("count"), "class")


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Largest-to-smallest ratio, minority share and the two alerts."""
    d = df.where(col(target).isNotNull()).groupBy(col(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    one = d.agg(
        F.count(F.lit(1)).alias("classes"),
        F.try_divide(F.max("n").cast("double"), F.min("n").cast("double")).alias("ratio"),
        F.try_divide(F.min("n") * 100.0, F.sum("n").cast("double")).alias("minority_pct"),
    )
    return one.withColumns(
        {
            "minority_alert": (F.col("minority_pct") < 20.0) & (F.col("classes") > 1),
            "ratio_alert": F.col("ratio") >= 3.0,
        }
    )


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Share of each column value within a row value, in percent; long form."""
    pairs = (
        df.where(col(row).isNotNull() & col(column).isNotNull())
        .groupBy(col(row).alias("row"), col(column).alias("column"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    totals = pairs.groupBy("row").agg(F.sum("count").alias("_total"))
    return pairs.join(totals, "row").select(
        "row", "column", "count", (F.col("count") * 100.0 / F.col("_total")).alias("percent")
    )
