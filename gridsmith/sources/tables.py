"""Reading and writing tables, and the two demonstration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.exprs import no_nan

# Cell texts read as missing, as pandas' CSV reader does.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

GRAMMAR = {
    "bigint": r"^\s*[+-]?\d+\s*$",
    "double": r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$",
    "boolean": r"^(TRUE|True|true|FALSE|False|false)$",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line. Types are inferred only when no schema is given;
    every missing text becomes NULL.

    Files are split between tasks unless a quoted cell holds a line break: one pass
    over the lines finds those by their odd number of quotes, and then each file is
    read by one task.
    """
    lines = spark.read.text(path).select(F.regexp_count("value", F.lit('"')).alias("n"))
    broken = not lines.where("n % 2 = 1").isEmpty()
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", broken)
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
        raw = blank_to_null(reader.schema(text).csv(path))
        return raw.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    raw = blank_to_null(reader.csv(path))
    return _infer(raw)


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~col(c).isin(*MISSING_TEXTS), col(c)).alias(c) for c in df.columns])


def _infer(raw: DataFrame) -> DataFrame:
    """Narrowest of bigint, double, boolean, string that keeps every value: one aggregate.

    A value has to look like its type (``GRAMMAR``): Spark's casts also take texts such
    as yes or 1d, which stay text here.
    """
    kinds = tuple(GRAMMAR)
    fits = lambda c, k: col(c).rlike(GRAMMAR[k]) & col(c).try_cast(k).isNotNull()
    checks = [
        F.sum((col(c).isNotNull() & ~fits(c, k)).cast("long")).alias(f"{i}_{k}")
        for i, c in enumerate(raw.columns)
        for k in kinds
    ] + [F.count(col(c)).alias(f"{i}_n") for i, c in enumerate(raw.columns)]
    row = raw.agg(*checks).first().asDict()
    out = []
    for i, c in enumerate(raw.columns):
        kind = next((k for k in kinds if row[f"{i}_n"] and row[f"{i}_{k}"] == 0), "string")
        out.append(col(c).try_cast(kind).alias(c))
    return raw.select(*out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns become NULL; other columns unchanged."""
    floats = (T.FloatType, T.DoubleType)
    return df.select(
        *[
            (no_nan(col(f.name)).cast(f.dataType).alias(f.name) if isinstance(f.dataType, floats) else col(f.name))
            for f in df.schema.fields
        ]
    )


def preview(df: DataFrame, key: str | list[str], rows: int = 5) -> DataFrame:
    """First rows in the order of an explicit key."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*[col(k) for k in keys]).limit(rows)


# Fixed values of the two demonstration tables: column names, value lists, ranges, shares
# and the rows with gaps or copies.


def _draw(salt: str) -> Column:
    """Reproducible number in [0, 1) from the row id."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _whole(salt: str, low: int, high: int) -> Column:
    return (F.floor(_draw(salt) * (high - low)) + low).cast("int")


def _pick(salt: str, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(_draw(salt) * len(values)) + 1).cast("int"))


def sample_housing(spark: SparkSession, rows: int = 300) -> DataFrame:
    """Regression demonstration table with gaps and four repeated rows."""
    base = spark.range(rows).select(
        "id",
        F.format_string("H_%04d", "id").alias("House_ID"),
        F.when(~F.col("id").between(10, 15), _whole("sqft", 600, 4500).cast("double")).alias("Square_Feet"),
        _whole("bed", 1, 6).alias("Bedrooms"),
        _pick("bath", [1.0, 1.5, 2.0, 2.5, 3.0, 3.5]).alias("Bathrooms"),
        _whole("age", 0, 50).alias("Age_Years"),
        F.when(
            ~F.col("id").between(25, 28), _pick("area", ["Downtown", "Suburbs", "Uptown", "Waterfront"])
        ).alias("Neighborhood"),
        _whole("price", 120_000, 850_000).alias("Price"),
    )
    return base.unionByName(base.where("id < 4")).drop("id")


def sample_churn(spark: SparkSession, rows: int = 300) -> DataFrame:
    """Classification demonstration table (75 % No) with gaps and three repeated rows."""
    base = spark.range(rows).select(
        "id",
        F.format_string("C_%04d", "id").alias("Customer_ID"),
        _whole("tenure", 1, 72).alias("Tenure_Months"),
        F.round(F.lit(20.0) + _draw("month") * 100.0, 2).alias("Monthly_Charges"),
        F.when(~F.col("id").between(5, 9), F.round(F.lit(100.0) + _draw("total") * 7900.0, 2)).alias("Total_Charges"),
        _pick("contract", ["Month-to-Month", "One Year", "Two Year"]).alias("Contract_Type"),
        _pick("pay", ["Electronic Check", "Mailed Check", "Credit Card", "Bank Transfer"]).alias("Payment_Method"),
        F.when(_draw("churn") < 0.75, "No").otherwise("Yes").alias("Churn"),
    )
    return base.unionByName(base.where("id < 3")).drop("id")
