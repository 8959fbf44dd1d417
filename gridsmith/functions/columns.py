"""Column classes and name rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name endings that mark an identifier, words that mark a date column.
IDENTIFIER_ENDINGS = ("id", "_id", "code", "index")
DATE_WORDS = ("date", "time", "dt", "timestamp", "created", "updated", "dob")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Every column that is not numeric; booleans count as categorical."""
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def column_kinds(df: DataFrame) -> DataFrame:
    """One row per column: name, Spark type and numeric/categorical class."""
    rows = [
        (i, f.name, f.dataType.simpleString(), "numeric" if is_numeric(f.dataType) else "categorical")
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, kind string")


def date_named(name: str) -> bool:
    return any(word in name.lower() for word in DATE_WORDS)


def date_candidates(df: DataFrame) -> list[str]:
    """Columns offered for date parts: named like a date or of a date type, else all."""
    found = [
        f.name
        for f in df.schema.fields
        if "date" in f.name.lower() or "time" in f.name.lower() or is_datetime(f.dataType)
    ]
    return found or df.columns


def require(df: DataFrame, *names: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}")


def require_numeric(df: DataFrame, *names: str) -> None:
    require(df, *names)
    wrong = [n for n in names if not is_numeric(df.schema[n].dataType)]
    if wrong:
        raise ValueError(f"columns must be numeric: {wrong}")


def parsed_timestamp(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; text that does not parse becomes NULL."""
    c = col(name)
    if is_datetime(df.schema[name].dataType):
        return c
    return F.expr(f"coalesce({', '.join(_parse_sql(name))})")


# Layouts tried in order when text is cast to a timestamp.
DATE_LAYOUTS = ("yyyy/MM/dd", "MM/dd/yyyy", "yyyyMMdd", "d MMM yyyy")


def _parse_sql(name: str) -> list[str]:
    q = "`" + name.replace("`", "``") + "`"
    text = f"cast({q} as string)"
    return [f"try_cast({text} as timestamp)"] + [f"try_to_timestamp({text}, '{p}')" for p in DATE_LAYOUTS]


def datetime_columns(df: DataFrame, exclude: str | None = None) -> list[str]:
    """Date-typed columns, plus text columns with a date-like name of whose values more
    than 70 % parse: one aggregate over all rows for all such columns."""
    fields = [f for f in df.schema.fields if f.name != exclude]
    named = [f.name for f in fields if is_text(f.dataType) and date_named(f.name)]
    parses = [F.avg(F.when(col(c).isNotNull(), parsed_timestamp(df, c).isNotNull().cast("double"))).alias(f"_{i}") for i, c in enumerate(named)]
    shares = dict(zip(named, df.agg(*parses).first())) if named else {}
    return [f.name for f in fields if is_datetime(f.dataType) or (shares.get(f.name) or 0) > 0.7]
