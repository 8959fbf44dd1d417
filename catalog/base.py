"""Registration and the shared views with gaps.

The driver tables hold no missing values, so the views below set some to NULL.
The same expressions run in Spark and in the SQL.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev": (
        "events",
        (
            "event_id", "user_id", "ts",
            "nullif(event_type, 'error') AS event_type",
            "CASE WHEN value BETWEEN 5 AND 9 THEN NULL ELSE value END AS value",
        ),
    ),
    "li": (
        "lineitem",
        (
            "l_orderkey", "l_partkey",
            "nullif(l_linenumber, 3) AS l_linenumber",
            "l_quantity", "l_extendedprice",
            "CASE WHEN l_discount BETWEEN 0.045 AND 0.055 THEN NULL ELSE l_discount END AS l_discount",
            "l_tax",
            "nullif(l_returnflag, 'R') AS l_returnflag",
            "l_linestatus", "l_shipdate",
        ),
    ),
    "pa": (
        "part",
        (
            "p_partkey", "p_name",
            "nullif(p_brand, 'Brand#7') AS p_brand",
            "p_type", "nullif(p_size, 25) AS p_size", "p_retailprice",
            "CASE WHEN p_size > 15 THEN NULL ELSE p_size END AS p_small",
            "'x' AS p_const",
        ),
    ),
    "od": (
        "orders",
        (
            "o_orderkey", "o_custkey",
            "nullif(o_orderstatus, 'P') AS o_orderstatus",
            "o_totalprice",
            "nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority",
            "o_orderdate",
        ),
    ),
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, exprs = VIEWS[name]
    return table(spark, sf, source).selectExpr(*exprs)


def with_view(name: str, body: str) -> str:
    """SQL over a view of the same name."""
    source, exprs = VIEWS[name]
    return f"WITH {name} AS (SELECT {', '.join(exprs)} FROM {source}) {body}"


def and_with(name: str, body: str) -> str:
    """As ``with_view`` when the body starts with further named parts."""
    return with_view(name, ", " + body)


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round named columns (all doubles when none is named); -0.0 becomes 0.0."""
    names = names or tuple(f.name for f in df.schema.fields if f.dataType.simpleString() == "double")
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def rnd(expr: str, digits: int) -> str:
    return f"round({expr}, {digits}) + 0.0"
