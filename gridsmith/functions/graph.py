"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import LIMITS, materialize
from .distributed import lookup_join


def components(edges: DataFrame, one_task_edges: int | None = None) -> DataFrame:
    """vertex, component (the smallest vertex of it) for every vertex of (a, b) text
    edges.

    Small edge tables are solved in one task. Larger ones by alternating large and
    small stars: every vertex links its neighbours to the smallest one it knows,
    until nothing changes. A hub costs one partial minimum a task and its rows are
    spread when the minimum is looked up.
    """
    limit = LIMITS.single_task_rows // 8 if one_task_edges is None else one_task_edges
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    if edges.count() <= limit:
        one = edges.select(F.lit(0).alias("g"), "a", "b")
        return one.groupBy("g").applyInPandas(_union_find(), "vertex string, component string")
    seen = None
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        seen = mark
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)


def _with_least(links: DataFrame) -> DataFrame:
    """(u, v) links with ``m``: the smallest of u and its linked vertices."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return lookup_join(links, least.withColumn("m", F.least("u", "m")), ["u"], "n")


def _large_star(edges: DataFrame) -> DataFrame:
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = links.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    out = _with_least(links).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = _with_least(links)
    out = low.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _union_find():
    def solve(pdf):
        import pandas as pd

        parent = {}

        def root(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for a, b in zip(pdf["a"], pdf["b"]):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        names = list(parent)
        return pd.DataFrame({"vertex": names, "component": [root(v) for v in names]}, columns=["vertex", "component"])

    return solve
