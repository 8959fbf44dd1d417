"""Exact duplicates: 128-bit content hash, then the bytes themselves."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, spread_join, whole


def classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    normal: Callable[[Column], Column] = ascii_lower,
    digest: Callable[[Column], Column] = F.md5,
    keep: Callable[[Column], Column] = F.min,
) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical byte by byte after ``normal``. Rows are grouped by
    ``digest`` and by the text itself, with partial groups in every task, so a group of
    any size costs one row a task and texts that share a digest stay apart. Then each
    row looks its group up by digest; the rows of a digest that several texts share
    look it up by text.

    A null text counts as empty; all empty texts are one group. ``keep`` picks the key
    that stays (``F.min`` or ``F.max``); null keys are kept only in a group without any
    key. Rows that repeat a key and text are one document, marked alike. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key), normal(whole(text)).alias("_text")).withColumn("_key", digest(F.col("_text")))
    groups = rows.groupBy("_key", "_text").agg(keep(F.col(key)).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    digests = materialize(groups.select("_key", "keep_id", "group_size", F.sha2("_text", 256).alias("text_sha256")))
    shared = digests.groupBy("_key").count().where("count > 1").select("_key")
    if shared.isEmpty():
        found = spread_join(rows.select(key, "_key"), digests, "_key", "group_size")
    else:
        shared = materialize(shared)
        alone = digests.join(shared, "_key", "left_anti")
        found = spread_join(rows.join(shared, "_key", "left_anti").select(key, "_key"), materialize(alone), "_key", "group_size")
        apart = rows.join(shared, "_key", "left_semi")
        sizes = groups.join(shared, "_key", "left_semi").withColumn("text_sha256", F.sha2("_text", 256))
        found = found.unionByName(apart.join(sizes, ["_key", "_text"]).select(found.columns))
    return found.select(key, "keep_id", "group_size", F.col(key).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def first_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    kept = classes(docs, key, text, **how).where("kept").select(F.col(key).alias("_kept_key")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept_key"]), "left_semi")
