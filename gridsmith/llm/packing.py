"""Best-fit packing of documents into training sequences under conflicts.

A sequence (bin) has room for ``capacity`` words and takes neither two documents of one
source nor two of one duplicate cluster. A document longer than a bin fills bins of its
own and packs its remainder. Pieces are placed longest first into the tightest bin that
can take them: bins are ordered by residual, each carries a bitmap of its sources and one
of its clusters, and the search goes on from the first bin with enough room to the next
larger residual until a bin has neither bit.

Documents are dealt by a hash of their key into lots of a bounded number of documents;
each lot has its own bins. Lots differ in nothing but the documents, so a source with a
third of all rows has a third of every lot.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import ascii_lower, spread_join, whole

#: Mean documents of a lot.
LOT_DOCS = 4_000


def word_count(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit("[^\\x20\\x09-\\x0D]+"))


def text_cluster(text: str) -> Column:
    """Cluster of equal texts, A-Z lowered."""
    return F.md5(ascii_lower(whole(text)))


class Bins:
    """Bins of one lot."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin) of bins with room
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """Bin of a piece with the given bitmaps; opens one if none can take it."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, number = self.order[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        insort(self.order, (room - size, number))
        return number


def _pack(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lot, part in pdf.groupby("lot", sort=True):
            sources = (part["source"].isna(), pd.factorize(part["source"])[0])
            bits = zip(*sources, pd.factorize(part["cluster"])[0], part["size"], part["digest"], part.index)
            items = []
            for alone, source, cluster, size, digest, row in bits:
                source, cluster = 0 if alone else 1 << int(source), 0 if cluster < 0 else 1 << int(cluster)
                full, rest = divmod(size, capacity)
                items += [(-capacity, digest, row, k, source, cluster) for k in range(full)]
                if rest or not full:
                    items.append((-rest, digest, row, full, source, cluster))
            items.sort(key=lambda x: x[:4])
            bins, filled = Bins(capacity), {}
            placed = []
            for size, _, row, piece, source, cluster in items:
                number = bins.place(-size, source, cluster)
                filled[number] = filled.get(number, 0) - size
                placed.append((row, piece, -size, number))
            out += [(row, piece, size, int(lot) << 24 | number, filled[number]) for row, piece, size, number in placed]
        table = pd.DataFrame(out, columns=["row", "piece", "n_words", "bin_id", "bin_words"])
        table["key"] = pdf["key"].reindex(table["row"]).to_numpy()
        return table[["key", "piece", "n_words", "bin_id", "bin_words"]]

    return pack


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: Column | None = None,
    size: Column | None = None,
    capacity: int = 4096,
    lot_docs: int = LOT_DOCS,
) -> DataFrame:
    """One row per piece: key, piece, begin (first word), n_words, bin_id, bin_words.

    ``cluster`` defaults to equal texts, ``size`` to the number of words. A null text is
    empty; an empty document is one piece of no words and lies in a bin all the same.
    A null source or cluster conflicts with none. Equal sizes are placed by a hash of
    key and text, so row order does not matter; rows that repeat key and text cannot
    share a bin, and are dealt over all lots by their place in the table. Other columns are
    ignored. An empty table gives an empty result.
    """
    lots = max(1, ceil(docs.count() / lot_docs))
    own = docs.select(
        F.col(key).cast("string").alias("key"),
        F.col(source).cast("string").alias("source"),
        (text_cluster(text) if cluster is None else cluster.cast("string")).alias("cluster"),
        (word_count(text) if size is None else size).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), whole(text))).alias("digest"),
    )
    if lots > 1:
        again = materialize(own.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
        if not again.isEmpty():
            own = spread_join(own, again, "digest", "copies")
    dealt = F.when(F.col("copies").isNotNull(), F.monotonically_increasing_id()) if "copies" in own.columns else F.lit(None).cast("long")
    own = own.withColumn("lot", F.pmod(F.xxhash64("digest", dealt), F.lit(lots)).cast("long")).drop("copies")
    schema = T.StructType([
        T.StructField("key", T.StringType()), T.StructField("piece", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("bin_id", T.LongType()), T.StructField("bin_words", T.LongType()),
    ])
    placed = own.groupBy("lot").applyInPandas(_pack(capacity), schema)
    return placed.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "piece", (F.col("piece") * capacity).alias("begin"), "n_words", "bin_id", "bin_words")
