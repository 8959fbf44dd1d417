"""SimHash near-duplicates through Burkhard-Keller trees.

A fingerprint has a bit set where more than half of the shingle hashes have it. Equal
fingerprints are merged first. Two fingerprints within ``radius`` bits agree on all bits
of at least ``blocks - radius`` of ``blocks`` blocks, so for every choice of that many
blocks the fingerprints are dealt into shards by the bits of the chosen blocks. Each
shard becomes a tree whose children are keyed by their integer Hamming distance to the
parent; a search follows only the edges that the triangle inequality allows. The trees
stay with their shard in one task; only links of a spanning forest leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components
from ..session import materialize
from .blocks import layout, signed
from .common import spread_join, whole

#: Fingerprints of one shard that a task compares at once; larger shards are compared in pairs of pieces.
PIECE = 20_000
#: Rows of shards that a task takes at a time.
TASK_ROWS = 40_000
#: (query, node) pairs held while searching.
FRONT = 2_000_000
#: Shingles hashed in one go.
RUN = 65_536


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of the words of a text, A-Z lowered; 0 without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(found) - shingle + 1)
    spans = list(zip(starts[:count].tolist(), ends[-count:].tolist()))
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, count, RUN):
        hashes = np.array([digest(line[a:b], seed) for a, b in spans[i : i + RUN]], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.uint64)[0])


def fingerprints(text: str, shingle: int = 3) -> Column:
    """Column with the fingerprint as a signed long; null texts count as empty."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return prints(whole(text))


def hex_of(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


class Forest:
    """Trees of groups of distinct fingerprints, built level by level.

    The first fingerprint of a group is its root; the others go to the child keyed by
    their distance to it, and so on until every fingerprint is a node.
    """

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.prints = prints
        _, first, code = np.unique(group, return_index=True, return_inverse=True)
        self.root = first[code]
        left, pivot = np.arange(len(prints)), self.root
        child_key, child = [], []
        while True:
            keep = left != pivot
            left, pivot = left[keep], pivot[keep]
            if not len(left):
                break
            key = pivot * 65 + np.bitwise_count(prints[left] ^ prints[pivot])
            keys, first, code = np.unique(key, return_index=True, return_inverse=True)
            child_key.append(keys)
            child.append(left[first])
            pivot = left[first][code]
        keys = np.concatenate(child_key) if child_key else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.key = keys[order]
        self.child = (np.concatenate(child) if child else np.zeros(0, np.int64))[order]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within ``radius``, query after node."""
        todo = [(queries, self.root[queries])]
        while todo:
            query, node = todo.pop()
            if len(query) > FRONT:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
            hit = (far <= radius) & (node < query)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.key, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(far + radius, 64), side="right")
            n = high - low
            if n.sum():
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                todo.append((np.repeat(query, n), self.child[at]))

    def spanning(self, radius: int) -> np.ndarray:
        """The smallest node each node is linked with, directly or through others."""
        label = np.arange(len(self.prints))
        step = max(1, FRONT // 64)
        for i in range(0, len(label), step):
            for query, node in self.search(np.arange(i, min(len(label), i + step)), radius):
                while True:
                    a, b = label[query], label[node]
                    apart = a != b
                    if not apart.any():
                        break
                    query, node, a, b = query[apart], node[apart], a[apart], b[apart]
                    np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                    while (label[label] != label).any():
                        label = label[label]
        return label


def _link(radius: int):
    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "low", "high", "fp"])
        prints = pdf["fp"].to_numpy().astype(np.int64).view(np.uint64)
        group = pd.factorize(pd.MultiIndex.from_frame(pdf[["shard", "low", "high"]]))[0]
        label = Forest(prints, group).spanning(radius)
        far = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"x": prints[far].view(np.int64), "y": prints[label[far]].view(np.int64)})

    return link


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links x, y of a spanning forest of each shard over distinct long ``fp``; two
    fingerprints within ``radius`` bits are connected by links."""
    total = prints.count()
    masks = layout(total, radius)
    dealt = prints.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(masks)])).alias("shard"))
    large = dealt.groupBy("shard").count().where(F.col("count") > PIECE)
    large = large.select("shard", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    dealt = dealt.join(large, "shard", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    dealt = dealt.withColumn("piece", F.expr("cast(pmod(xxhash64(fp, 'piece'), pieces) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
    tasks = max(1, ceil(total * len(masks) / TASK_ROWS))
    dealt = dealt.select("fp", "shard", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("shard", "low", "high"), F.lit(tasks)).cast("long"))
    return dealt.groupBy("task").applyInPandas(_link(radius), "x long, y long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id for every row of ``docs``.

    ``component_id`` is the smallest key reachable through fingerprints that differ in
    at most ``radius`` bits. Null and empty texts have fingerprint zero and are linked
    like any other; fewer words than a shingle are one shingle. Rows repeating a key or
    text are in one component; a null key has a fingerprint and component, yet names
    none. Other columns are ignored. An empty table gives an empty result.
    """
    own = materialize(docs.select(F.col(key), fingerprints(text, shingle).alias("fp")))
    alike = materialize(own.groupBy("fp").agg(F.min(F.col(key)).alias("least"), F.count(F.lit(1)).alias("n")))
    found = links(alike.select("fp"), radius).where("x <> y")
    whole_of = components(found.select(F.col("x").cast("string").alias("a"), F.col("y").cast("string").alias("b")), 0)
    joined = materialize(alike.join(whole_of, F.col("fp").cast("string") == F.col("vertex"), "left").select("least", "n", F.col("fp").cast("string").alias("print"), F.coalesce("component", F.col("fp").cast("string")).alias("component")))
    least = materialize(joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")))
    named = materialize(spread_join(joined, least, "component", "size").select("print", "component_id", "n"))
    out = spread_join(own.select(F.col(key).alias("_row"), "fp", F.col("fp").cast("string").alias("print")), named, "print", "n")
    return out.select(F.col("_row").alias(key), hex_of("fp").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, with their
    columns; rows of components without any key stay."""
    kept = groups(docs, key, text, shingle, radius).where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept_key")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept_key"]), "left_semi")
