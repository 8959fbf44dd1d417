"""Ranked lexical search of query items over all documents by dense matrix products.

Items come in blocks. The terms of a block are a compact vocabulary; one pass over the
texts writes for each document the counts of these terms and its length, with the document
frequencies as one extra row a task. Documents are then taken in tiles: their impacts are
a dense float64 matrix, documents by vocabulary tile, that BLAS multiplies with the item
weights, vocabulary tile by items. All factors are integers; a vocabulary tile ends before
the weights of an item could bring a partial sum to 2^53, so every product is exact, and
tiles are added as 64-bit integers. A task keeps the best of each item, with all ties at
the border settled by key, and one ranked list per item follows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole

#: Items, and distinct terms from which a block is closed.
BLOCK_ITEMS, BLOCK_TERMS = 256, 32_768
#: Documents and terms of a tile.
TILE_DOCS, TILE_TERMS = 512, 2_048
#: Impacts stay below this.
IMPACT = 1_000_000
#: Largest sum of an item's weights in a tile.
WEIGHTS = (2**53 - 1) // IMPACT
#: Bytes of bags in a batch, and candidates held before they are ranked.
BAG_BYTES, HELD = 4_000_000, 400_000

#: Separators become spaces, A-Z lower case; other bytes belong to terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

BAG = "doc long, n long, n_docs long, terms binary, counts binary"


def terms(text: str) -> list[bytes]:
    """Maximal runs of digits, letters A-Z in lower case, and characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_BYTES).split()


class Block:
    """Items with a compact vocabulary."""

    def __init__(self):
        self.ids: list = []
        self.bags: list[Counter] = []
        self.vocabulary: dict[bytes, int] = {}

    def add(self, item, text: str) -> None:
        found = Counter(terms(text))
        self.ids.append(item)
        self.bags.append(Counter({self.vocabulary.setdefault(t, len(self.vocabulary)): n for t, n in found.items()}))

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_ITEMS or len(self.vocabulary) >= BLOCK_TERMS


def tiles(weights: np.ndarray, limit: int = WEIGHTS, wide: int = TILE_TERMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, float64 weights) of vocabulary tiles of ``weights`` (terms, items), in none
    of which an item's weights sum to more than ``limit``. A weight above it is dealt to
    several tiles."""
    out, left = [], weights.copy()
    rows = np.flatnonzero(left.any(axis=1))
    while len(rows):
        own, taken, room = [], [], np.full(weights.shape[1], limit, np.int64)
        for r in rows:
            if len(own) == wide:
                break
            part = np.minimum(left[r], limit)
            if (part <= room).all():
                own.append(r)
                taken.append(part)
                room -= part
                left[r] -= part
        out.append((np.array(own), np.array(taken, np.float64)))
        rows = rows[left[rows].any(axis=1)]
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


class Best:
    """The highest scores of each item, ties by ascending key, null keys last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows, self.held = [], 0

    def add(self, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        at, item = np.nonzero(scores >= self.least)
        self.rows.append((item, scores[at, item], docs[at], missing[at]))
        self.held += len(at)
        if self.held > HELD:
            self.ranked()

    def ranked(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        item, score, doc, missing = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((doc, missing, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        order, item = order[place < self.k], item[place < self.k]
        kept = item, score[order], doc[order], missing[order]
        last = np.arange(len(item)) - np.searchsorted(item, item) == self.k - 1
        self.least[item[last]] = kept[1][last]
        self.rows, self.held = [kept], len(item)
        return kept


def _bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per document (``n`` terms, and its counts in the vocabulary) and one per
    task with ``n_docs``: documents with terms, their ``n``, and document frequencies."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [p.split()[0] for p in BAG.split(", ")]

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, all_n, all_docs, df = known.value.get, 0, 0, np.zeros(len(known.value), np.int64)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            rows, size = [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = terms(text.as_py())
                codes = np.fromiter(map(find, found, repeat(-1)), np.int32, len(found))
                codes, counts = np.unique(codes[codes >= 0], return_counts=True)
                all_n += len(found)
                all_docs += bool(found)
                df[codes] += 1
                if len(codes):
                    rows.append((doc.as_py(), len(found), None, codes.tobytes(), counts.astype(np.int64).tobytes()))
                    size += 12 * len(codes)
                if size > BAG_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)
        used = np.flatnonzero(df).astype(np.int32)
        yield made([(None, all_n, all_docs, used.tobytes(), df[used].tobytes())])

    return docs.mapInArrow(bag, BAG)


def _statistics(bags: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the document frequency of each code."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = [np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist()]
            n = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if code:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(code)), pa.array(np.concatenate(n))], names=["code", "n"])

    tasks = bags.where("n_docs is not null")
    total = tasks.agg(F.sum("n_docs"), F.sum("n")).first()
    df = np.zeros(size, np.int64)
    for r in tasks.select("terms", "counts").mapInArrow(cells, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        df[r.code] = r.n  # one row a term of the block
    return total[0] or 0, total[1] or 0, df


def _search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    bags = materialize(_bags(docs, block.vocabulary))
    n_docs, length, df = _statistics(bags, len(block.vocabulary))
    weight = [floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()]
    held = np.zeros((len(weight), len(block.ids)), np.int64)
    for i, bag in enumerate(block.bags):
        for code, n in bag.items():
            held[code, i] = n * weight[code]
    parts = docs.sparkSession.sparkContext.broadcast(tiles(held))
    items = len(block.ids)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Best(items, k)
        where = []
        for own, _ in parts.value:
            column = np.full(len(weight), -1, np.int32)
            column[own] = np.arange(len(own))
            where.append(column)
        for batch in batches:
            for lo in range(0, len(batch), TILE_DOCS):
                tile = batch.slice(lo, TILE_DOCS)
                codes = [np.frombuffer(x, np.int32) for x in tile.column(2).to_pylist()]
                tf = np.concatenate([np.frombuffer(x, np.int64) for x in tile.column(3).to_pylist()])
                m = np.array([25 + 75 * n * n_docs // length for n in tile.column(1).to_pylist()], np.int64)
                row = np.repeat(np.arange(len(tile)), [len(c) for c in codes])
                code, impact = np.concatenate(codes), impacts(tf, m[row])
                scores = np.zeros((len(tile), items), np.int64)
                for column, (own, weights) in zip(where, parts.value):
                    at = column[code]
                    hit = at >= 0
                    if hit.any():
                        dense = np.zeros((len(tile), len(own)))
                        dense[row[hit], at[hit]] = impact[hit]
                        scores += (dense @ weights).astype(np.int64)
                doc = tile.column(0)
                top.add(scores, np.asarray(doc.fill_null(0), np.int64), np.asarray(doc.is_null()))
        item, score, doc, missing = top.ranked()
        arrays = [pa.array(item.astype(np.int32)), pa.array(doc, pa.int64(), mask=missing), pa.array(score)]
        yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc", "score"])

    found = bags.where("n_docs is null").select("doc", "n", "terms", "counts").mapInArrow(best, "item int, doc long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """item, rank (from 1), key and score of the ``k`` best documents of every item.

    Only scores above 0 count; equal scores come by ascending key, null keys last. Null
    and empty texts have no terms. Rows that repeat a key are documents of their own,
    as are items that repeat theirs. Other columns are ignored. Without documents or
    items the result is empty. Keys are integers. Items pass through the driver in blocks
    of bounded size, each block reads the documents once and writes their counts once.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("doc"), whole(text).alias("text"))
    kind = items.schema[item].dataType
    schema = "item int, id " + kind.simpleString()
    out = None

    def ranked(block: Block) -> DataFrame:
        names = spark.createDataFrame(list(enumerate(block.ids)), schema)
        found = _search_block(own, block, k).join(F.broadcast(names), "item")
        return found.select(F.col("id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")

    block = Block()
    for row in items.select(F.col(item), whole(item_text)).toLocalIterator():
        block.add(*row)
        if block.full():
            out = ranked(block) if out is None else out.unionByName(ranked(block))
            block = Block()
    if block.ids or out is None:
        out = ranked(block) if out is None else out.unionByName(ranked(block))
    return out
