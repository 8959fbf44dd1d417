"""Integer product codes of vectors: nearest codebook entries by sliced bitmasks.

A vector is cut into parts; every part is coded by the nearest of at most 64 entries of
its codebook. For each coordinate the entries are sorted once, and before every place of
that order stands a 64-bit mask of the entries in front of it. The entries within a radius
in one coordinate are then one mask without another, those in all coordinates the AND of
these, and only they are measured. A least distance within the radius is exact, ties
included; otherwise the radius grows to that distance, or twofold if nothing was found.

Codebooks start as the parts of the vectors with the smallest keys. A round sums the parts
of every entry (partial sums per task, then one row per entry and coordinate) and moves
the entry to the floor of their mean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import spread_join

#: Entries of a codebook; a mask is one 64-bit word.
ENTRIES = 64
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Scaled components are held within this magnitude, so that no sum leaves 64 bits.
LARGEST = 2**26
#: Vectors coded in one go.
STEP = 4_096


class Slices:
    """Nearest entry of one part, exact, ties to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, 0).T)
        bits = np.uint64(1) << order.astype(np.uint64)
        self.before = np.concatenate([np.zeros((1, entries.shape[1]), np.uint64), np.bitwise_or.accumulate(bits)]).T
        apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        apart = np.where(apart > 0, apart, apart.max(initial=0))
        np.fill_diagonal(apart, apart.max(initial=0))
        self.radius = max(1, int(np.sqrt(np.median(apart.min(axis=1))))) if len(entries) else 1

    def within(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within ``radius`` of each row in every coordinate."""
        masks = np.full(len(rows), np.uint64(2**64 - 1))
        for values, before, own in zip(self.sorted, self.before, rows.T):
            low = before[np.searchsorted(values, own - radius, side="left")]
            masks &= before[np.searchsorted(values, own + radius, side="right")] & ~low
        return masks

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        index, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo, radius = np.arange(len(rows)), np.full(len(rows), self.radius, np.int64)
        while len(todo):
            masks = self.within(rows[todo], radius)
            at, entry = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            least = np.full(len(todo), np.iinfo(np.int64).max)
            if len(at):
                far = ((rows[todo[at]] - self.entries[entry]) ** 2).sum(axis=1)
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                least[at[starts]] = np.minimum.reduceat(far, starts)
                hits = np.flatnonzero(far == least[at])
                seen, first = np.unique(at[hits], return_index=True)
                index[todo[seen]], error[todo[seen]] = entry[hits[first]], least[seen]
            found = least < np.iinfo(np.int64).max
            sure = found & (least <= radius * radius)
            wider = np.where(found, np.ceil(np.sqrt(np.where(found, least, 0))).astype(np.int64) + 1, radius * 2)
            todo, radius = todo[~sure], wider[~sure]
        return index, error


class Codebooks:
    """Codebooks of all parts, an array (parts, entries, width)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.slices = [Slices(e) for e in entries]

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes (rows, parts) and the summed squared distance of each row."""
        width = self.entries.shape[2]
        found = [s.nearest(rows[:, p * width : (p + 1) * width]) for p, s in enumerate(self.slices)]
        return np.stack([i for i, _ in found], axis=1), np.sum([e for _, e in found], axis=0)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scaled(vectors: pa.Array, width: int) -> np.ndarray:
    """Integer components; shorter vectors end in zeros."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    flat = np.asarray(pc.list_flatten(vectors).cast(pa.float64()), np.float64)
    out = np.zeros((len(vectors), width), np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return out


def usable(vector: Column) -> Column:
    """Not null, and neither null nor infinite nor NaN in any component."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over ``rows`` (``_vector``)."""
    parts, entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), STEP):
                own = scaled(batch.column(0).slice(lo, STEP), parts * width)
                index, _ = books.assign(own)
                for p in range(parts):
                    np.add.at(total[p], index[:, p], own[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(index[:, p], minlength=entries)
        p, e = np.nonzero(count)
        if len(p):
            cells = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), total[p, e].ravel(), np.repeat(count[p, e], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], names=["part", "entry", "place", "total", "n"])

    found = rows.mapInArrow(sums, "part long, entry long, place long, total long, n long")
    moved = books.entries.copy()
    # one row a coordinate of an entry: bounded by the codebooks
    for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r.part, r.entry, r.place] = r.total // r.n
    return Codebooks(moved)


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 16, rounds: int = 2) -> Codebooks:
    """Codebooks of the usable vectors after ``rounds`` rounds over all of them.

    The first entries are the vectors with the ``ENTRIES`` smallest keys (null keys last,
    equal keys by their vectors), all of them if there are fewer.
    """
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")).where(usable(F.col("_vector")))
    longest = rows.agg(F.max(F.size("_vector"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = rows.orderBy(F.col("_key").asc_nulls_last(), "_vector").limit(ENTRIES).select("_vector").collect()
    start = scaled(pa.array([r[0] for r in first], pa.list_(pa.float64())), parts * width)
    books = Codebooks(start.reshape(-1, parts, width).transpose(1, 0, 2).copy())
    for _ in range(rounds if len(first) else 0):
        books = _moved(rows.select("_vector"), books)
    return books


def _coder(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    parts, _, width = books.entries.shape

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), STEP):
                part = batch.slice(lo, STEP)
                index, error = books.assign(scaled(part.column(2), parts * width))
                line = index.astype(np.uint8).tobytes().hex()
                codes = [line[i : i + 2 * parts] for i in range(0, len(line), 2 * parts)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(error.astype(np.int64))], names=["_key", "_label", "code", "error"])

    return code


def encode(vectors: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, code (two hex digits a part) and error (long) of every usable vector."""
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector")).where(usable(F.col("_vector")))
    fields = [*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    return rows.mapInArrow(_coder(books), T.StructType(fields)).select(F.col("_key").alias(key), F.col("_label").alias(label), "code", "error")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, rounds: int = 2) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of every usable row of ``vectors``.

    A vector that is null, or holds a null, NaN or infinite component, has no row. The
    longest vector, rounded up to a multiple of ``parts``, gives the width; shorter ones,
    empty ones included, end in zeros. Scaled components beyond ``LARGEST`` count as
    that. Repeated keys have a row each; a null key is a key like another, a null label a
    label. Other columns are ignored. An empty table gives an empty result. The table
    is read once a round and three times besides.
    """
    books = train(vectors, key, vector, parts, rounds)
    coded = encode(vectors.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_vector")), books, "_key", "_vector", "_label")
    own = materialize(coded.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("_label").cast("string")), F.lit(""))).drop("_label"))
    totals = materialize(own.groupBy("_name").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    out = spread_join(own, totals, "_name", "_n")
    return out.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
