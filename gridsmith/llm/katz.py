"""Katz backoff bigram model over a corpus, trained and evaluated in blocks.

Documents are coded into blocks of some million tokens with a word list of their own. A
block asks for its distinct words and word pairs, not for its tokens: requests are dealt
by a hash into buckets, a bucket adds up what all blocks count and answers each of them
in the order of its request. So the count tables stay partitioned, nothing is broadcast
but the counts of counts, and a frequent word costs one entry a block. The pairs of
frequent first words are dealt by both words, so no bucket holds a whole hot context.

Words are named by their 64-bit hash: among 10**9 different words a clash has a chance of
about one in forty.

Probabilities: a count r up to 5 is discounted by Good and Turing's ratio d(r) at both
orders. P(w) is d(r) r / N for known words, all others share the mass that is left.
P(w | v) is d(r) r / c(v) for a seen pair and a(v) P(w) otherwise; a(v) makes the sum over
known words and the class of unknown ones exactly 1. After an unseen v it is P(w).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import whole

#: Tokens of a block before its last document, and of all blocks for each bucket.
BLOCK_TOKENS, BUCKET_TOKENS = 2_000_000, 2_500_000
#: Counts up to this one are discounted.
CUT = 5
#: A first word with one in so many tokens has its pairs dealt by both words.
HOT_SHARE = 1_000
#: Local numbers of the end token, and of the context before the first word.
END, START = 0, 1
_FIXED = (b"", b" ")

_ANSWER = "kind int, block long, bucket int, a binary, b binary, c binary, d binary, stats array<double>"


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, equal places of its items together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(3).compress(planes)


def unpack(blob: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


# -- discounts -------------------------------------------------------------------------


def discounts(counts_of_counts: list[float]) -> np.ndarray:
    """d(0..CUT+1) from n(1..CUT+1); d is 1 beyond the cut. Where the counts of counts
    give no ratio between 0 and 1, half a count is taken off."""
    n = [0.0, *map(float, counts_of_counts)]
    d = np.ones(CUT + 2)
    high = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - high) / (1 - high) if n[r] and high < 1 else 0.0
        d[r] = ratio if 0 < ratio < 1 else 1 - 0.5 / r
    return d


def shares(seen: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the discounted counts, and the mass left to the rest: what discounts
    took off, at least half a count."""
    total = np.maximum(total, 1e-300)
    least = 0.5 / (total + 1)
    left = np.maximum(1 - seen / total, least)
    return np.where(seen > 0, (1 - left) * total / np.maximum(seen, 1e-300), 1.0), left


@dataclass(frozen=True)
class Words:
    """Order 1: tokens N, types V, discounts, scale of seen words, mass of unknown ones."""

    tokens: int
    types: int
    discount: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, types: float, tokens: float, n: list[float]) -> Words:
        d = discounts(n)
        if not tokens:
            return cls(0, 0, d, 1.0, 1.0)
        small = sum(r * n[r - 1] for r in range(1, CUT + 1))
        seen = sum(d[r] * r * n[r - 1] for r in range(1, CUT + 1)) + tokens - small
        scale, left = shares(np.array([seen]), np.array([tokens]))
        return cls(int(tokens), int(types), d, float(scale[0]), float(left[0]))

    def share(self, counts: np.ndarray) -> np.ndarray:
        known = self.scale * self.discount[np.minimum(counts, CUT + 1)] * counts / max(self.tokens, 1)
        return np.where(counts > 0, known, self.unknown)


def backoff(stats: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total, scale of seen pairs and backoff weight of contexts. A row of ``stats`` has
    the number of pairs seen 1 to CUT times, the counts beyond, and the share at order 1
    of the words seen."""
    small = stats[:, :CUT] * np.arange(1, CUT + 1)
    total = small.sum(axis=1) + stats[:, CUT]
    scale, left = shares(small @ discount[1 : CUT + 1] + stats[:, CUT], total)
    return total, scale, np.where(total > 0, left / (1 - stats[:, CUT + 1]), 1.0)


# -- blocks ----------------------------------------------------------------------------


def blocks(docs: DataFrame, key: str, text: str, held: Column) -> DataFrame:
    """Coded documents: block, keys, held, sizes, tokens (local numbers), words (hashes)."""
    own = docs.select(F.col(key).cast("string"), F.coalesce(held, F.lit(False)).alias("_held"), whole(text).alias("_text"))
    kind = own.schema[0].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("tokens", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("n", T.LongType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24

        def fresh():
            return {w: i for i, w in enumerate(_FIXED)}, [], [], [], []

        def done() -> pa.RecordBatch:
            words = np.array([xxhash.xxh64_intdigest(w) for w in index], np.uint64)
            row = {"block": number, "keys": keys, "held": flags, "sizes": [len(t) for t in tokens], "tokens": pack(np.concatenate(tokens)), "words": pack(words), "n": sum(map(len, tokens))}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        index, keys, flags, tokens, _ = fresh()
        size = 0
        for batch in batches:
            for k, h, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = [index.setdefault(w, len(index)) for w in t.encode().lower().split()]
                own.append(END)
                keys.append(k)
                flags.append(h)
                tokens.append(np.array(own, np.uint32))
                size += len(own)
                if size >= BLOCK_TOKENS:
                    yield done()
                    index, keys, flags, tokens, _ = fresh()
                    size, number = 0, number + 1
        if keys:
            yield done()

    return own.mapInArrow(code, schema)


def _trained(sizes, held) -> np.ndarray:
    """Mask of the tokens that count."""
    return np.repeat(~np.asarray(held, bool), np.asarray(sizes, np.int64))


def _cuts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of a sorted array."""
    begins = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1]) if len(buckets) else np.zeros(0, int)
    return [(int(buckets[b]), int(b), int(e)) for b, e in zip(begins, [*begins[1:], len(buckets)])]


def _word_order(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    route = (words % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(route, kind="stable")
    return order, route[order]


def _ask_words(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, tokens = unpack(r["words"], np.uint64), unpack(r["tokens"], np.uint32)
                counts = np.bincount(tokens[_trained(r["sizes"], r["held"])], minlength=len(words)).astype(np.uint32)
                order, route = _word_order(words, buckets)
                rows = [{"bucket": k, "block": r["block"], "a": pack(words[order[b:e]]), "b": pack(counts[order[b:e]])} for k, b, e in _cuts(route)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]))

    return ask


def _answers(rows: list[dict]) -> pd.DataFrame:
    names = ["kind", "block", "bucket", "a", "b", "c", "d", "stats"]
    return pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)


def _add_words(buckets: int):
    """Kind 0 to each block: a word's count and number; kind 1: V, N, n(1..CUT+1)."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack(x, np.uint64) for x in pdf["a"]]
        _, code = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(code, weights=np.concatenate([unpack(x, np.uint32) for x in pdf["b"]])).astype(np.int64)
        bucket = int(pdf["bucket"].iloc[0])
        rows, at = [], 0
        for block, words in zip(pdf["block"], asked):
            own = code[at : at + len(words)]
            at += len(words)
            rows.append({"kind": 0, "block": block, "bucket": bucket, "a": pack(counts[own]), "b": pack(own * buckets + bucket)})
        n = np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        rows.append({"kind": 1, "block": -1, "bucket": bucket, "stats": [float((counts > 0).sum()), float(counts.sum()), *map(float, n)]})
        return _answers(rows)

    return add


class Block:
    """A coded block with the answers about its words; its distinct pairs in the order in
    which it asks for them. Buckets of hot first words are negative."""

    def __init__(self, row, words: pd.DataFrame, model: Words, buckets: int):
        hashes = unpack(row["words"], np.uint64)
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.trained = _trained(self.sizes, row["held"])
        order, route = _word_order(hashes, buckets)
        self.count, self.number = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        answer = {int(b): (x, y) for b, x, y in zip(words["bucket"], words["a"], words["b"])}
        for bucket, b, e in _cuts(route):
            self.count[order[b:e]] = unpack(answer[bucket][0], np.int64)
            self.number[order[b:e]] = unpack(answer[bucket][1], np.int64)
        before = np.concatenate([[START], self.tokens[:-1]])
        before[np.cumsum(self.sizes)[:-1]] = START
        pairs, code = np.unique(before * len(hashes) + self.tokens, return_inverse=True)
        first, second = pairs // len(hashes), pairs % len(hashes)
        a, b = self.number[first], self.number[second]
        hot = (self.count[first] * HOT_SHARE >= max(model.tokens, 1)) | (first == START)
        mixed = ((a * 1_000_003 + b) * 7_919 % 2_147_483_647) % buckets
        route = np.where(hot, -1 - mixed, a % buckets)
        order = np.lexsort((b, a, route))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.pair_of = back[code]
        self.route, self.a, self.b = route[order], a[order], b[order]
        self.second_count = self.count[second][order]


def _ask_pairs(model: Words, buckets: int):
    def ask(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            block = Block(row, words, model, buckets)
            counts = np.bincount(block.pair_of[block.trained], minlength=len(block.a)).astype(np.uint32)
            out += [
                {"bucket": k, "block": row["block"], "a": pack(np.diff(block.a[b:e], prepend=0)), "b": pack(block.b[b:e]), "c": pack(counts[b:e]), "d": pack(block.second_count[b:e])}
                for k, b, e in _cuts(block.route)
            ]
        return pd.DataFrame(out, columns=["bucket", "block", "a", "b", "c", "d"])

    return ask


def _add_pairs(model: Words):
    """Kind 2 to each block: counts of its pairs and, for each first word in turn, what
    ``backoff`` needs; kind 3: n(1..CUT+1); kind 4: a part of a hot context's numbers."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        firsts = [np.cumsum(unpack(x, np.int64)) for x in pdf["a"]]
        names, a = np.unique(np.concatenate(firsts), return_inverse=True)
        seconds, b = np.unique(np.concatenate([unpack(x, np.int64) for x in pdf["b"]]), return_inverse=True)
        pairs, at, code = np.unique(a * len(seconds) + b, return_index=True, return_inverse=True)
        counts = np.bincount(code, weights=np.concatenate([unpack(x, np.uint32) for x in pdf["c"]])).astype(np.int64)
        share = model.share(np.concatenate([unpack(x, np.int64) for x in pdf["d"]])[at])
        context = pairs // len(seconds)
        stats = np.zeros((len(names), CUT + 2))
        for r in range(1, CUT + 1):
            stats[:, r - 1] = np.bincount(context[counts == r], minlength=len(names))
        many, seen = counts > CUT, counts > 0
        stats[:, CUT] = np.bincount(context[many], weights=counts[many], minlength=len(names))
        stats[:, CUT + 1] = np.bincount(context[seen], weights=share[seen], minlength=len(names))
        rows, at = [], 0
        for block, first in zip(pdf["block"], firsts):
            own = code[at : at + len(first)]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1])
            mine = stats[context[own[heads]]]
            at += len(first)
            rows.append({"kind": 2, "block": block, "bucket": bucket, "a": pack(counts[own]), "b": pack(mine[:, : CUT + 1].astype(np.int64).ravel()) if bucket >= 0 else None, "c": pack(mine[:, CUT + 1]) if bucket >= 0 else None})
        n = np.bincount(np.minimum(counts, CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
        rows.append({"kind": 3, "block": -1, "bucket": bucket, "stats": list(map(float, n))})
        if bucket < 0:
            rows += [{"kind": 4, "block": int(v), "bucket": bucket, "stats": s.tolist()} for v, s in zip(names, stats)]
        return _answers(rows)

    return add


def _score(model: Words, discount: np.ndarray, hot: dict[int, list[float]], buckets: int, names: list[str]):
    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            block = Block(row, answers[answers["kind"] == 0], model, buckets)
            counts, total, scale, weight = (np.zeros(len(block.a)) for _ in range(4))
            pairs = answers[answers["kind"] == 2]
            answer = {int(k): (x, y, z) for k, x, y, z in zip(pairs["bucket"], pairs["a"], pairs["b"], pairs["c"])}
            for bucket, b, e in _cuts(block.route):
                x, y, z = answer[bucket]
                counts[b:e] = unpack(x, np.int64)
                first = block.a[b:e]
                heads = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1])
                if bucket < 0:
                    stats = np.array([hot[int(v)] for v in first[heads]])
                else:
                    stats = np.column_stack([unpack(y, np.int64).reshape(len(heads), CUT + 1), unpack(z, np.float64)])
                runs = np.diff([*heads, e - b])
                for into, value in zip((total, scale, weight), backoff(stats, discount)):
                    into[b:e] = np.repeat(value, runs)
            seen = scale * discount[np.minimum(counts, CUT + 1).astype(int)] * counts / np.maximum(total, 1)
            chance = np.log10(np.where(counts > 0, seen, weight * model.share(block.second_count)))
            known = block.count[block.tokens]
            base = np.log10((known + 1) / (model.tokens + model.types + 1))
            begins = np.cumsum(block.sizes) - block.sizes
            out.append(pd.DataFrame({
                names[0]: list(row["keys"]), "held_out": np.asarray(row["held"], bool), "n_tokens": block.sizes,
                "n_known": np.add.reduceat((known > 0).astype(np.int64), begins), "train_tokens": model.tokens,
                "base_score": np.add.reduceat(base, begins), "score": np.add.reduceat(chance[block.pair_of], begins),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    return score


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows where ``held`` is not true and score every row: key, held_out,
    n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between ASCII white space, A-Z lowered, and one end. A null
    text is empty and has the end alone; a null ``held`` is false. Rows that repeat a
    key or text count and are scored each. Without training rows all tokens are unknown
    with probability 1 at both orders. Other columns are ignored. An empty table gives
    an empty result.
    """
    coded = materialize(blocks(docs, key, text, held))
    buckets = max(1, ceil((coded.agg(F.sum("n")).first()[0] or 0) / BUCKET_TOKENS))
    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [T.StringType(), T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    asked = coded.mapInArrow(_ask_words(buckets), "bucket int, block long, a binary, b binary")
    words = materialize(asked.groupBy("bucket").applyInPandas(_add_words(buckets), _ANSWER))
    sums = words.where("kind = 1").agg(*[F.sum(F.col("stats")[i]) for i in range(CUT + 3)]).first()
    model = Words.of(*(([x or 0.0 for x in sums[:2]])), [x or 0.0 for x in sums[2:]])

    to_blocks = words.where("kind = 0")
    pairs = coded.groupBy("block").cogroup(to_blocks.groupBy("block")).applyInPandas(_ask_pairs(model, buckets), "bucket int, block long, a binary, b binary, c binary, d binary")
    pairs = materialize(pairs.groupBy("bucket").applyInPandas(_add_pairs(model), _ANSWER))
    sums = pairs.where("kind = 3").agg(*[F.sum(F.col("stats")[i]) for i in range(CUT + 1)]).first()
    parts = pairs.where("kind = 4").groupBy("block").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(CUT + 2)])
    hot = {r[0]: list(r[1:]) for r in parts.collect()}  # at most HOT_SHARE first words and the start
    answers = to_blocks.unionByName(pairs.where("kind = 2"))
    scored = _score(model, discounts([x or 0.0 for x in sums]), hot, buckets, names)
    out = coded.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scored, schema)
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *names[1:])
