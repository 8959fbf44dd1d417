"""Token counts of whole texts by a two-tier table of pre-token lengths.

A text is cut where no merge of the vocabulary can cross: before a run of spaces and
around line breaks. Each cut piece (pre-token) then has the same tokens alone as in its
text, so a text's count is the sum over its pre-tokens. ``check_cuts`` proves the cuts
against the vocabulary. The lengths of frequent pre-tokens are broadcast; the others are
encoded once a worker and remembered there. Pre-tokens are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

CUT = re.compile(" *[^ \n]+|\n+| +")
#: Documents whose pre-tokens are counted to choose the broadcast ones, and their number. Both steer speed only.
SAMPLE_DOCS, FREQUENT = 2_000, 50_000
#: Entries a worker remembers, and the longest pre-token worth remembering.
CACHE, LONGEST = 300_000, 64

_workers: dict[str, tuple] = {}


def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_cuts(sp) -> None:
    """Raise unless no piece holds a space after another character, nor a line break."""
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if re.search("[^▁]▁|\n", piece):
            raise ValueError(f"piece {piece!r} crosses a pre-token boundary")
    if sp.encode("\n\n", out_type=str) != ["▁", "<0x0A>", "<0x0A>"] or sp.normalize("a  å ") != "▁a▁▁å▁":
        raise ValueError("the model changes spaces or lacks byte pieces")


def pre_tokens(text: str) -> list[str]:
    """Cut pieces of a text as the model sees it: with the space it puts in front."""
    return CUT.findall(" " + text.replace("▁", " ")) if text else []


def lengths(sp, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token. The model adds a space itself; a pre-token without one
    is encoded after a line break, whose two tokens are taken off."""
    ids = sp.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
    return [max(1, len(x)) if p[0] == " " else len(x) - 2 for p, x in zip(pieces, ids)]


def frequent(docs: DataFrame, text: str, model: str) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about ``SAMPLE_DOCS`` documents; at
    most ``FREQUENT`` entries of at most ``LONGEST`` characters."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(p for p in pre_tokens(value) if len(p) <= LONGEST)
        yield pa.RecordBatch.from_pydict({"piece": list(seen), "n": list(seen.values())}, schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    counts = docs.select(whole(text).alias("t")).sample(share, seed=7).mapInArrow(count, "piece string, n long")
    top = counts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()
    pieces = [r["piece"] for r in top]
    return dict(zip(pieces, lengths(processor(model), pieces))) if pieces else {}


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Counts are those of the whole text as the library gives them, without begin or end
    tokens; special strings inside a text are ordinary text. A null or empty text has 0
    bytes and 0 tokens. Rows with a repeated or null key are counted row by row; other
    columns are ignored. ``model`` is a path that every worker can open.
    """
    check_cuts(processor(model))
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, model))
    own = docs.select(F.col(key), whole(text).alias("_text"))
    schema = T.StructType([own.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _workers:
            _workers[model] = processor(model), {}
        sp, cache = _workers[model]
        first = known.value
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1).to_pylist():
                pieces = pre_tokens(value)
                found = [first.get(p) or cache.get(p) for p in pieces]
                if None in found:
                    missing = list({p for p, n in zip(pieces, found) if n is None})
                    new = dict(zip(missing, lengths(sp, missing)))
                    found = [new[p] if n is None else n for p, n in zip(pieces, found)]
                    if len(cache) > CACHE:
                        cache.clear()
                    cache.update((p, n) for p, n in new.items() if len(p) <= LONGEST)
                n_bytes.append(len(value.encode()))
                n_tokens.append(sum(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    return own.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
