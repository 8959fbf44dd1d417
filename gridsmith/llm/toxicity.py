"""Toxicity scores from averaged subword vectors and a linear softmax.

Every word has a bag of subwords: its character n-grams between word marks, the word
itself, and the word with one character left out, which a misspelling shares. A bag of
text averages the vectors of all its subwords; a linear softmax on that average gives
the class shares. Vectors and softmax are trained jointly, in numpy, on a bounded sample
of labelled documents. A document is cut into windows of ``window`` words, each a bag of
its distinct words, and scored by its most toxic window, so a few words weigh the same
in a short and in a very long text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import residue, whole

#: Labelled documents used for fitting: at most so many of each class.
MAX_PER_CLASS = 1_500
#: Longest document, in characters, that is used for fitting; all are scored whole.
MAX_CHARS = 500_000
#: Documents with this score or more are toxic.
THRESHOLD = 0.3
#: Words are runs of letters and digits, without the marks around them.
WORD = re.compile(r"[^\W_]+")
#: Texts scored in one go.
BATCH = 400


@dataclass(frozen=True)
class Shape:
    """Sizes and training settings of the model. ``floor`` is added to the number of
    subwords of a bag, so that a bag of one odd word is not scored on that word alone."""

    buckets: int = 1 << 18
    size: int = 8
    grams: tuple[int, int] = (3, 5)
    near: tuple[int, int] = (4, 20)
    window: int = 8
    floor: int = 60
    rounds: int = 80
    warm: int = 20
    rate: float = 0.2
    decay: float = 1e-5
    positive: float = 1.5
    seed: int = 11


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def subwords(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every subword of every word.

    A subword's hash is a polynomial in its code points, taken from running sums over
    all words at once.
    """
    chars = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    begin = end - size
    word = np.repeat(np.arange(len(words), dtype=np.int32), size)
    steps = np.full(len(chars) + 2, _BASE, np.uint64)
    steps[0] = 1
    back = np.full(len(chars) + 2, _BACK, np.uint64)
    back[0] = 1
    power, back = np.cumprod(steps), np.cumprod(back)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * power[: len(chars)])])
    at = np.arange(len(chars))
    found = [(np.arange(len(words)), (run[end] - run[begin]) * back[begin])]
    for n in range(shape.grams[0], shape.grams[1] + 1):
        i = at[: max(0, len(chars) - n + 1)]
        i = i[i + n <= end[word[i]]]
        found.append((word[i], (run[i + n] - run[i]) * back[i] + np.uint64(n)))
    inner = (at > begin[word]) & (at < end[word] - 1) & (size[word] - 2 >= shape.near[0]) & (size[word] - 2 <= shape.near[1])
    i, w = at[inner], word[inner]
    found.append((w, (run[i] - run[begin[w]]) * back[begin[w]] + (run[end[w]] - run[i + 1]) * back[begin[w] + 1]))
    mixed = np.concatenate([h for _, h in found])
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.concatenate([w for w, _ in found]).astype(np.int32), (mixed % np.uint64(shape.buckets)).astype(np.int32)


@dataclass
class Bags:
    """Distinct words of the windows of some texts: ``token`` in ``bag``, ``bag`` of ``doc``."""

    words: list[str]
    token: np.ndarray
    bag: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, texts: list[str], window: int) -> Bags:
        index: dict[str, int] = {}
        tokens = [np.array([index.setdefault(w, len(index)) for w in WORD.findall(t.lower())] or [index.setdefault("", len(index))]) for t in texts]
        sizes = np.array([len(t) for t in tokens])
        bags = -(-sizes // window)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bag = np.repeat(np.cumsum(bags) - bags, sizes) + inside // window
        pairs = np.unique(bag * len(index) + np.concatenate(tokens))
        return cls(list(index), pairs % len(index), pairs // len(index), np.repeat(np.arange(len(texts)), bags))


@dataclass
class Model:
    """``pull``: each subword's vector times the softmax difference; ``bias``: the rest."""

    shape: Shape
    pull: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Share of the toxic class per text; an empty text is one empty window."""
        if not texts:
            return np.zeros(0)
        bags = Bags.of(texts, self.shape.window)
        word, gram = subwords(bags.words, self.shape)
        sums = np.bincount(word, weights=self.pull[gram])[bags.token]
        sizes = np.bincount(word)[bags.token]
        logit = np.bincount(bags.bag, weights=sums) / (np.bincount(bags.bag, weights=sizes) + self.shape.floor)
        begins = np.concatenate([[0], np.flatnonzero(np.diff(bags.doc)) + 1])
        return 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(logit, begins) + self.bias, -40, 40)))


def train(texts: list[str], labels: list[int], shape: Shape = Shape()) -> Model:
    """Joint descent on the vectors and the softmax over all windows of ``texts``.

    The first ``warm`` rounds spread a document's error over its windows, the others
    put it on the most toxic one. Without both classes every text scores 1 or 0.
    """
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        return Model(shape, np.zeros(shape.buckets, np.float32), 40.0 if len(y) and y[0] else -40.0)
    bags = Bags.of(texts, shape.window)
    word, gram = subwords(bags.words, shape)
    sizes = np.bincount(word)
    norm = 1 / (np.bincount(bags.bag, weights=sizes[bags.token]) + shape.floor)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(bags.doc)) + 1])
    per_doc = np.bincount(bags.doc)
    weight = np.where(y == 1, shape.positive, y.sum() / (len(y) - y.sum()))
    rng = np.random.default_rng(shape.seed)
    vectors = rng.normal(0, 0.1, (shape.buckets, shape.size))
    softmax = np.array([-0.5, 0.5])[:, None] * rng.normal(0, 1, shape.size)
    bias = np.zeros(2)
    side = np.array([-1.0, 1.0])
    means = [np.zeros_like(a) for a in (vectors, softmax, bias)]
    squares = [np.zeros_like(a) for a in (vectors, softmax, bias)]
    for step in range(1, shape.rounds + 1):
        axis = softmax[1] - softmax[0]
        pull = vectors @ axis
        of_word = np.bincount(word, weights=pull[gram])
        logit = np.bincount(bags.bag, weights=of_word[bags.token]) * norm
        if step <= shape.warm:
            share = 1 / per_doc[bags.doc]
        else:
            share = (logit == np.maximum.reduceat(logit, begins)[bags.doc]).astype(float)
            share /= np.add.reduceat(share, begins)[bags.doc]
        z = np.add.reduceat(logit * share, begins) + bias[1] - bias[0]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / weight.sum()
        on_bag = error[bags.doc] * share * norm
        on_word = np.bincount(bags.token, weights=on_bag[bags.bag], minlength=len(sizes))
        on_gram = np.bincount(gram, weights=on_word[word], minlength=shape.buckets)
        slopes = (np.outer(on_gram, axis) + shape.decay * vectors, side[:, None] * (vectors.T @ on_gram), side * error.sum())
        for k, (value, slope) in enumerate(zip((vectors, softmax, bias), slopes)):
            means[k] += 0.1 * (slope - means[k])
            squares[k] += 0.01 * (slope**2 - squares[k])
            value -= shape.rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-9)
    return Model(shape, (vectors @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_per_class: int = MAX_PER_CLASS, shape: Shape = Shape()) -> Model:
    """Train on at most ``max_per_class`` labelled documents of each class, chosen by a
    hash of the key, in one task that holds the chosen documents; longer ones than
    ``MAX_CHARS`` are not fitted on. Rows without key or label are no labels; a key labelled
    twice counts with its largest label, a key of several documents with its smallest text.
    The label table is read whole; only the model reaches the driver."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    marked = marked.groupBy(F.col(key).alias("_marked")).agg(F.max(F.when(F.col(label) != 0, 1).otherwise(0)).alias("_label"))
    chosen = None
    for value in (0, 1):
        part = marked.where(F.col("_label") == value).orderBy(F.xxhash64(F.col("_marked")), "_marked").limit(max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    own = docs.select(F.col(key).alias("_key"), whole(text).alias("_text")).where(F.length("_text") <= MAX_CHARS)
    rows = own.join(F.broadcast(chosen), F.col("_key") == F.col("_marked"))
    # one text a key, combined before the shuffle, however many rows repeat it
    rows = rows.groupBy("_key").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label")).select(F.lit(0).alias("_one"), "_key", "_text", "_label")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "_text"])
        model = train(pdf["_text"].tolist(), pdf["_label"].tolist(), shape)
        return pd.DataFrame({"pull": [model.pull.tobytes()], "bias": [model.bias]})

    found = rows.groupBy("_one").applyInPandas(learn, "pull binary, bias double").collect()
    return Model(shape, np.frombuffer(found[0]["pull"], np.float32), found[0]["bias"]) if found else train([], [], shape)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Column with the score of the whole text; a null text counts as empty."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.tolist()
            parts = [known.value.score(values[i : i + BATCH]) for i in range(0, len(values), BATCH)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scores(whole(text))


def trainable(labels: DataFrame, key: str = "doc_id", modulus: int = 4, held: int = 2) -> DataFrame:
    """Labels whose key's residue is not the held-out one."""
    return labels.where(residue(key, modulus) != held)
