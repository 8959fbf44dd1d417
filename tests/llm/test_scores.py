"""Katz scores, toxicity."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsmith.llm import katz, queries, toxicity
from gridsmith.llm.common import residue


def tokens(text):
    return [w.decode("utf-8") for w in (text or "").encode().lower().split()] + [""]


class Plain:
    """The model over dictionaries, evaluated token by token."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            own = tokens(t)
            self.words.update(own)
            self.pairs.update(zip([None, *own], own))
        self.total, self.d1, self.d2 = sum(self.words.values()), self.discount(self.words), self.discount(self.pairs)
        self.scale, self.left = self.share([c * self.d1(c) for c in self.words.values()], self.total)
        self.after = {}
        for (v, w), c in self.pairs.items():
            self.after.setdefault(v, {})[w] = c

    @staticmethod
    def discount(counts):
        n = Counter(counts.values())
        high = 6 * n[6] / n[1] if n[1] else 1

        def d(r):
            if r > 5:
                return 1.0
            x = ((r + 1) * n[r + 1] / (r * n[r]) - high) / (1 - high) if n[r] and high < 1 else 0
            return x if 0 < x < 1 else 1 - 0.5 / r

        return d

    @staticmethod
    def share(discounted, total):
        if not total:
            return 1.0, 1.0
        left = max(1 - sum(discounted) / total, 0.5 / (total + 1))
        return (1 - left) * total / sum(discounted), left

    def one(self, w):
        c = self.words[w]
        return self.scale * self.d1(c) * c / self.total if c else self.left

    def two(self, v, w):
        seen = self.after.get(v)
        if not seen:
            return self.one(w)
        total = sum(seen.values())
        scale, left = self.share([c * self.d2(c) for c in seen.values()], total)
        if w in seen:
            return scale * self.d2(seen[w]) * seen[w] / total
        return left / (1 - sum(map(self.one, seen))) * self.one(w)

    def score(self, text):
        own = tokens(text)
        return sum(math.log10(self.two(v, w)) for v, w in zip([None, *own], own))

    def base(self, text):
        return sum(math.log10((self.words[w] + 1) / (self.total + len(self.words) + 1)) for w in tokens(text))


@pytest.mark.parametrize("small", [False, True])
def test_katz_against_plain_model(docs, monkeypatch, small):
    if small:  # many blocks and buckets, every frequent word dealt by pairs
        for name, value in {"BLOCK_TOKENS": 3_000, "BUCKET_TOKENS": 9_000, "HOT_SHARE": 50}.items():
            monkeypatch.setattr(katz, name, value)
    table = docs.where("doc_id < 90")
    rows = table.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows}
    plain = Plain([r.text for r in rows if not held[r.doc_id]])
    got = {r.doc_id: r for r in katz.score(table, residue("doc_id", 7) == 2).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, own = got[r.doc_id], tokens(r.text)
        assert (g.held_out, g.n_tokens, g.train_tokens) == (held[r.doc_id], len(own), plain.total)
        assert g.n_known == sum(plain.words[w] > 0 for w in own)
        assert g.base_score == pytest.approx(plain.base(r.text), rel=1e-9)
        assert g.score == pytest.approx(plain.score(r.text), rel=1e-7)


def test_backoff_weights_normalise(docs):
    plain = Plain([r.text for r in docs.limit(40).collect()])
    for v in [None, *list(plain.words)[:40], "never seen"]:
        assert sum(plain.two(v, w) for w in [*plain.words, "never seen"]) == pytest.approx(1, abs=1e-9)
    model = katz.Words.of(len(plain.words), plain.total, [sum(c == r for c in plain.words.values()) for r in range(1, 7)])
    assert float((model.share(np.array(list(plain.words.values())))).sum() + model.unknown) == pytest.approx(1)


def test_katz_odd(odd, none):
    got = katz.score(odd, F.col("doc_id") == 9).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert sorted(r.n_tokens for r in got)[:3] == [1, 1, 1] and [r.held_out for r in got if r.doc_id == 9] == [True]
    assert katz.score(none, F.lit(False)).count() == 0
    untrained = katz.score(odd, F.lit(True)).first()
    assert untrained.score == 0 and untrained.base_score == 0 and untrained.n_known == 0
    assert katz.unpack(katz.pack(np.arange(7)), np.int64).tolist() == list(range(7))


@pytest.fixture(scope="module")
def toxic_rows(spark):
    return {r.doc_id: r for r in queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()}


def test_toxicity_on_held_out_labels(spark, toxic_rows):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(toxic_rows[x.doc_id].score, toxic_rows[x.doc_id].predicted, x.toxic) for x in labels if toxic_rows[x.doc_id].held_out]
    assert len(toxic_rows) == 10_000 and all(0 <= r.score <= 1 for r in toxic_rows.values())
    found = [p for _, p, t in held if t == 1]
    clean = [p for _, p, t in held if t == 0]
    # some labels of the table are noise
    assert sum(found) >= 0.88 * len(found) and sum(clean) <= 0.035 * len(clean)
    pairs = [(a > b) + 0.5 * (a == b) for a, _, t in held if t == 1 for b, _, u in held if u == 0]
    assert sum(pairs) / len(pairs) > 0.95


def test_toxicity_learns_subwords_and_long_texts():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(2, 9))) for _ in range(400)]
    bad = ["worthless", "disgusting", "pathetic"]
    plain = lambda n: [str(w) for w in rng.choice(words, n)]
    with_bad = lambda n, b: " ".join([*plain(n // 2), *b, *plain(n // 2)])
    texts = [" ".join(plain(80)) for _ in range(120)] + [with_bad(80, rng.choice(bad, 3)) for _ in range(60)]
    model = toxicity.train(texts, [0] * 120 + [1] * 60)
    clean, misspelt, long = model.score([" ".join(plain(100)), with_bad(100, ["worthles", "disgustting", "pathethic"]), with_bad(6_000, bad)])
    assert clean < 0.3 < min(misspelt, long)


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (6, 0), (6, 1), (9, 1), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    scored = odd.select("doc_id", toxicity.score(odd, model).alias("s")).collect()
    assert len(scored) == odd.count() and all(0 <= r.s <= 1 for r in scored)
    assert len({round(r.s, 12) for r in scored if r.doc_id in (1, 2, 3)}) == 1
    assert none.select(toxicity.score(none, model)).count() == 0
    nothing = toxicity.fit(none, labels)
    assert odd.select(toxicity.score(odd, nothing).alias("s")).agg(F.max("s")).first()[0] < 0.3


def test_a_labelled_key_that_repeats_counts_once(spark):
    rows = [(i, f"bad{i % 7} awful{i % 5} words here {i}" if i % 2 else f"calm{i % 7} gentle{i % 5} words here {i}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    hot = plain.unionByName(plain.where("doc_id = 3").crossJoin(spark.range(500)).select("doc_id", "text"))
    one, two = toxicity.fit(plain, labels), toxicity.fit(hot.repartition(5), labels)
    assert one.bias == two.bias and (one.pull == two.pull).all()


def plain_bags(text, window):
    found = toxicity.WORD.findall(text.lower()) or [""]
    return [set(found[i : i + window]) for i in range(0, len(found), window)]


def test_scores_are_those_of_a_plain_loop(docs):
    """Words of a window by their subwords, its mean pull, and the largest window of a text."""
    shape = toxicity.Shape()
    rng = np.random.default_rng(0)
    model = toxicity.Model(shape, rng.normal(size=shape.buckets).astype(np.float32), -0.2)
    texts = ["", "one", "Bad words, bad words! " * 9] + [(r.text or "") for r in docs.limit(25).collect()]
    got = model.score(texts)
    for text, score in zip(texts, got):
        logits = []
        for bag in plain_bags(text, shape.window):
            total = size = 0
            for word in bag:
                _, grams = toxicity.subwords([word], shape)
                total += sum(float(model.pull[g]) for g in grams)
                size += len(grams)
            logits.append(total / (size + shape.floor))
        assert score == pytest.approx(1 / (1 + np.exp(-(max(logits) + model.bias))), rel=1e-6)
