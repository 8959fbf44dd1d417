"""Near copies of the pipeline: five words, similarity 0.8 or more."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridsmith.llm import near


def brute(rows):
    """doc_ids that stay when rows are taken by doc_id and compared with all that stay."""
    stay = []
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        own = near.shingles(r.text or "")
        if not any(5 * len(own & s) >= 4 * len(own | s) for _, s in stay):
            stay.append((r.doc_id, own))
    return sorted((i for i, _ in stay), key=str)


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def copies(spark):
    """Copies around 0.8, chains of them, a large group, unlike texts with a common passage."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5_000)}"
    texts, passage = [], [word() for _ in range(30)]
    for _ in range(40):
        base = [word() for _ in range(rng.choice((20, 60, 300)))]
        texts += [edited(rng, base, n) for n in (0, 1, 2, len(base) // 60, len(base) // 45, len(base) // 30)]
        texts.append(" ".join(passage + base[:12]))
    chain = [word() for _ in range(200)]
    for _ in range(12):
        chain = edited(rng, chain, 3).split()
        texts.append(" ".join(chain))
    hot = [word() for _ in range(120)]
    texts += [edited(rng, hot, rng.randrange(3)) for _ in range(150)]
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("group, idle, part", [(64, 50, 1_000), (1, 10**9, 10)])
def test_near_copies_are_those_of_all_pairs(spark, docs, monkeypatch, group, idle, part):
    for name, value in {"GROUP": group, "IDLE": idle, "PART_ROWS": part}.items():
        monkeypatch.setattr(near, name, value)
    table = copies(spark)
    for rows in (table, docs.select("doc_id", "text")):
        got = corpus_pipeline.near_dedup(spark, rows.repartition(3), "").collect()
        assert sorted((r.doc_id for r in got), key=str) == brute(rows.collect())


def test_clean_documents_with_a_common_passage_stay(spark):
    words = [f"w{i}" for i in range(24)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:21] + ["a", "b", "c"])), (3, " ".join(words[:23] + ["a"]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, "").collect()) == [1, 2]


def test_odd_rows(odd, none):
    kept = near.first_near(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == brute(odd.collect())
    assert kept.where("doc_id = 6").count() == 1 and kept.where("doc_id in (2, 3, 7)").count() == 0
    assert near.first_near(none).count() == 0
    assert near.first_near(odd.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == kept.count()


def test_fingerprints_give_candidates(spark, monkeypatch):
    from gridsmith.llm import simhash

    seen, grown = [], near._linked

    def spy(live, texts, words, shelf):
        out = grown(live, texts, words, shelf)
        trees = simhash.groups(texts, "node", shingle=words).groupBy("component_id").count().where("count > 1")
        seen.append((out.where("at < 0").count(), trees.agg(F.sum("count")).first()[0], out.where("at >= 0").count() == live.count()))
        return out

    monkeypatch.setattr(near, "_linked", spy)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["a"]), " ".join(words[:-1] + ["b"]), " ".join(words[::-1])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, rows, "").collect()
    assert sorted(r.doc_id for r in got) == brute(rows.collect()) == [0, 3]
    assert len(seen) == 1 and seen[0][0] == seen[0][1] >= 2 and seen[0][2]
