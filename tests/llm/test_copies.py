"""Exact groups, SimHash groups, fingerprints."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridsmith.llm import blocks, exact, fingerprints, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_groups(rows, pick=max):
    ids = defaultdict(list)
    for r in rows:
        ids[(r.text or "").translate(LOWER)].append(r.doc_id)
    out = []
    for r in rows:
        norm = (r.text or "").translate(LOWER)
        known = [i for i in ids[norm] if i is not None]
        keep = pick(known) if known else None
        out.append((r.doc_id, keep, len(ids[norm]), r.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("one")])
def test_exact_groups_and_clashing_digests(odd, docs, digest):
    for table in (odd, docs):
        got = exact.classes(table, digest=digest, keep=F.max).collect()
        assert sorted(map(tuple, got), key=str) == expected_groups(table.collect())


def test_exact_kept_rows(odd, none):
    kept = exact.first_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 6, 8, 9, 10]
    assert exact.classes(none).count() == 0 and exact.first_copies(none).count() == 0


def slow_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def components(prints, radius):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    label = np.arange(len(prints))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("radius", [3, 8])
def test_simhash_groups(docs, radius):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    prints = np.array([slow_print(r.text) for r in rows], dtype=np.uint64)
    label = components(prints, radius)
    want = {(r.doc_id, f"{int(p):016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, label)}
    assert set(map(tuple, simhash.groups(docs, radius=radius).collect())) == want


def test_simhash_odd(odd, none):
    got = {}
    for r in simhash.groups(odd).collect():
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert {got[i].copy().pop()[1] for i in (1, 2, 3)} == {1} and got[1] == {("0" * 16, 1)}
    assert got[7].copy().pop()[1] == 6 and got[None].copy().pop()[1] is None
    assert got[5].copy().pop()[0] == f"{slow_print(odd.where('doc_id = 5').first().text):016x}"
    assert simhash.representatives(odd).columns == odd.columns
    assert simhash.groups(none).count() == 0


def test_trees_in_a_crowded_shard_and_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 900), dtype=np.uint64), axis=0)
    prints = np.unique(np.concatenate([np.uint64(0xABCDEF0123456789) ^ flips, rng.integers(0, 2**63, 300, dtype=np.uint64)]))
    monkeypatch.setattr(simhash, "PIECE", 100)
    monkeypatch.setattr(simhash, "FRONT", 5_000)
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    links = simhash.links(table, 3).collect()
    assert all((r.x ^ r.y).bit_count() <= 64 for r in links)
    parent = {int(p): int(p) for p in prints.view(np.int64)}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in links:
        a, b = root(r.x), root(r.y)
        parent[max(a, b)] = min(a, b)
    label = components(prints, 3)
    groups = defaultdict(set)
    for p, c in zip(prints.view(np.int64), label):
        groups[c].add(root(int(p)))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({root(int(p)) for p in prints.view(np.int64)})


@pytest.mark.parametrize("total", [10, 10**5, 10**10])
@pytest.mark.parametrize("radius", [1, 3, 6])
def test_near_prints_share_a_mask(total, radius):
    rng = np.random.default_rng(1)
    masks = [np.uint64(m) for m in blocks.layout(total, radius)]
    for _ in range(300):
        apart = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, radius, dtype=np.uint64))
        assert any(apart & m == 0 for m in masks)


def vote(text):
    words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], dtype=np.uint64)
    weight = np.array([min(len(w), 12) for w in words])
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b) & np.uint64(1)).astype(int) * weight).sum()) > weight.sum())


def test_fingerprints_of_edits(docs, odd, none):
    for table in (docs, odd.where("doc_id <> 6")):
        rows = sorted(table.collect(), key=lambda r: -r.doc_id)
        prints = [vote(r.text) for r in rows]
        want = set()
        for i, r in enumerate(rows):
            j = (i + 1) % len(rows)
            text, after = r.text or "", rows[j].text or ""
            cut = len(text) // 3
            edited = text[: len(text) - cut] + after[:cut]
            near = sum((prints[i] ^ p).bit_count() <= 3 for p in prints) - 1 if r.doc_id % 50 == 0 else None
            want.add((
                r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[i]:016x}", f"{vote(edited):016x}",
                1 - (prints[i] ^ vote(edited)).bit_count() / 64, 1 - (prints[i] ^ prints[j]).bit_count() / 64, near,
            ))
        got = fingerprints.fingerprint_edits(table, asked=F.col("doc_id") % 50 == 0).collect()
        assert len(got) == len(rows) and set(map(tuple, got)) == want
    assert fingerprints.fingerprint_edits(odd).count() == odd.count()
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_ranges_follow_each_other(docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 17)
    rows = docs.select(F.col("doc_id").alias("row"), "n_chars")
    got = {r.row: r.next_row for r in fingerprints.successors(rows, [F.desc("row")], "row", ["n_chars"]).collect()}
    ids = sorted(got, reverse=True)
    assert got == {a: b for a, b in zip(ids, ids[1:] + ids[:1])}


def test_block_search_finds_every_near_print(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 200)
    prints = sorted({int(b) ^ int(f) for b in base for f in (0, 1, 6 << 20, 7 << 40, 15 << 7)})
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    asked = table.where("fp % 5 = 0")
    want = {(a, b) for a in prints for b in prints if int(np.fmod(a, 5)) == 0 and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [tuple(r) for r in fingerprints.search(table, asked, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
