"""Token counts, sampled segmentations."""

import hashlib
import math
from collections import Counter

import pytest

from gridsmith.llm import pieces, queries, token_counts

MODEL = queries.piece_model()
SP = token_counts.processor(MODEL)


def test_counts_are_the_library_s(odd, docs, none):
    for table in (odd, docs):
        texts = [(r.doc_id, r.text or "") for r in table.collect()]
        want = Counter((i, len(t.encode()), len(SP.encode(t)), len(SP.encode(t)) > 4096) for i, t in texts)
        assert Counter(map(tuple, token_counts.count_tokens(table, MODEL).collect())) == want
    assert token_counts.count_tokens(none, MODEL).count() == 0


@pytest.mark.parametrize("text", ["", " ", "   ", "\n", " \n x", "a  b\t\tc ", "▁a▁ b", "<s></s><unk><0x0A>", "x\x00y", "é世😀\r\n", "  lead", "tail  ", "　wide\xa0"])
def test_cut_lengths(text):
    found = token_counts.pre_tokens(text)
    assert sum(token_counts.lengths(SP, found)) if found else 0 == len(SP.encode(text))
    assert (sum(token_counts.lengths(SP, found)) if found else 0) == len(SP.encode(text))


def test_small_caches_change_nothing(docs, monkeypatch):
    want = sorted(map(tuple, token_counts.count_tokens(docs, MODEL).collect()))
    for name, value in {"FREQUENT": 10, "CACHE": 5, "SAMPLE_DOCS": 3}.items():
        monkeypatch.setattr(token_counts, name, value)
    assert sorted(map(tuple, token_counts.count_tokens(docs, MODEL).collect())) == want


def every(lattice, at=None):
    at = lattice.size if at is None else at
    if not at:
        yield (), b"", 1.0
        return
    for p, begin, ids, _ in lattice.edges[at]:
        for path, own, q in every(lattice, begin):
            yield (begin, *path), own + ids, p * q


def test_draws_without_replacement_have_the_right_shares():
    known = pieces.vocabulary(MODEL, 0.3)
    chain = [pieces.Lattice(" ab", *known), pieces.Lattice(" to", *known)]
    full = {a + b: p * q for _, a, p in every(chain[0]) for _, b, q in every(chain[1])}
    assert sum(full.values()) == pytest.approx(1)
    n, first, both = 6_000, Counter(), Counter()
    for seed in range(n):
        drawn = pieces.sample(chain, 2, seed)
        assert drawn[0][0] >= drawn[1][0] >= drawn[2][0] and drawn[0][2] != drawn[1][2]
        assert drawn[0][1] == pytest.approx(math.log(full[drawn[0][2]]))
        first[drawn[0][2]] += 1
        both[drawn[0][2], drawn[1][2]] += 1
    top = sorted(full, key=full.get, reverse=True)[:3]
    for x in top:
        assert first[x] / n == pytest.approx(full[x], abs=4 * math.sqrt(full[x] / n))
        for y in top:
            p = full[x] * full[y] / (1 - full[x])
            if x != y:
                assert both[x, y] / n == pytest.approx(p, abs=4 * math.sqrt(p / n))


def test_all_segmentations_come_out_once():
    known = pieces.vocabulary(MODEL, 1.0)
    chain = [pieces.Lattice(" ab", *known), pieces.Lattice(" to", *known)]
    count = len(list(every(chain[0]))) * len(list(every(chain[1])))
    drawn = pieces.sample(chain, count + 5, 1)
    assert len(drawn) == len({x[2] for x in drawn}) == count


def test_samples_decode_and_repeat(odd, none):
    table = odd.where("doc_id is null or doc_id <> 5")
    drawn = pieces.encode_samples(table, MODEL, ["doc_id", "source"], samples=4, power=0.5)
    rows = pieces.decode(drawn, MODEL).collect()
    texts = {(r.doc_id, r.source): r.text or "" for r in table.collect()}
    assert all(r.decoded == texts[r.doc_id, r.source] for r in rows)
    assert {(r.n_pieces, r.inclusion, r.rank) for r in rows if r.doc_id in (1, 2)} == {(0, 0.0, 1)}
    again = drawn.repartition(5).collect()
    assert Counter((r.doc_id, r.rank, bytes(r.ids)) for r in again) == Counter((r.doc_id, r.rank, bytes(r.ids)) for r in rows)
    apart = Counter((r.doc_id, bytes(r.ids)) for r in rows if r.doc_id != 6)
    assert max(apart.values()) == 1 and all(r.inclusion <= 0 and r.log_prob <= 1e-9 for r in rows)
    assert pieces.encode_samples(none, MODEL, ["doc_id"]).count() == 0


def test_long_pre_tokens():
    known = pieces.vocabulary(MODEL, 1.0)
    for text, count in (("a" * 3_000, 3), ("ab" * 2_000, 3), ("😀" * 500, 1), (" " * 700, 3)):
        drawn = pieces.sample([pieces.Lattice(p, *known) for p in token_counts.pre_tokens(text)], 3, 5)
        assert len({x[2] for x in drawn[:3]}) == len(drawn[:3]) == count


def test_query_samples_every_document(spark, docs, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_BYTES", 20_000)
    got = queries.op6_piece_sampling(spark, "/root/testdata/sf0.001").collect()
    want = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in got} == want
    assert all(r.decoded_sha256 == want[r.doc_id] for r in got) and len({(r.doc_id, r.rank) for r in got}) == len(got)


def edges_of(store, piece):
    base, size, start, numbers, links = store.arrays
    i = store.of[piece]
    out = []
    for end in range(1, size[i] + 1):
        e, found = start[base[i] + end], []
        while not found or numbers[e - 1, 0] < 2.0:
            found.append((links[e, 0] - base[i], store.ids[links[e, 1]], numbers[e, 1], numbers[e, 2]))
            assert not found[1:] or numbers[e - 1, 0] <= numbers[e, 0]
            e += 1
        out.append(sorted(found))
    return out


@pytest.mark.parametrize("power", [0.3, 1.0, 2.0])
def test_array_lattices_are_the_plain_ones(docs, power):
    known = pieces.vocabulary(MODEL, power)
    store = pieces.Lattices(*known)
    words = {p for r in docs.limit(60).collect() for p in token_counts.pre_tokens(r.text or "")}
    words = sorted(words)[:1_500] + [" é世😀x", "\n\n", "   ", "a" * 2_000, "ab" * 300, "😀" * 200, "\x00"]
    store.add(words[:700])
    store.add(words[700:])
    store.ready()
    for p in words:
        plain = pieces.Lattice(p, *known)
        for got, want in zip(edges_of(store, p), plain.edges[1:], strict=True):
            want = sorted((b, ids, share, other) for share, b, ids, other in want)
            assert [x[:2] for x in got] == [x[:2] for x in want]
            for x, y in zip(got, want):
                assert x[2] == pytest.approx(y[2], rel=1e-9) and x[3] == pytest.approx(y[3], rel=1e-9, abs=1e-300)


def test_array_draws_have_the_right_shares():
    known = pieces.vocabulary(MODEL, 0.3)
    store = pieces.Lattices(*known)
    text = [" ab", " to", " ab"]
    store.add([" ab", " to"])
    store.ready()
    parts = [pieces.Lattice(p, *known) for p in text]
    full = {a + b + c: p * q * r for _, a, p in every(parts[0]) for _, b, q in every(parts[1]) for _, c, r in every(parts[2])}
    n, first, both = 6_000, Counter(), Counter()
    for seed in range(n):
        drawn = pieces.sample(store.chain(text), 2, seed)
        assert drawn[0][0] >= drawn[1][0] >= drawn[2][0] and drawn[0][2] != drawn[1][2]
        assert drawn[0][1] == pytest.approx(math.log(full[drawn[0][2]])) and drawn[1][1] == pytest.approx(math.log(full[drawn[1][2]]))
        first[drawn[0][2]] += 1
        both[drawn[0][2], drawn[1][2]] += 1
    for x in sorted(full, key=full.get, reverse=True)[:3]:
        assert first[x] / n == pytest.approx(full[x], abs=4 * math.sqrt(full[x] / n))
        for y in sorted(full, key=full.get, reverse=True)[:3]:
            p = full[x] * full[y] / (1 - full[x])
            if x != y:
                assert both[x, y] / n == pytest.approx(p, abs=4 * math.sqrt(p / n))
    count = len(full)
    drawn = pieces.sample(store.chain(text), count + 5, 1)
    assert len(drawn) == len({x[2] for x in drawn}) == count
