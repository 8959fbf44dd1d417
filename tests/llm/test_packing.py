"""Best-fit packing."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridsmith.llm import packing


def words(text):
    return len((text or "").encode().split())


def check_bins(docs, rows, capacity):
    info = defaultdict(list)
    for r in docs.collect():
        info[r.doc_id].append((words(r.text), r.source, (r.text or "").lower()))
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.bin_id].append(r)
    assert set(pieces) == set(info)
    for key, own in pieces.items():
        copies = len(info[key])
        size = info[key][0][0]
        assert sum(p.n_words for p in own) == copies * size
        assert Counter(p.piece for p in own) == Counter({k: copies for k in range(max(1, -(-size // capacity)))})
        assert all(p.begin == p.piece * capacity for p in own)
    for own in bins.values():
        assert sum(p.n_words for p in own) == own[0].bin_words <= capacity and len({p.bin_words for p in own}) == 1
        sources = [info[p.doc_id][0][1] for p in own if info[p.doc_id][0][1] is not None]
        assert len(sources) == len(set(sources))
        texts = [info[p.doc_id][0][2] for p in own]
        assert len(texts) == len(set(texts))


@pytest.mark.parametrize("capacity", [300, 4096])
def test_bins_hold_and_lots_are_whole(docs, capacity):
    for lot in (50, 4_000):
        check_bins(docs, packing.pack(docs, capacity=capacity, lot_docs=lot).collect(), capacity)


def test_odd(odd, none):
    rows = packing.pack(odd, capacity=1_000).collect()
    assert Counter(r.doc_id for r in rows)[1] == 1 and Counter(r.doc_id for r in rows)[6] == 2
    check_bins(odd, rows, 1_000)
    assert packing.pack(none).count() == 0


def brute(items, capacity):
    """Tightest compatible bin by looking at all of them."""
    bins = []
    out = []
    for size, source, cluster in items:
        fit = [(capacity - b["size"], i) for i, b in enumerate(bins) if capacity - b["size"] >= size and source not in b["s"] and cluster not in b["c"]]
        if fit:
            i = min(fit)[1]
        else:
            bins.append({"size": 0, "s": set(), "c": set()})
            i = len(bins) - 1
        bins[i]["size"] += size
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
        out.append(i)
    return out


def test_tightest_compatible_bin():
    import random

    rng = random.Random(4)
    items = sorted(((rng.randint(0, 60), rng.randint(0, 4) if rng.random() < 0.6 else 0, rng.randint(0, 50)) for _ in range(600)), reverse=True)
    bins = packing.Bins(100)
    assert [bins.place(size, 1 << source, 1 << cluster) for size, source, cluster in items] == brute(items, 100)


def test_row_order_and_partitions_do_not_matter(docs):
    a = packing.pack(docs, lot_docs=60).collect()
    b = packing.pack(docs.repartition(7).orderBy(F.rand(3)), lot_docs=60).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_repeated_rows_are_dealt_over_the_lots(spark):
    """A third of the rows repeats one key and text: no lot gets them all."""
    rows = [(7, "the same text", "s")] * 2_000 + [(None, None, None)] * 400 + [(10_000 + i, f"text number {i}", "a") for i in range(3_600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = packing.pack(docs, lot_docs=500).collect()
    assert len(got) == len(rows)
    lots = Counter(r.bin_id >> 24 for r in got if r.doc_id == 7)
    assert len(lots) == 12 and max(lots.values()) < 400
    assert max(Counter(r.bin_id for r in got if r.doc_id == 7).values()) == 1  # copies never share a bin
