"""Ranked search, vector codes and page text against plain loops."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridsmith.llm import page_text, queries, ranking, vector_codes

SF = "/root/testdata/sf0.001"

# -- ranked search -----------------------------------------------------------------------


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, k=10):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        asked, found = plain_terms(text), []
        for doc, bag, n in bags:
            m = 25 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1_000 * bag[t] + 8 * m)) for t in asked if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ranks_are_those_of_a_plain_loop(spark, odd, docs, monkeypatch, small):
    if small:
        for name, value in {"BLOCK_ITEMS": 3, "TILE_DOCS": 7, "HELD": 20, "BAG_BYTES": 500}.items():
            monkeypatch.setattr(ranking, name, value)
    asked = [(1, "the old stone bridges"), (2, None), (2, "Quick FOX quick fox w1"), (None, "straße 世界"), (4, "--- ..."), (5, "tea " * 40 + "x")]
    items = spark.createDataFrame(asked, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS item")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ranking.search(odd.repartition(3), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_search(rows, asked))
    if not small:
        bench = spark.read.parquet(f"{SF}/benchmark.parquet")
        want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
        assert sorted(map(tuple, ranking.search(docs, bench).collect())) == sorted(want)


def test_ties_and_empty_tables(spark, odd, none):
    copies = spark.range(1_100).selectExpr("id AS doc_id", "case when id = 7 then 'needle needle' when id < 500 then 'needle in hay' else 'straw' end AS text")
    items = spark.createDataFrame([(0, "needle"), (1, "hay needle")], "item_id int, text string")
    got = {(r.item_id, r["rank"]): r.doc_id for r in ranking.search(copies.repartition(5), items).collect()}
    assert [got[0, i] for i in range(1, 11)] == [7, 0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert [got[1, i] for i in range(1, 11)] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert ranking.search(none, items).count() == 0
    assert ranking.search(copies, items.where("item_id < 0")).count() == 0


def test_tiles_hold_all_weights_within_the_bound():
    rng = np.random.default_rng(0)
    weights = rng.integers(0, 50, (40, 5))
    weights[3, 2] = 1_000
    parts = ranking.tiles(weights, limit=120, wide=9)
    total = np.zeros(weights.shape)
    for own, held in parts:
        assert len(own) <= 9 and held.sum(axis=0).max() <= 120
        np.add.at(total, own, held)
    assert (total == weights).all()
    # at the largest weights and impacts a product stays below 2^53
    assert ranking.WEIGHTS * ranking.IMPACT < 2**53
    assert ranking.impacts(np.array([10**12]), np.array([25])).max() < ranking.IMPACT


# -- vector codes ------------------------------------------------------------------------


def plain_codes(rows, parts=16, rounds=2):
    """As the contract says, in Python integers."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v in good), default=0) // parts))
    good = sorted(((i, v + [0] * (width * parts - len(v))) for i, v in good), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[v[p * width : (p + 1) * width] for _, v in good[:64]] for p in range(parts)]

    def assign(v):
        out = []
        for p, book in enumerate(books):
            own = v[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(own, e)), i) for i, e in enumerate(book)))
        return out

    for _ in range(rounds if good else 0):
        found = [assign(v) for _, v in good]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for (_, v), a in zip(good, found) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a)) for i, a in ((i, assign(v)) for i, v in good)], sha


def test_codes_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=32).round(2).tolist(), int(rng.integers(3))) for i in range(150)]
    data += [(900, None, 1), (901, [], None), (902, [None] * 32, 1), (903, [float("nan")] * 32, 1), (904, [float("inf")] * 32, 2), (None, [0.5] * 32, None), (5, data[7][1], 0), (5, data[7][1], 0), (-1, [1.0] * 20, 9)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").selectExpr("*", "'c' AS code", "1 AS error", "'k' AS _key", "2 AS _name")
    got = vector_codes.compress(table.repartition(4))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, sha = plain_codes([(i, v) for i, v, _ in data])
    rows = got.collect()
    assert Counter((r.vec_id, r.code, r.error) for r in rows) == Counter(want) and {r.codebooks_sha256 for r in rows} == {sha}
    errors, label = Counter(), {}
    for (i, v, name) in data:
        label.setdefault(i, name)
    for i, _, e in want:
        errors[label[i]] += e
    assert all(r.label_error == errors[label[r.vec_id]] for r in rows)
    assert vector_codes.compress(table.where("vec_id = 900")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_slices_find_the_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    spread = [1, 3, 50, 1_000, 2**25, 7][seed]
    entries = rng.integers(-spread, spread + 1, (int(rng.integers(1, 65)), int(rng.integers(1, 6))))
    rows = np.concatenate([rng.integers(-3 * spread, 3 * spread + 1, (400, entries.shape[1])), entries])
    index, error = vector_codes.Slices(entries).nearest(rows)
    far = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def test_scaling():
    got = vector_codes.scaled(pa.array([[0.5, -0.001], [], None, [1e30]], pa.list_(pa.float32())), 2)
    assert got.tolist() == [[128, -1], [0, 0], [0, 0], [vector_codes.LARGEST, 0]]


# -- page text ---------------------------------------------------------------------------


def texts(html):
    return page_text.kept(page_text.lines(html), b"")[0]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []),
        ("plain text &amp; more", ["plain text & more"]),
        ("<p>a<b>b</b>c<br>d\n\t e&nbsp;f<p>g", ["abc d e f", "g"]),
        ("<nav><ul><li>menu</ul></nav><article><h1>T</h1><p>x</article><footer>f</footer>", ["T", "x"]),
        ("<article><header><h1>T</h1></header><p>x<div class='share-buttons'>no</div><footer>tags</footer></article>", ["T", "x"]),
        ("<article><p>x</p><section id=comments><article class='comment'><p>bad</article></section></article>", ["x"]),
        ("<form><main><p>in a form</p></main><input value='>'></form>", ["in a form"]),
        ("<nav>menu<article><p>unclosed menu</p></article>", ["unclosed menu"]),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><!-- open", ["yes"]),
        ("<p title='a>b'>quoted</p><div class=\"x", ["quoted"]),
        ("<div hidden>no</div><div style='display: none'>no</div><p class=ad>no<p>yes<ul><li class=ad>no<li>yes too</ul>", ["yes", "yes too"]),
        ("<p>1 < 2 &lt; 3 &#x4e16; &copy &am</p>", ["1 < 2 < 3 世 © &am"]),
        ("<body class='no-sidebar'><p>body</p><p><a href=x>only links here</a></p></body>", ["body"]),
        ("<table><tr><td>a<td>b</table>", ["a", "b"]),
        ("<p>" + "long " * 50_000 + "</p>", [("long " * 50_000).strip()]),
        ("</div></p>stray<p>", ["stray"]),
    ],
)
def test_lines_of_markup(html, want):
    assert texts(html) == want


def page(body, site="Site menu", foot="All rights of the site"):
    return f"<html><body><div>{site}</div><div>Latest news</div><div>{body}</div><div>{foot}</div></body></html>"


def test_shared_lines_go_and_unmarked_articles_stay(spark):
    rows = [(i, f"http://a.org/news/{i:03}", page(f"<p>story {i}<p>end {i}</p>")) for i in range(6)]
    rows += [(10, "http://b.org/x", page("<p>alone")), (11, None, None), (12, "no host", "<p>bare"), (13, "http://c.org/1", page("<p>one of two")), (14, "http://c.org/2", page("<p>two of two"))]
    rows += [(100 + i, "http://a.org/news/002?copy", rows[2][2]) for i in range(40)]  # copies do not hide the site
    rows += [(200, "http://a.org/news/002b", page("<p>story 2<p>end 2</p><p>edited"))]  # nor does a near copy take the text
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'n' AS name", "'h' AS host", "'t' AS text", "0 AS weight", "1 AS mask")
    for parts in (1, 5):
        got = page_text.extract(table.repartition(parts))
        assert got.columns == ["page_id", "url", "text", "n_chars", "n_site_lines"]
        got = {r.page_id: (r.text, r.n_site_lines) for r in got.collect() if len(r.text) == r.n_chars}
        assert len(got) == len(rows)
        assert [got[i] for i in (0, 1, 3, 5)] == [(f"story {i}\nend {i}", 3) for i in (0, 1, 3, 5)]
        assert {got[i] for i in [2, *range(100, 140)]} == {("story 2\nend 2", 3)} and got[200] == ("story 2\nend 2\nedited", 3)
        assert got[10][0] == "Site menu\nLatest news\nalone\nAll rights of the site" and got[11] == ("", 0) and got[12] == ("bare", 0)
        assert (got[13], got[14]) == (("one of two", 3), ("two of two", 3))
    assert page_text.extract(table.where("page_id < 0")).count() == 0


def test_shared_passages_of_articles_stay(spark):
    rows = [(i, f"http://a.org/{i}", f"<nav>menu</nav><article><p>common passage<p>own {i}</article>") for i in range(5)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"common passage\nown {i}" for i in range(5)} and {r.n_site_lines for r in got} == {1}


def longest(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


@pytest.mark.parametrize("bits", [1 << 27, 4])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(page_text, "ALIGN_BITS", bits)
    rng = np.random.default_rng(bits % 7)
    for _ in range(200):
        a, b = (rng.integers(0, 6, int(rng.integers(0, 14))).tolist() for _ in range(2))
        found = page_text.shared(a, b)
        assert len(found) == longest(a, b) == longest([a[i] for i in found], b) and found == sorted(set(found))


@pytest.mark.parametrize("url, want", [("HTTP://U:p@Ex.org:80/a/b?q#f", ("ex.org:80", "/a/b")), ("//x.org", ("x.org", "")), ("", ("", "")), ("mailto:x", ("mailto:x", "")), ("ftp://y/z", ("y", "/z"))])
def test_places(url, want):
    assert page_text.place(url) == want


def test_new_queries_have_sql():
    assert {"op11_ranked_search", "op12_page_text", "op13_vector_codes"} <= set(queries.SQL)
