"""Archives, licences, the pipeline and registration."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gridsmith.llm import exact, licences, packing, queries, toxicity, warc
from gridsmith.llm.common import scratch, spread_join
from test_near import brute

SF = "/root/testdata/sf0.001"


# -- archives --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_pages(spark):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [
        (5, "http://a/1", body), (3, "http://a/2 b", body), (3, "http://a/2", body), (9, None, body), (None, "http://n/", body), (4, "http://e/", ""), (6, "http://e/", None),
        (7, "http://s/", "short"), (8, "http://s/", "short"), (10, "http://c/", "a\r\n\r\nWARC/1.1\r\nb\n\nfiledesc://x 1\n" * 9), (11, "http://u/", "é世😀\x00" * 60),
        (12, "http://long/", "long " * 900_000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS record", "'y' AS key", "'z' AS archive")


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(odd_pages, version, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 700)
    got = warc.round_trip(odd_pages, version=version).collect()
    payloads = [(r.page_id, (r.html or "").encode()) for r in odd_pages.collect()]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len(p), hashlib.sha256(p).hexdigest()) for i, p in payloads)
    again = [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"]
    assert sorted(again, key=str) == sorted([(5, 3), (3, 3), (9, 3), (None, 3)], key=str)
    assert {r.record_type for r in got} == {"response", "revisit"} and all(r.refers_to is None for r in got if r.record_type == "response")
    assert warc.round_trip(odd_pages.where("page_id = 0"), version=version).count() == 0


def test_written_archives_are_plain_files(spark, odd_pages, monkeypatch):
    import gzip

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 700)
    path = scratch(spark)
    warc.write_arc(odd_pages.where("page_id < 10").coalesce(1), path, "page_id", "url", "html")
    files = sorted(Path(path.removeprefix("file:")).rglob("*.gz"))
    assert len(files) > 1
    for f in files:
        content = gzip.decompress(f.read_bytes())
        assert content.startswith(b"filedesc://") and all(r["error"] is None for r in warc.parse_arc(content))


def test_arc_headers_by_version():
    one = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    block = b"HTTP/1.0 200 OK\nA: b\n\nbody\nwith lines\n\n"
    one += b"http://www.d.com:80/index.html 127.10.100.2 19961104142103 text/html %d\n" % len(block) + block
    one = one.replace(b" 76\n", b" %d\n" % len(b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n"))
    (r,) = warc.parse_arc(one)
    assert (r["version"], r["ip"], r["date"], r["mime"], r["status"], r["block"]) == (1, "127.10.100.2", "19961104142103", "text/html", None, block)
    head = warc.arc_head(2, "20200101000000") + b"\n"
    two = head + b"dns:d.com 1.2.3.4 20010203 text/dns 200 abc - 42 f.arc 3\nxyz\n" + b"http://d/ 1.2.3.4 200102030405 text/html 404 - http://e/ 99 f.arc 0\n"
    a, b = warc.parse_arc(two)
    assert (a["block"], a["status"], b["status"], b["length"]) == (b"xyz", 200, 404, 0)
    assert [warc.warc_date(x) for x in ("20010203", "200102030405", "19961104142103", "bad", None)] == [
        "2001-02-03T00:00:00Z", "2001-02-03T04:05:00Z", "1996-11-04T14:21:03Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z",
    ]


@pytest.mark.parametrize("content, error", [(b"rubbish", "unknown version"), (warc.arc_head(1, "2020") + b"\nhttp://x/ y\n", "broken header line"), (warc.arc_head(1, "2020") + b"\nhttp://x/ 0 2020 t 99\nab", "truncated record")])
def test_broken_archives_end_with_an_error(content, error):
    assert [r["error"] for r in warc.parse_arc(content)] == [error]
    assert list(warc.parse_arc(b"")) == list(warc.parse_warc(b"\r\n")) == []
    assert [r["error"] for r in warc.parse_warc(b"nonsense")] == ["broken record"]


def test_pages_of_any_url_are_http(spark):
    body = "y" * 150
    urls = ["ftp://a/x", "www.a.org/x", " http://a/", "mailto:a", "dns:a", "", "HTTPS://A/"]
    pages = spark.createDataFrame([(i, u, body if i % 2 else f"{i}" * 120) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {i: (150, "response" if i == 1 else "revisit", None if i == 1 else 1) if i % 2 else (120, "response", None) for i in range(len(urls))}


def test_other_blocks_become_resources(spark):
    path, out = scratch(spark), scratch(spark)
    record = bytearray(b"dns:d.com 1.2.3.4 20010203 text/dns 200 abc - 42 f.arc 4\n\xff\x00ab")
    warc.write_archives(spark.createDataFrame([(record,)], "record binary"), warc.arc_head(2, "20200101000000"), "\n", path)
    warc.convert(spark, path, out)
    (legacy,) = warc.read_archives(spark, path, warc.parse_arc, warc.ARC_SCHEMA).collect()
    assert (bytes(legacy.block), legacy.version, legacy.error) == (b"\xff\x00ab", 2, None)
    (r,) = warc.read_archives(spark, out, warc.parse_warc, warc.WARC_SCHEMA).collect()
    assert (r.type, bytes(r.payload), r.target, r.date) == ("resource", b"\xff\x00ab", "dns:d.com", "2001-02-03T00:00:00Z")


# -- licences --------------------------------------------------------------------------


def cosine(text):
    weights, idf, rare = licences.vectors()
    idf = dict(idf)
    terms = Counter(re.findall(licences.TERM, text.lower()))
    own = {t: n * idf.get(t, rare) for t, n in terms.items()}
    norm = math.sqrt(sum(x * x for x in own.values()))
    dots = Counter()
    for i, name, t, w in weights:
        dots[i, name] += own.get(t, 0) * w
    best = [(-round(d / norm, 6), name) for (_, name), d in dots.items() if norm and round(d / norm, 6) >= licences.LEAST]
    return min(best) if best else None


def test_scan(spark):
    mit, gpl = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
    rows = [
        ("a/LICENSE", mit[2]), ("a/b/c/x.py", "print(1)"), ("a/b/COPYING", gpl[2]), ("a/b/y.py", "# " + mit[0] + ".\ncode"), ("a/z.py", None), ("LICENSE.txt", "nothing to see"),
        ("root.py", ""), ("q/w.py", "the word license alone\n" * 3), (None, "text"), ("a/b/c/x.py", "print(2)"), ("d/NOTICE", "Licensed under CC BY-NC 4.0."), ("d/e/f.md", "a\n// SPDX-License-Identifier: Apache-2.0\n" + "long " * 9_000),
    ]
    files = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "'x' AS dir", "'y' AS n", "'z' AS licence")
    got = {(r.path, r.licence, r.origin, r.licence_path) for r in licences.scan(files).collect()}
    assert got == {
        ("a/LICENSE", "MIT", "file", "a/LICENSE"), ("a/b/c/x.py", "GPL-3.0", "inherited", "a/b/COPYING"), ("a/b/COPYING", "GPL-3.0", "file", "a/b/COPYING"),
        ("a/b/y.py", "MIT", "header", "a/b/y.py"), ("a/z.py", "MIT", "inherited", "a/LICENSE"), ("LICENSE.txt", None, None, None), ("root.py", None, None, None),
        ("q/w.py", None, None, None), ("", None, None, None), ("d/NOTICE", "CC-BY-NC-4.0", "file", "d/NOTICE"), ("d/e/f.md", "Apache-2.0", "header", "d/e/f.md"),
    }
    assert licences.scan(files).count() == len(rows) and licences.scan(files.where("path = '-'")).count() == 0
    for r in licences.scan(files, keep=("n",)).collect():
        assert r.n == "y"
        if r.origin == "file":
            text = next(t for p, t in rows if p == r.path)
            assert (-r.similarity, r.licence) == cosine(text)


# -- pipeline and registration ---------------------------------------------------------


def test_stages_act_on_what_they_get(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = corpus_pipeline.reject_toxic(spark, docs, SF)
    assert toxic.columns == docs.columns and 0 < toxic.count() < docs.count()
    model = toxicity.fit(docs, toxicity.trainable(spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r.doc_id for r in docs.select("doc_id", toxicity.score(docs, model).alias("s")).collect() if r.s < 0.3}
    assert {r.doc_id for r in toxic.collect()} == kept
    once = corpus_pipeline.exact_dedup(spark, toxic, SF)
    assert {r.doc_id for r in once.collect()} == {r.doc_id for r in exact.classes(toxic, keep=F.max).collect() if r.kept}
    near = corpus_pipeline.near_dedup(spark, once, SF)
    assert sorted((r.doc_id for r in near.collect()), key=str) == brute(once.collect())
    want = Counter(map(tuple, packing.pack(near).collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want and corpus_pipeline.run(spark, SF).columns == packing.pack(near).columns


def test_stages_with_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars")
    for table in (docs, docs.where("doc_id = -1")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
            assert table.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() >= 0


def test_near_copies_go_and_clean_texts_stay(spark):
    import random

    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(600))
    base = [text() for _ in range(40)]
    copies = [" ".join(w if rng.random() > 0.004 else "changed" for w in t.split()) for t in base[:20]]
    docs = spark.createDataFrame(list(enumerate(base + copies)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == set(range(40))


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
    assert set(queries.SQL) <= set(entry.oracle_sql()) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "packing"]


def test_spread_join_of_a_hot_key(spark):
    rows = spark.range(5_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE cast(id AS string) END AS k")
    labels = spark.createDataFrame([("hot", "h", 1_667), ("5", "five", 1), ("absent", "a", 1)], "k string, v string, n long")
    got = {r.id: r.v for r in spread_join(rows, labels, "k", "n").collect()}
    assert len(got) == 5_000 and all(v == ("h" if i % 3 == 0 else "five" if i == 5 else None) for i, v in got.items())
