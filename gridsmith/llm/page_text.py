"""Main text of web pages: markup, and differences to the pages with the nearest URLs.

A page becomes lines, one a block, each with a zone: dropped by its markup (menus, headers,
footers, sidebars, notices, adverts, forms, comments), open, in a main element, or in an
article. Lines of the innermost such element that the page has are content: copies of an
article and passages that articles share stay whole. All other lines are compared with
those of the pages nearest by URL path on the same host, two before and two after, by a
longest common subsequence; lines shared with two of them (with all, if there are fewer)
belong to the site. Open lines that are not shared, and are not mostly links, stay too.

Pages of a host with equal lines count once among the neighbours, so copies of a page do
not hide its site, and a hot host is ordered by ranges, not in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import spread_join, whole

#: Zones of a line.
DROPPED, OPEN, MAIN, ARTICLE = range(4)
#: Places before and after a page in URL order with which it is compared, and the
#: neighbours that must share a line.
NEAR, VOTES = (-2, -1, 1, 2), 2
#: Bits of the rows that one alignment keeps; longer ones are halved first.
ALIGN_BITS = 1 << 27
#: Pages parsed in one go.
STEP = 256

# Element names of HTML and usual class names.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NESTED = frozenset("address article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Dropped elements; a main or article inside one of the second list is content all the same.
ASIDE = frozenset("aside audio button canvas datalist dialog footer head math noscript object select svg template video".split())
FRAME = frozenset("form header menu nav".split())
ASIDE_WORDS = frozenset(
    "ad ads adslot advert advertisement advertising adverts author-bio byline-share comment commentlist comments complementary consent contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr modal newsletter notice notices outbrain overlay popup promo promotion recommendations recommended related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription taboola tags teaser tooltip widget widgets".split()
)
FRAME_WORDS = frozenset("alert banner breadcrumb breadcrumbs header login masthead menu nav navbar navigation pager pagination search signin signup skip toolbar topbar".split())
COMMENT_WORDS = frozenset("comment comments reply related teaser promo".split())

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


@lru_cache(8_192)
def _marks(name: str, attributes: str) -> tuple[int, int, bool]:
    """How far the markup drops an element (0 no, 1 unless an article is inside, 2 wholly),
    the zone it opens, and whether the first holds only outside articles."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    names = " ".join(found.get(k, "") for k in ("class", "id", "role")).split()
    words = {w for n in names for p in [re.split(r"[-_]+", n)] for w in (n, p[0], p[-1])}
    style = found.get("style", "").replace(" ", "")
    if ("hidden" in found and found["hidden"] != "until-found") or found.get("aria-hidden") == "true" or "display:none" in style:
        return 2, OPEN, False
    if name in ("html", "body"):
        return 0, OPEN, False
    if name == "article" or "articlebody" in found.get("itemprop", "") or found.get("role") == "article":
        return (2, OPEN, False) if words & COMMENT_WORDS else (0, ARTICLE, False)
    if name == "main" or found.get("role") == "main":
        return 0, MAIN, False
    if name in ASIDE or words & ASIDE_WORDS:
        return 2, OPEN, False
    if name in FRAME or words & FRAME_WORDS:
        return 1, OPEN, name == "header" or not words.isdisjoint({"header", "masthead", "banner"})
    return 0, OPEN, False


def lines(html: str) -> list[tuple[str, int, bool]]:
    """(text, zone, mostly links) of every block with text, in page order."""
    out: list[tuple[str, int, bool]] = []
    pieces: list[str] = []
    linked = in_link = drop = at = 0
    zone = OPEN
    stack: list[tuple[str, int, int]] = []
    odd: Counter = Counter()  # open elements that are stacked only for their marks

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, DROPPED if drop else zone, 2 * linked > len(text)))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal drop, zone
        while len(stack) > depth:
            name, drop, zone = stack.pop()
            if name not in NESTED:
                odd[name] -= 1

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if in_link:
                linked += len(piece)

    for tag in iter(lambda: _TAG.search(html, at), None):
        text(html[at : tag.start()])
        at = tag.end()
        name = tag[2] or tag[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), tag[1] or tag[4], tag[3] or tag[6] or ""
        if name in RAW:
            if not closing:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name == "a":
            in_link = int(not closing and "href" in attributes.lower())
        if name in BLOCKS:
            flush()
        if name in NESTED:
            in_link = 0
        if closing:
            if name in NESTED or odd[name]:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        flush()
                        close(depth)
                        break
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            for implied in ("p", "li") if name == "li" else ("p",):
                if odd[implied]:
                    close(max(i for i, s in enumerate(stack) if s[0] == implied))
        dropping, opens, outside = _marks(name, attributes)
        if dropping or name in NESTED or opens != OPEN or odd[name]:
            if dropping and not drop or opens != OPEN:
                flush()
            stack.append((name, drop, zone))
            if name not in NESTED:
                odd[name] += 1
            if opens != OPEN and drop < 2:
                drop, zone = 0, max(zone, opens)
            elif dropping > drop and not (outside and zone == ARTICLE):
                drop = dropping
    text(html[at:])
    flush()
    return out


def _cut(found: list[tuple[str, int, bool]]) -> tuple[list[int], int]:
    """Places of the lines that neighbours decide, and the zone that is content anyway."""
    top = max((z for _, z, _ in found), default=OPEN)
    top = top if top > OPEN else ARTICLE + 1
    return [i for i, (_, z, _) in enumerate(found) if z < top], top


def _prints(found: list[tuple[str, int, bool]]) -> bytes:
    return np.array([xxhash.xxh64_intdigest(found[i][0]) for i in _cut(found)[0]], np.uint64).tobytes()


def place(url: str) -> tuple[str, str]:
    """Host and path of a URL; what has no host is a path."""
    rest = url.strip()
    head, sep, tail = rest.partition("://")
    rest = tail if sep and re.fullmatch(r"[A-Za-z][\w+.-]*", head) else rest.removeprefix("//")
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    return host.rpartition("@")[2].lower(), path


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` in one longest common subsequence with ``b``."""
    lo, ends = 0, (len(a), len(b))
    while lo < min(ends) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(ends) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [*range(lo), *range(len(a) - hi, len(a))]
    both = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    own = [i for i in range(lo, len(a) - hi) if a[i] in both]
    out += [own[i] for i in _align([a[i] for i in own], [x for x in b[lo : len(b) - hi] if x in both])]
    return sorted(out)


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit rows of the table of lengths: after each item of ``b`` (or after all), the bits
    of ``a`` at which the length does not grow."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, row, rows = (1 << len(a)) - 1, (1 << len(a)) - 1, []
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _align(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > ALIGN_BITS and len(b) > 1:
        half = len(b) // 2

        def grown(x: list[int], y: list[int]) -> np.ndarray:
            bits = np.unpackbits(np.frombuffer(_rows(x, y, False)[0].to_bytes(len(x) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(x)]
            return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

        cut = int(np.argmax(grown(a, b[:half]) + grown(a[::-1], b[half:][::-1])[::-1]))
        return _align(a[:cut], b[:half]) + [cut + i for i in _align(a[cut:], b[half:])]
    rows, i, j, out = _rows(a, b, True), len(a), len(b), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                out.append(i)
    return out[::-1]


def _site_lines(own: bytes, others: list[bytes]) -> bytes:
    """A byte for each line of ``own``: 1 if enough neighbours share it."""
    a = np.frombuffer(own, np.uint64).tolist()
    votes = np.zeros(len(a), np.int64)
    for other in others:
        votes[shared(a, np.frombuffer(other, np.uint64).tolist())] += 1
    return (votes >= max(1, min(VOTES, len(others)))).astype(np.uint8).tobytes()


def _differences(sides: DataFrame) -> DataFrame:
    """name, weight and mask of each distinct page of a host."""
    alike = sides.groupBy("name").agg(F.min("host").alias("host"), F.min("path").alias("path"), F.min("prints").alias("prints"), F.count(F.lit(1)).alias("weight"))
    alike = alike.repartitionByRange("host", "path", "name").sortWithinPartitions("host", "path", "name")
    fields = [*alike.schema.fields, T.StructField("place", T.LongType())]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + len(batch)), pa.int64())], names=[*batch.schema.names, "place"])
            n += len(batch)

    ordered = materialize(alike.mapInArrow(numbered, T.StructType(fields)).withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["n"] for r in ordered.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for i in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    spot = F.col("place") + F.get(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("range"))
    ordered = ordered.select("name", "weight", "host", "prints", spot.alias("place"))
    asked = ordered.select(F.explode(F.array(*[F.col("place") + d for d in NEAR])).alias("asked"), F.col("host").alias("asked_host"), F.col("prints").alias("other"))
    met = ordered.join(asked, (F.col("place") == F.col("asked")) & (F.col("host") == F.col("asked_host")), "left")
    # at most one neighbour for each of NEAR
    met = met.groupBy("name", "place").agg(F.first("prints").alias("prints"), F.first("weight").alias("weight"), F.collect_list("other").alias("others"))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_site_lines(p, o) for p, o in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["name", "weight", "mask"])

    return met.select("name", "weight", "prints", "others").mapInArrow(masks, "name string, weight long, mask binary")


def kept(found: list[tuple[str, int, bool]], mask: bytes) -> tuple[list[str], int]:
    """The lines that stay, and how many the neighbours took."""
    decided, top = _cut(found)
    site = {i for i, m in zip(decided, mask) if m}
    return [t for i, (t, z, links) in enumerate(found) if z >= top or (z > DROPPED and i not in site and not links)], len(site)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars, n_site_lines (lines shared with neighbours) of every row.

    A null page is empty; a page without main text has an empty one. Pages with a null
    URL, or none with a host, are neighbours on the empty host. White space in a block
    becomes one space, blocks are joined by line breaks. Rows that repeat a key or a page
    have a row each. Other columns are ignored. An empty table gives an empty result.
    Pages are parsed twice: once for the fingerprints of their lines, once for the texts.
    """
    own = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), whole(html).alias("_html"))

    def name_of(where: str, found: list[tuple[str, int, bool]]) -> str:
        """Equal for pages of a host whose lines are equal."""
        digest = xxhash.xxh3_128()
        for line, zone, links in found:
            digest.update(f"{zone}{links:d}{line}\n".encode())
        return f"{where}|{digest.hexdigest()}"

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), STEP):
                part = batch.slice(lo, STEP)
                places = [place(u or "") for u in part.column(0).to_pylist()]
                found = [lines(h.as_py()) for h in part.column(1)]
                prints = [_prints(f) for f in found]
                names = [name_of(h, f) for (h, _), f in zip(places, found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()), pa.array(prints, pa.binary())],
                    names=["name", "host", "path", "prints"],
                )

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), STEP):
                part = batch.slice(lo, STEP)
                found = [lines(h.as_py()) for h in part.column(2)]
                names = [name_of(place(u or "")[0], f) for u, f in zip(part.column(1).to_pylist(), found)]
                ends = [[t for t, z, _ in f if z > DROPPED] for f in found]
                zones = [bytes(z + 4 * links for _, z, links in f) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(ends, pa.list_(pa.string())), pa.array(zones, pa.binary())],
                    names=["_key", "_url", "name", "lines", "zones"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), STEP):
                part = batch.slice(lo, STEP)
                out, site = [], []
                for own_lines, zones, mask in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    rest = iter(own_lines)
                    found = [(next(rest) if z & 3 > DROPPED else "", z & 3, z > 3) for z in zones]
                    stay, n = kept(found, mask or b"")
                    out.append("\n".join(stay))
                    site.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(site, pa.int64())],
                    names=["_key", "_url", "text", "n_chars", "n_site_lines"],
                )

    differences = materialize(_differences(own.select("_url", "_html").mapInArrow(sides, "name string, host string, path string, prints binary")))
    given = own.schema.fields[:2]
    cut = T.StructType([*given, *[T.StructField(n, t) for n, t in (("name", T.StringType()), ("lines", T.ArrayType(T.StringType())), ("zones", T.BinaryType()))]])
    rows = spread_join(own.mapInArrow(texts, cut), differences, "name", "weight").drop("name", "weight")
    final = T.StructType([*given, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_site_lines", T.LongType())])
    out = rows.select("_key", "_url", "lines", "zones", "mask").mapInArrow(joined, final)
    return out.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars", "n_site_lines")
