"""Legacy archives (ARC 1 and 2) to WARC.

Archives are written by Spark's text writer with the record separator as line
separator, and read whole as binary files, so they can lie in any store Spark reaches.
Their size is bounded: a task begins a new archive after ``ARCHIVE_BYTES``.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize
from .common import scratch, spread_join

#: Bytes of an archive before compression, without its last record.
ARCHIVE_BYTES = 16 << 20
#: Bytes of records passed on at a time, and rows handled at a time.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 256
#: Equal payloads of fewer bytes are stored again.
LEAST_REVISIT = 100
#: Content types and names that the formats fix.
HTTP, INFO = "application/http; msgtype=response", "application/warc-fields"
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

ARC_SCHEMA = "archive string, offset long, version int, url string, ip string, date string, mime string, status int, length long, block binary, error string"
WARC_SCHEMA = "archive string, offset long, type string, record_id string, target string, date string, refers_to string, payload_digest string, http string, payload binary, error string"


# -- writing ---------------------------------------------------------------------------


def write_archives(records: DataFrame, head: bytes, separator: str, path: str) -> None:
    """Write the binary column ``record`` as gzip archives that each begin with ``head``
    and end every record with ``separator``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, at, size = 0, 0, 0
        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            rows = []
            for record in batch.column(0).to_pylist():
                if at == 0 or size >= ARCHIVE_BYTES:
                    archive, size = archive + (at > 0), 0
                    rows.append((archive, at, head))
                    at += 1
                rows.append((archive, at, record))
                at, size = at + 1, size + len(record)
            yield pa.RecordBatch.from_pydict({"archive": [r[0] for r in rows], "at": [r[1] for r in rows], "record": [r[2] for r in rows]}, schema=pa.schema([("archive", pa.int32()), ("at", pa.int64()), ("record", pa.binary())]))

    dealt = records.select("record").mapInArrow(deal, "archive int, at long, record binary").sortWithinPartitions("archive", "at")
    dealt.select("archive", F.col("record").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", separator).option("compression", "gzip").text(path)


def arc_head(version: int, date: str) -> bytes:
    """The version block that begins an ARC file, without the line break after it."""
    body = f"{version} 0 gridsmith\n{ARC_FIELDS[version]}\n"
    extra = {1: "", 2: "200 - - 0 pages.arc "}[version]
    return f"filedesc://pages.arc 0.0.0.0 {date} text/plain {extra}{len(body)}\n{body}".encode()


def write_arc(pages: DataFrame, path: str, key: str, url: str, body: str, version: int = 2, date: str = "20200101000000") -> None:
    """One record per row: an HTTP response whose headers name the row's key, with the
    body in UTF-8. A null body is empty, a null key is left out, a null url is
    ``unknown:``; white space in urls is percent-encoded. Other columns are ignored."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            out = []
            for k, u, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                payload = (b or "").encode()
                name = "" if k is None else f"X-Page-Id: {k}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                place = quote(u or "unknown:", safe="".join(map(chr, range(33, 127))))
                extra = {1: "", 2: "200 - - 0 pages.arc "}[version]
                out.append(f"{place} 0.0.0.0 {date} text/html {extra}{len(block)}\n".encode() + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows = pages.select(F.col(key).cast("string").alias("k"), F.col(url).cast("string").alias("u"), F.col(body).cast("string").alias("b"))
    write_archives(rows.mapInArrow(build, "record binary"), arc_head(version, date), "\n", path)


# -- reading ---------------------------------------------------------------------------


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC file, the version block left out.

    The version block gives the version and so the fields of a header line; a header
    line whose fields or length do not fit ends the file with a record that holds the
    rest and an ``error``. Line breaks between records are skipped.
    """
    at, version, end = 0, None, len(content)
    while True:
        while at < end and content[at] in b"\r\n":
            at += 1
        if at >= end:
            return
        stop = content.find(b"\n", at)
        line = content[at : stop if stop >= 0 else end].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        begin = stop + 1 if stop >= 0 else end
        size = int(parts[-1]) if parts[-1].isascii() and parts[-1].isdigit() else -1
        if version is None:
            found = re.match(rb"([12]) ", content[begin : begin + 2])
            version = int(found[1]) if found and line.startswith("filedesc:") else 0
        want = len(ARC_FIELDS[version].split()) if version else -1
        if len(parts) != want or not 0 <= size <= end - begin:
            yield {"offset": at, "version": version or None, "block": content[at:], "error": "unknown version" if not version else "broken header line" if len(parts) != want or size < 0 else "truncated record"}
            return
        if not line.startswith("filedesc:"):
            status = parts[4] if version == 2 else ""
            yield {
                "offset": at, "version": version, "url": parts[0], "ip": parts[1], "date": parts[2], "mime": parts[3],
                "status": int(status) if status.isdigit() else None, "length": size, "block": content[begin : begin + size], "error": None,
            }
        at = begin + size


def parse_warc(content: bytes) -> Iterator[dict]:
    """Records of a WARC file, warcinfo left out; ``http`` and ``payload`` split a block
    at the end of its HTTP headers. What does not parse ends the file with an ``error``."""
    at, end = 0, len(content)
    while True:
        while at < end and content[at] in b"\r\n":
            at += 1
        if at >= end:
            return
        stop = content.find(b"\r\n\r\n", at)
        lines = content[at : max(stop, at)].decode("utf-8", "replace").split("\r\n")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = named.get("content-length", "")
        if not lines[0].startswith("WARC/") or not size.isdigit() or stop + 4 + int(size) > end:
            yield {"offset": at, "payload": content[at:], "error": "broken record"}
            return
        block = content[stop + 4 : stop + 4 + int(size)]
        if named.get("warc-type") != "warcinfo":
            http, _, payload = block.partition(b"\r\n\r\n") if named.get("content-type", "").startswith("application/http") else (b"", b"", block)
            yield {
                "offset": at, "type": named.get("warc-type"), "record_id": named.get("warc-record-id"), "target": named.get("warc-target-uri"),
                "date": named.get("warc-date"), "refers_to": named.get("warc-refers-to"), "payload_digest": named.get("warc-payload-digest"),
                "http": http.decode("utf-8", "replace"), "payload": payload, "error": None,
            }
        at = stop + 4 + int(size)


def read_archives(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[dict]], schema: str, make: Callable[[dict], dict] | None = None) -> DataFrame:
    """Records of every archive under ``path``, plain or gzip, by ``parse``, each as it is
    or as ``make`` turns it into a row of ``schema``; ``archive`` is the file's path.
    A task holds one archive and passes its records on in small batches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    empty = spark.createDataFrame([], schema).schema
    columns = to_arrow_schema(empty)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for r in parse(_plain(content.as_py())):
                    r["archive"] = name.as_py()
                    rows.append(make(r) if make else r)
                    size += len(r.get("block") or r.get("payload") or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=columns)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=columns)

    return files.mapInArrow(records, empty)


# -- conversion ------------------------------------------------------------------------


def warc_date(date: str | None) -> str:
    """An ARC date of 8, 12 or 14 digits as a WARC date; the epoch if it is none."""
    digits = re.fullmatch(r"(\d{4})(\d\d)(\d\d)(?:(\d\d)(\d\d)(\d\d)?)?", date or "")
    if not digits:
        return "1970-01-01T00:00:00Z"
    y, mo, d, h, mi, s = (x or "00" for x in digits.groups())
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


def _headers(http: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.split("\r\n")[1:])}


IDENTIFIED = "record_id string, url string, ip string, date string, kind string, digest string, size long, key string"
BLOCKS = ", http binary, payload binary"


def identify(header: str = "x-page-id") -> Callable[[dict], dict]:
    """Maker of what a WARC record needs from an ARC record: record_id (from archive,
    offset and url), kind, http (headers of an HTTP block), payload, its digest
    (SHA-256) and size, and ``key`` (the value of an HTTP ``header``)."""

    def make(r: dict) -> dict:
        block, place = r["block"] or b"", r.get("url") or "unknown:"
        web = block.startswith(b"HTTP/")  # whatever the URL's scheme is
        http, _, payload = block.partition(b"\r\n\r\n") if web else (b"", b"", block)
        return {
            "record_id": f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{r["archive"]} {r["offset"]} {place}').urn}>",
            "url": place, "ip": r.get("ip"), "date": warc_date(r.get("date")), "kind": HTTP if web else r.get("mime") or "application/octet-stream",
            "http": http, "payload": payload, "digest": hashlib.sha256(payload).hexdigest(), "size": len(payload),
            "key": _headers(http.decode("utf-8", "replace")).get(header) if web else None,
        }

    return make


def convert(spark: SparkSession, legacy: str, path: str, least: int = LEAST_REVISIT, order: str = "long", header: str = "x-page-id") -> None:
    """Write the WARC archives of the ARC archives under ``legacy``.

    Of the records with equal payloads (by SHA-256) of at least ``least`` bytes the one
    with the smallest key (read as type ``order``; records without one come last, ties
    go to the smaller record id) is stored whole; the others become revisits that keep
    their HTTP headers and refer to it. Blocks that are not HTTP become resources.
    """
    seen = read_archives(spark, legacy, parse_arc, IDENTIFIED, identify(header))
    records = read_archives(spark, legacy, parse_arc, IDENTIFIED + BLOCKS, identify(header))
    rank = F.struct(F.col("key").try_cast(order).isNull().alias("none"), F.col("key").try_cast(order).alias("key"), "record_id")
    groups = seen.where((F.col("size") >= least) & (F.col("kind") == HTTP)).groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1").select("digest", F.col("first.record_id").alias("first_id"), "n"))
    typed = spread_join(records, groups, "digest", "n")
    typed = typed.withColumn("first_id", F.when((F.col("size") >= least) & (F.col("kind") == HTTP) & (F.col("first_id") != F.col("record_id")), F.col("first_id")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS)):
            out = []
            for r in batch.to_pylist():
                web, again = r["kind"] == HTTP, r["first_id"]
                block = (r["http"] + b"\r\n\r\n" if web else b"") + (b"" if again else r["payload"])
                lines = [
                    "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response' if web else 'resource'}", f"WARC-Record-ID: {r['record_id']}",
                    f"WARC-Target-URI: {r['url']}", f"WARC-Date: {r['date']}", f"WARC-IP-Address: {r['ip']}",
                    f"WARC-Payload-Digest: sha256:{r['digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
                ]
                if again:
                    lines += [f"WARC-Refers-To: {again}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                lines += [f"Content-Type: {r['kind']}", f"Content-Length: {len(block)}", "", ""]
                out.append("\r\n".join(lines).encode() + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    body = "software: gridsmith\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, path).urn
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: {INFO}\r\nContent-Length: {len(body)}\r\n\r\n{body}".encode()
    built = typed.select("record_id", "url", "ip", "date", "kind", "http", "payload", "digest", "first_id").mapInArrow(build, "record binary")
    write_archives(built, head, "\r\n\r\n", path)


CONTENTS = "key string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_id string"


def contents(spark: SparkSession, path: str, header: str = "x-page-id") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to (key of the record a
    revisit refers to) of the WARC archives under ``path``. The digest of a stored
    payload is computed from its bytes; a revisit has the length and digest that its
    headers declare."""

    def make(r: dict) -> dict:
        named, again, payload = _headers(r.get("http") or ""), r.get("type") == "revisit", r["payload"] or b""
        return {
            "key": named.get(header), "payload_bytes": int(named.get("content-length", 0)) if again else len(payload),
            "payload_digest": (r["payload_digest"] or "").partition(":")[2] if again else hashlib.sha256(payload).hexdigest(),
            "record_type": r.get("type") or "unreadable", "record_id": r.get("record_id"), "refers_id": r.get("refers_to"),
        }

    rows = materialize(read_archives(spark, path, parse_warc, CONTENTS, make))
    asked = rows.where("refers_id is not null").groupBy("refers_id").agg(F.count(F.lit(1)).alias("n"))
    named = rows.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_to"))
    labels = materialize(asked.join(named, "refers_id"))
    return spread_join(rows, labels.select("refers_id", "refers_to", "n"), "refers_id", "n").drop("n", "refers_id", "record_id")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", version: int = 2) -> DataFrame:
    """Pages to ARC archives, those to WARC archives, and the WARC records read back:
    key, payload_bytes, payload_digest, record_type, refers_to, one row per page.

    A null body is empty. Of equal payloads of at least 100 bytes the record with the
    smallest key is the response, the others revisit it; of rows that repeat a key and
    body one is the response. A null key stays null and comes last. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)[key]
    legacy, converted = scratch(spark), scratch(spark)
    write_arc(pages, legacy, key, url, body, version)
    convert(spark, legacy, converted, order=kind)
    found = contents(spark, converted)
    return found.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
