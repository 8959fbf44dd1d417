"""Registered queries over the driver tables, and their SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, fingerprints, katz, licences, packing, page_text, pieces, ranking, simhash, token_counts, toxicity, vector_codes, warc
from .common import residue, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose id is divisible by 50 are the queries of the near search."""
    return fingerprints.fingerprint_edits(table(spark, sf, "documents"), asked=F.col("doc_id") % 50 == 0)


@query("op2_katz")
def op2_katz(spark: SparkSession, sf: str) -> DataFrame:
    return katz.score(table(spark, sf, "documents"), residue("doc_id", 7) == 2)


#: Where the query puts a document in a tree; some documents take the place of licence files.
FILE_PATH = """concat(coalesce(source, '_'), '/', coalesce(lang, '_'), '/', CAST(floor(doc_id / 1000) AS BIGINT), '/',
    CASE WHEN doc_id % 1000 = 0 THEN 'LICENSE'
    ELSE concat(CAST(floor(doc_id / 100) AS BIGINT), '/', CASE WHEN doc_id % 100 = 50 THEN 'LICENSE' ELSE concat(doc_id, '.txt') END) END)"""


def _licence_sql() -> str:
    weights, idf, rare = licences.vectors()
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return rf"""
    WITH RECURSIVE idf(term, idf) AS (VALUES {values(idf)}), vec(template, licence, term, share) AS (VALUES {values(weights)}),
    files AS (SELECT doc_id, {FILE_PATH} AS path, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT path, unnest(string_split(text, chr(10))) AS unit FROM files WHERE regexp_matches(text, '{licences.CUE}')),
    units AS (SELECT path, 'header' AS origin, unit FROM lines WHERE regexp_matches(unit, '{licences.CUE}')
        UNION SELECT path, 'file', text FROM files WHERE regexp_matches(path, '{licences.FILE_NAME}')),
    terms AS (SELECT unit, unnest(regexp_extract_all(lower(unit), '{licences.TERM}')) AS term FROM (SELECT DISTINCT unit FROM units)),
    counts AS (SELECT unit, term, count(*) * coalesce(any_value(idf), {rare!r}::DOUBLE) AS weight FROM terms LEFT JOIN idf USING (term) GROUP BY unit, term),
    norms AS (SELECT unit, sqrt(sum(weight * weight)) AS norm FROM counts GROUP BY unit),
    dots AS (SELECT unit, template, licence, sum(weight * share) AS dot FROM counts JOIN vec USING (term) GROUP BY unit, template, licence),
    hits AS (SELECT unit, licence, round(dot / norm, 6) AS similarity FROM dots JOIN norms USING (unit) WHERE round(dot / norm, 6) >= {licences.LEAST}),
    own AS (SELECT path, origin, licence, similarity FROM units JOIN hits USING (unit)
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY similarity DESC, origin, licence) = 1),
    holders AS (SELECT regexp_replace(path, '(^|/)[^/]*$', '') AS dir, path, licence, similarity FROM own WHERE regexp_matches(path, '{licences.FILE_NAME}')
        QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path, licence) = 1),
    climb(path, dir) AS (SELECT path, regexp_replace(path, '(^|/)[^/]*$', '') FROM files
        UNION SELECT path, regexp_replace(dir, '(^|/)[^/]*$', '') FROM climb WHERE dir <> ''),
    up AS (SELECT c.path, h.path AS up_path, h.licence, h.similarity FROM climb c JOIN holders h USING (dir)
        QUALIFY row_number() OVER (PARTITION BY c.path ORDER BY length(dir) DESC) = 1)
    SELECT doc_id, f.path, coalesce(o.licence, u.licence) AS licence, coalesce(o.similarity, u.similarity) AS similarity,
        CASE WHEN o.path IS NOT NULL THEN o.origin WHEN u.path IS NOT NULL THEN 'inherited' END AS origin,
        CASE WHEN o.path IS NOT NULL THEN f.path ELSE u.up_path END AS licence_path
    FROM files f LEFT JOIN own o ON o.path = f.path LEFT JOIN up u ON u.path = f.path
    """


@query("op3_licence_scan", _licence_sql())
def op3_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "documents").select("doc_id", "text", F.expr(FILE_PATH).alias("path"))
    return licences.scan(files, keep=("doc_id",))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query(
    "op5_warc",
    f"""
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {warc.LEAST_REVISIT} GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first_id < page_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)
    """,
)
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(table(spark, sf, "pages"))


@query("op6_piece_sampling")
def op6_piece_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """Three segmentations of every document; the ids as a digest, and that of the text they decode to."""
    drawn = pieces.encode_samples(table(spark, sf, "documents"), piece_model(), ["doc_id"])
    decoded = pieces.decode(drawn, piece_model()).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return decoded.withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids", "decoded")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), piece_model())


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.groups(table(spark, sf, "documents"), shingle=3, radius=3)


@query(
    "op9_exact_dedup",
    f"""
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
    g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
)
def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.classes(table(spark, sf, "documents"), keep=F.max)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, toxicity.trainable(table(spark, sf, "labels")))
    scored = docs.select("doc_id", (residue("doc_id", 4) == 2).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


#: The terms of ranked search, as SQL over a lower-cased text.
TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')""".replace("{UPPER}", UPPER).replace("{LOWER}", LOWER)


@query(
    "op11_ranked_search",
    f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS doc_row, {TERMS} AS terms FROM documents),
    s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
    i AS (SELECT item_id, row_number() OVER () AS item_row, {TERMS} AS terms FROM benchmark),
    q AS (SELECT item_row, term, count(*) AS times FROM (SELECT item_row, unnest(terms) AS term FROM i) GROUP BY ALL),
    b AS (SELECT doc_row, term, count(*) AS tf FROM (SELECT doc_row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM b, s GROUP BY term),
    m AS (SELECT doc_row, doc_id, 25 + (75 * len(terms) * docs) // total AS m FROM d, s WHERE len(terms) > 0),
    r AS (SELECT item_row, doc_row, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
        FROM q JOIN b USING (term) JOIN w USING (term) JOIN m USING (doc_row) GROUP BY ALL HAVING score > 0),
    t AS (SELECT item_row, doc_id, score, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id) AS rank FROM r JOIN m USING (doc_row) QUALIFY rank <= 10)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM t JOIN i USING (item_row)
    """,
)
def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op12_page_text",
    r"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS art FROM pages),
    b AS (SELECT page_id, url, list_transform(string_split_regex(art, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS blocks FROM a),
    c AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
        '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#(?:x27|39);', '''', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM b),
    t AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM c)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
    """,
)
def op12_page_text(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL knows only the markup that these pages use."""
    return page_text.extract(table(spark, sf, "pages")).drop("n_site_lines")


def _codes_sql() -> str:
    steps = []
    for r in range(3):
        steps.append(f"""
    d{r} AS (SELECT x.vec_row, x.part, c.entry, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS far FROM x JOIN c{r} c ON c.part = x.part AND c.place = x.place GROUP BY ALL),
    a{r} AS MATERIALIZED (SELECT vec_row, part, entry, far FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_row, part ORDER BY far, entry) = 1)""")
        if r < 2:
            steps.append(f"""
    u{r} AS (SELECT part, entry, place, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS v FROM a{r} JOIN x USING (vec_row, part) GROUP BY ALL),
    c{r + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce(u.v, c.v) AS v FROM c{r} c LEFT JOIN u{r} u USING (part, entry, place))""")
    return f"""
    WITH k AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS vec_row FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
    f AS (SELECT vec_row, unnest(list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT))) AS v, unnest(range(len(embedding))) AS i, len(embedding) // 16 AS width FROM k),
    x AS MATERIALIZED (SELECT vec_row, i // width AS part, i % width AS place, v FROM f),
    c0 AS MATERIALIZED (SELECT part, vec_row - 1 AS entry, place, v FROM x WHERE vec_row <= 64),{",".join(steps)},
    e AS (SELECT vec_row, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY vec_row),
    h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_row), h
    """


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf, "embeddings"))
