"""Document fingerprints with DataFrame functions only: SimHash and permuted block tables.

Terms are the words of a text in lower case. Each occurrence of a term votes on the 64
signed bits of its hash with a weight of its length, up to ``HEAVIEST``; a bit of the
fingerprint is set when the votes for it outweigh the others. Four 16-bit counters share
a long, so a term costs 16 additions; a run of terms ends before a counter can overflow.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import layout, signed
from .common import spread_join, whole

#: Weight of a term at most, and terms of one run: a run stays below 2**15 votes a bit.
HEAVIEST, RUN = 12, 2_500
#: Rows of one range when documents are put in order.
RANGE_ROWS = 100_000

_COUNTERS = 0x0001000100010001


def _words(text: Column) -> Column:
    """Lower-case words between ASCII white space; empty ones in between weigh nothing."""
    for space in "\t\n\v\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(F.lower(text), " ")


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with a long fingerprint ``name`` in place of ``text``; 0 without words.

    Terms are summed up where they are read, so one short row a run of terms is
    shuffled, for a text of any length.
    """
    kept = [c for c in rows.columns if c != text]
    terms = rows.withColumn("_row", F.monotonically_increasing_id())
    terms = terms.select(*kept, "_row", F.posexplode(_words(F.col(text))).alias("_at", "_term"))
    weight = F.least(F.char_length("_term"), F.lit(HEAVIEST)).cast("long")
    terms = terms.select(*kept, "_row", F.floor(F.col("_at") / RUN).alias("_run"), F.xxhash64("_term").alias("_hash"), weight.alias("_weight"))
    lanes = [F.sum(F.shiftrightunsigned("_hash", b).bitwiseAND(F.lit(_COUNTERS)) * F.col("_weight")).alias(f"_lane{b}") for b in range(16)]
    runs = terms.groupBy(*kept, "_row", "_run").agg(*lanes, F.sum("_weight").alias("_total"))
    votes = [F.sum(F.shiftrightunsigned(f"_lane{b % 16}", b - b % 16).bitwiseAND(F.lit(0xFFFF))).alias(f"_bit{b}") for b in range(64)]
    summed = runs.groupBy(*kept, "_row").agg(*votes, F.sum("_total").alias("_total"))
    bits = [F.shiftleft((2 * F.col(f"_bit{b}") > F.col("_total")).cast("long"), b) for b in range(64)]
    return summed.select(*kept, reduce(Column.bitwiseOR, bits).alias(name))


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def search(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """Links fp, near_fp of each query with every fingerprint within ``radius`` bits.

    Both tables hold distinct long ``fp``. Two such fingerprints agree in at least
    ``blocks - radius`` blocks: there is one table for every choice of those blocks,
    keyed by their bits, and a link is reported by the first table that holds it.
    """
    masks = layout(prints.count(), radius)
    lead = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for i, m in enumerate(masks)])
    tables = prints.select("fp", F.inline(lead)).withColumnRenamed("fp", "near_fp")
    asked = queries.select("fp", F.inline(lead))
    apart = F.col("fp").bitwiseXOR(F.col("near_fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(signed(m)).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)])
    near = (F.bit_count(apart) <= radius) & (first == F.col("t"))
    return asked.join(tables, ["t", "bits"]).where(near).select("fp", "near_fp")


def successors(rows: DataFrame, order: list[Column], key: str, values: list[str]) -> DataFrame:
    """``rows`` with next_<name> of the row after it in ``order``, the first row after
    the last one, for ``key`` and ``values``. Rows are ranged, not gathered: each range
    is a window of its own, and its last row takes the head of the next range."""
    parts = max(1, ceil(rows.count() / RANGE_ROWS))
    ranged = materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    window = Window.partitionBy("_part").orderBy(*order)
    names = [key, *values]
    following = ranged.withColumn("_next", F.lead(F.struct(*names)).over(window)).withColumn("_at", F.row_number().over(window))
    following = materialize(following)
    heads = following.where("_at = 1").select("_part", F.struct(*names).alias("_head"))
    line = Window.orderBy("_part")
    heads = heads.select("_part", F.coalesce(F.lead("_head").over(line), F.first("_head").over(line)).alias("_head"))
    out = following.join(F.broadcast(heads), "_part", "left").withColumn("_next", F.coalesce("_next", "_head"))
    return out.select(*rows.columns, *[F.col("_next")[n].alias(f"next_{n}") for n in names])


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, asked: Column | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, one row per row of ``docs``:
    key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    and near_docs, the number of other documents within ``radius`` bits for rows where
    ``asked`` holds (by default none).

    The edited text has its last third (rounded down) replaced by as many first
    characters, or all, of the next document: the next smaller key, after the smallest
    the largest. Equal keys are in order of their texts' hashes, null keys come last.
    A null text counts as empty; an empty text has fingerprint 0. Rows that repeat key
    and text are one document. Other columns are ignored; an empty table gives an
    empty result.
    """
    label = F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(whole(text)))
    own = docs.select(F.col(key).alias("id"), label.alias("row"), whole(text).alias("text"))
    asked = F.lit(False) if asked is None else asked
    marked = docs.select(F.col(key).alias("id"), label.alias("row"), F.char_length(whole(text)).cast("long").alias("n"), F.coalesce(asked, F.lit(False)).alias("asked"), whole(text).alias("text"))
    once = materialize(with_fingerprint(marked, "text", "fp").groupBy("row", "id", "n", "fp", "asked").agg(F.count(F.lit(1)).alias("times")))

    prints = materialize(once.groupBy("fp").agg(F.sum("times").alias("times"), F.max("asked").alias("asked")))
    found = search(prints.select("fp"), prints.where("asked").select("fp"), radius)
    sizes = found.join(prints.select(F.col("fp").alias("near_fp"), "times"), "near_fp").groupBy("fp").agg((F.sum("times") - 1).alias("near_docs"))
    near = materialize(sizes.join(prints.select("fp", F.col("times").alias("rows")), "fp").select(F.col("fp").cast("string").alias("print"), "near_docs", "rows"))
    once = once.withColumn("print", F.when(F.col("asked"), F.col("fp").cast("string")))
    once = spread_join(once, near, "print", "rows").select("row", "id", "n", "fp", "near_docs")

    order = [F.col("id").desc_nulls_last(), F.col("row")]
    line = materialize(successors(once, order, "row", ["fp"]).withColumn("cut", F.floor(F.col("n") / 3).cast("int")))
    own = own.select("row", "text").repartition("row")  # one shuffle of the texts serves both joins
    ends = own.withColumnRenamed("row", "next_row").join(line, "next_row")
    ends = ends.select("row", "id", "n", "fp", "next_fp", "near_docs", "cut", F.substring(F.col("text"), F.lit(1), F.col("cut")).alias("end")).dropDuplicates(["row"])
    edited = own.join(ends, "row").withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n") - F.col("cut")).cast("int")), F.col("end")))
    edited = edited.select("id", "n", "fp", "next_fp", "near_docs", F.sha2("edited", 256).alias("sha"), "edited")
    return with_fingerprint(edited, "edited", "edited_fp").select(
        F.col("id").alias(key),
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        hex_of(F.col("fp")).alias("fingerprint"),
        hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "near_docs",
    )
