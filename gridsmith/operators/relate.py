"""Relations between columns: Pearson, Spearman, Kendall, missingness, target ranking."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, numeric_columns
from ..functions.distributed import lookup_join, running_totals
from ..session import LIMITS, materialize


PAIR_SCHEMA = "position int, a string, b string, r double"


def _pairs_frame(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Correlation of each pair over the rows where both are present: position, a, b, r.

    Pairs of columns without gaps come from one correlation matrix, the others from
    masked products (``gapped_corr``).
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    if not names:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    got = df.agg(F.count(F.lit(1)), *[F.count(col(c)) for c in names]).first()
    whole = [c for i, c in enumerate(names) if got[i + 1] == got[0] and got[0] > 1]
    placed = list(enumerate(pairs))
    plain = [(i, p) for i, p in placed if p[0] in whole and p[1] in whole]
    parts = []
    if plain:
        used = list(dict.fromkeys(c for _, p in plain for c in p))
        rows = df.select(array_to_vector(F.array(*[col(c).cast("double") for c in used])).alias("x"))
        matrix = Correlation.corr(rows, "x").first()[0].toArray()
        at = {c: i for i, c in enumerate(used)}
        cells = [(i, a, b, float(matrix[at[a], at[b]])) for i, (a, b) in plain]
        cells = [(i, a, b, None if r != r else r) for i, a, b, r in cells]
        parts.append(df.sparkSession.createDataFrame(cells, PAIR_SCHEMA))
    rest = [(i, p) for i, p in placed if (i, p) not in plain]
    if rest:
        used = list(dict.fromkeys(c for _, p in rest for c in p))
        r, at = gapped_corr(df, used), {c: i for i, c in enumerate(used)}
        cells = [(i, a, b, None if np.isnan(r[at[a], at[b]]) else float(r[at[a], at[b]])) for i, (a, b) in rest]
        parts.append(df.sparkSession.createDataFrame(cells, PAIR_SCHEMA))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def gapped_corr(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Pairwise-complete correlations of columns with gaps, NaN where a pair has fewer than
    two rows or no spread.

    After one aggregate for centres and scales, one scan gives all sums: with gaps filled by
    zero (x) and marked (m), the products x'x, x'm, (x^2)'m and m'm hold the moments of
    every pair over its own complete rows. Tasks multiply blocks of rows, and one partial
    sum a cell leaves each; no row is multiplied by pairs.
    """
    d = len(cols)
    facts = df.agg(*[f(col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    middle = [facts[f"m{i}"] or 0.0 for i in range(d)]
    scale = [facts[f"s{i}"] or 1.0 for i in range(d)]
    rows = df.select(F.array(*[(col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, middle, scale)]).alias("x"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for batch in batches:
            flat = batch.column(0).flatten()
            m = 1.0 - np.asarray(flat.is_null(), np.float64).reshape(-1, d)
            x = np.asarray(flat.fill_null(0.0), np.float64).reshape(-1, d)
            total += np.stack([x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m])
        kind, i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in (kind * d * d + i * d + j, total)], names=["cell", "total"])

    sums = np.zeros(4 * d * d)
    for r in rows.mapInArrow(products, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        sums[r["cell"]] = r["total"]
    xy, sx, sxx, n = sums.reshape(4, d, d)
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = n * sxx - sx * sx
        spread = np.where(spread > 1e-11 * n * sxx, spread, np.nan)
        r = (n * xy - sx * sx.T) / np.sqrt(spread * spread.T)
    return np.where(n > 1, np.clip(r, -1.0, 1.0), np.nan)


def pearson(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Upper triangle of the pairwise-complete correlation matrix."""
    return _pairs_frame(df, list(combinations(cols or numeric_columns(df), 2)))


def high_pairs(df: DataFrame, threshold: float = 0.85, cols: list[str] | None = None) -> DataFrame:
    return pearson(df, cols).select("position", "a", "b", F.abs("r").alias("r")).where(F.col("r") >= threshold)


def with_target(df: DataFrame, target: str, cols: list[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    out = _pairs_frame(df, [(target, c) for c in cols])
    return out.select(F.col("b").alias("feature"), "r").orderBy("r", "feature")


def missingness(df: DataFrame) -> DataFrame:
    """Correlation of the missing flags of columns that have gaps."""
    present = df.agg(F.count(F.lit(1)), *[F.count(col(c)) for c in df.columns]).first()
    gaps = [c for i, c in enumerate(df.columns) if present[i + 1] < present[0]]
    if len(gaps) < 2:
        return df.sparkSession.createDataFrame([], "position int, a string, b string, r double")
    flags = df.select(*[col(c).isNull().cast("double").alias(c) for c in gaps])
    return _pairs_frame(flags, list(combinations(gaps, 2)))


def average_ranks(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Rank of each distinct value, ties at their mean rank: value, rank, n."""
    counts = (
        df.where(col(name).isNotNull())
        .groupBy(col(name).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = running_totals(counts, [], "value", ["n"], rows)
    return total.select("value", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("rank"), "n")


def spearman(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rank correlation, pairwise complete.

    Ranks come from the distinct values of a column with their counts, never from
    a sort of all rows, and are looked up by value. Columns without gaps are ranked
    once; a pair with gaps is ranked on its complete rows.
    """
    cols = cols or numeric_columns(df)
    got = df.agg(F.count(F.lit(1)), *[F.count(col(c)) for c in cols]).first()
    rows = got[0]
    whole = [c for i, c in enumerate(cols) if got[i + 1] == rows]
    pairs = list(combinations(cols, 2))

    def ranked(base: DataFrame, names: list[str]) -> DataFrame:
        out = base.select(*[col(c).cast("double").alias(c) for c in names])
        for c in names:
            ranks = average_ranks(base, c, rows).select(F.col("value").alias(c), F.col("rank").alias(f"_rank_{c}"), F.col("n").alias("_n"))
            out = lookup_join(out, ranks, [c], "_n")
        # the matrix reads its rows more than once, so the looked-up ranks are written
        return materialize(out.select(*[col(f"_rank_{c}").alias(c) for c in names]))

    parts = []
    done = [p for p in pairs if p[0] in whole and p[1] in whole]
    if done:
        parts.append(_pairs_frame(ranked(df, [c for c in cols if c in whole]), done).drop("position"))
    for a, b in pairs:
        if (a, b) not in done:
            both = df.where(col(a).isNotNull() & col(b).isNotNull()).select(col(a), col(b))
            parts.append(_pairs_frame(ranked(both, [a, b]), [(a, b)]).drop("position"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.create_map(*[x for i, (a, b) in enumerate(pairs) for x in (F.lit(f"{a}\0{b}"), F.lit(i))])
    return out.select(place[F.concat_ws("\0", "a", "b")].alias("position"), "a", "b", "r")


def kendall(df: DataFrame, a: str, b: str, strip_rows: int | None = None) -> DataFrame:
    """Tau-b of two columns over their complete rows, exact for any size.

    Works on distinct (x, y) pairs with counts; concordant pairs are counted by
    ``_dominance`` without listing any pair, and ties come from the value counts.
    """
    strip_rows = strip_rows or LIMITS.single_task_rows // 8
    cells = materialize(
        df.where(col(a).isNotNull() & col(b).isNotNull())
        .groupBy(col(a).cast("double").alias("x"), col(b).cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    pieces = _dominance(cells, strip_rows)
    conc = pieces[0]
    for p in pieces[1:]:
        conc = conc.unionByName(p)

    def tied(*keys: str) -> Column:
        w = F.col("w")
        groups = cells.groupBy(*keys).agg(F.sum("w").cast("double").alias("w"))
        return groups.agg(F.coalesce(F.sum(w * (w - 1) / 2), F.lit(0.0))).scalar()

    one = cells.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("double").alias("n")).select(
        (F.col("n") * (F.col("n") - 1) / 2).alias("total"),
        conc.agg(F.sum("c")).scalar().alias("conc"),
        tied("x").alias("tx"),
        tied("y").alias("ty"),
        tied("x", "y").alias("txy"),
    )
    score = 2 * F.col("conc") - (F.col("total") - F.col("tx") - F.col("ty") + F.col("txy"))
    tau = F.try_divide(score, F.sqrt(F.col("total") - F.col("tx")) * F.sqrt(F.col("total") - F.col("ty")))
    return one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), tau.alias("r"))


def _dominance(cells: DataFrame, strip_rows: int) -> list[DataFrame]:
    """Weight of pairs with x < x' and y < y', as frames of partial counts.

    Small inputs go to one task. Larger ones are cut on both axes into strips of
    bounded size at distinct values (a value with more cells is a strip of its
    own and holds no such pair on its axis). The pairs split into three disjoint
    parts: same y strip but different x strips, same x strip, and strips that
    differ on both axes, which is the same problem on the much smaller strip grid.
    """
    size = cells.count()
    count = _pair_counter()
    if size <= strip_rows:
        one = cells.select(F.lit(0).alias("s"), F.col("x").alias("p"), F.col("y").alias("q"), "w")
        empty = cells.sparkSession.createDataFrame([(0.0,)], "c double")
        return [empty, one.groupBy("s").applyInPandas(count, "c double")]
    for axis in ("x", "y"):
        marks = cells.groupBy(axis).agg(F.count(F.lit(1)).alias("cells"))
        cum = running_totals(marks, [], axis, ["cells"], size)
        place = F.floor((F.col("cum_cells") - F.col("cells")) / strip_rows).cast("long") * 2
        own = (F.col("cells") > strip_rows).cast("long")
        strips = cum.select(axis, "cells", (place + own).cast("double").alias(f"s{axis}"))
        cells = lookup_join(cells, strips, [axis], "cells")
    cells = materialize(cells)
    same_y = cells.groupBy(F.col("sy").alias("s"), F.col("sx").alias("p"), F.col("y").alias("q")).agg(F.sum("w").alias("w"))
    same_x = cells.select(F.col("sx").alias("s"), F.col("x").alias("p"), F.col("y").alias("q"), "w")
    grid = cells.groupBy(F.col("sx").alias("x"), F.col("sy").alias("y")).agg(F.sum("w").alias("w"))
    return [
        _mixed(same_y).groupBy("s").applyInPandas(count, "c double"),
        _mixed(same_x).groupBy("s").applyInPandas(count, "c double"),
        *_dominance(materialize(grid), strip_rows),
    ]


def _mixed(strips: DataFrame) -> DataFrame:
    """Strips with more than one value on both axes; the others hold no counted pair."""
    live = strips.groupBy("s").agg(((F.min("p") < F.max("p")) & (F.min("q") < F.max("q"))).alias("_live"))
    return strips.join(live.where("_live").select("s"), "s", "left_semi")


def _pair_counter():
    """Weighted count of pairs with p < p' and q < q' in one strip.

    Rows are ordered by (p, q descending), so a counted pair is one where an
    earlier row has the smaller q. Doubling block widths split every such pair
    exactly once into a left and a right half; one sort a width counts them all.
    """

    def count(pdf):
        import numpy as np
        import pandas as pd

        p, q = pdf["p"].to_numpy(), pdf["q"].to_numpy()
        order = np.lexsort((-q, p))
        q, w = q[order], pdf["w"].to_numpy()[order].astype("float64")
        at = np.arange(len(q))
        total, width = 0.0, 1
        while width < len(q):
            block, right = at // (2 * width), (at // width) % 2 == 1
            by_q = np.lexsort((~right, q, block))  # equal q: right half first, so only smaller ones count
            left_w = np.where(right, 0.0, w)[by_q]
            seen = np.cumsum(left_w)
            starts = np.searchsorted(block[by_q], block[by_q], "left")
            base = np.concatenate(([0.0], seen))[starts]
            total += float((w[by_q] * (seen - base))[right[by_q]].sum())
            width *= 2
        return pd.DataFrame({"c": [total]})

    return count


def kendall_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    pairs = list(combinations(cols or numeric_columns(df), 2))
    out = None
    for i, (a, b) in enumerate(pairs):
        one = kendall(df, a, b).select(F.lit(i).alias("position"), "a", "b", "r")
        out = one if out is None else out.unionByName(one)
    return out


def corr(df: DataFrame, cols: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Heatmap data: upper triangle by the chosen method."""
    methods = {"pearson": pearson, "spearman": spearman, "kendall": kendall_matrix}
    if method not in methods:
        raise ValueError(f"unknown method '{method}'; one of {sorted(methods)}")
    return methods[method](df, cols)
