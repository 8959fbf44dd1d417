"""Exact nearest neighbours without a cross join.

Points are assigned to the nearest of a few pivot vectors. The triangle
inequality then tells which pivot cells can hold a neighbour of a query, so only
those cells are visited. Cells and their queries are cut into blocks of bounded
size; a task compares one block of queries with one block of points and returns
at most k rows a query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.distributed import hash_sample
from ..session import materialize

BLOCK_ROWS = 4_096
MAX_PIVOTS = 2_048


def as_points(df: DataFrame, key: str, features: str, *carry: str) -> DataFrame:
    """key, x (array of double) and carried columns."""
    x = vector_to_array(col(features)) if df.schema[features].dataType.typeName() != "array" else col(features).cast("array<double>")
    return df.select(col(key).alias("key"), x.alias("x"), *[col(c) for c in carry])


def squares(qx, px):
    """Squared distances of all rows of two matrices by one product, and a bound of their error."""
    import numpy as np

    middle = px.mean(0)
    q, p = qx - middle, px - middle
    a, b = (q * q).sum(1)[:, None], (p * p).sum(1)[None, :]
    return a + b - 2.0 * (q @ p.T), (a + b) * (8 + px.shape[1]) * 4e-16


def distances_at(qx, px, row, at):
    """Distances of chosen pairs of rows, rounded as if all pairs were computed."""
    import numpy as np

    out = np.empty(len(row))
    step = max(1, 4_000_000 // max(qx.shape[1], 1))
    for s in range(0, len(row), step):
        out[s : s + step] = np.sqrt(((qx[row[s : s + step]] - px[at[s : s + step]]) ** 2).sum(-1))
    return out


def within(qx, px, eps: float):
    """Which rows of ``qx`` and ``px`` are at most ``eps`` apart: by the product where its error
    cannot matter, else by the distance itself."""
    import numpy as np

    with np.errstate(invalid="ignore", over="ignore"):
        s, error = squares(qx, px)
        near = s + error < eps * eps * (1 - 1e-12)
        row, at = np.nonzero(~near & ~(s - error > eps * eps * (1 + 1e-12)))
    near[row, at] = distances_at(qx, px, row, at) <= eps
    return near


def nearest_of(qx, px, k: int, barred=None):
    """Distances of ``qx`` to ``px``, infinite for rows that are surely not among the ``k``
    nearest (more at ties) and where ``barred``."""
    import numpy as np

    with np.errstate(invalid="ignore", over="ignore"):
        s, error = squares(qx, px)
        if not np.isfinite(s).all():
            d = np.sqrt(((qx[:, None, :] - px[None, :, :]) ** 2).sum(-1))
            return d if barred is None else np.where(barred, np.inf, d)
    high = s + error
    if barred is not None:
        high[barred] = np.inf
    limit = np.partition(high, k - 1, axis=1)[:, k - 1 : k]
    keep = s - error <= limit
    if barred is not None:
        keep &= ~barred
    row, at = np.nonzero(keep)
    d = np.full(s.shape, np.inf)
    d[row, at] = distances_at(qx, px, row, at)
    return d


def nearest_pairs(qx, px, k: int, barred=None):
    """Row, place and distance of pairs that hold the ``k`` nearest of ``px`` to each row of
    ``qx`` (more at ties) without the ``barred`` ones; None where a product is not finite."""
    import numpy as np

    with np.errstate(invalid="ignore", over="ignore"):
        middle = px.mean(0)
        q, p = qx - middle, px - middle
        a, b = (q * q).sum(1), (p * p).sum(1)
        # a row's own square shifts all its distances alike, so it only counts in the error
        error = (a + b.max(initial=0.0))[:, None] * (8 + px.shape[1]) * 4e-16
        if not np.isfinite(4 * error.max(initial=0.0) * 1e16):
            return None
    t = (-2.0 * q) @ p.T
    t += b
    if barred is not None:
        t[barred] = np.inf
    limit = np.partition(t, k - 1, axis=1)[:, k - 1 : k] + 2 * error
    keep = t <= limit
    if barred is not None:
        keep &= ~barred
    row, at = np.nonzero(keep)
    return row, at, distances_at(qx, px, row, at)


@dataclass
class Cells:
    """Pivots (bounded: MAX_PIVOTS vectors), and size and radius of each cell."""

    pivots: list[list[float]]
    sizes: list[int]
    radii: list[float]


def dealt(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` written, and from more than ``least`` on dealt evenly over all cores: a few
    bytes a row would leave the comparing to a few tasks."""
    written = materialize(rows)
    if written.count() <= least:
        return written
    return materialize(written.repartition(rows.sparkSession.sparkContext.defaultParallelism))


def assign_cells(points: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Cells]:
    """Adds ``cell`` to (key, x, ...) rows; written once."""
    n = points.count()
    want = max(1, min(MAX_PIVOTS, 4 * n // block_rows))
    found = hash_sample(points.select("key", "x"), "key", want).select("x").distinct().collect()
    pivots = [list(r[0]) for r in found]

    def nearest(batches):
        import numpy as np

        p = np.asarray(pivots)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            best = np.empty(len(x), dtype="int32")
            far = np.empty(len(x))
            step = max(1, 1_000_000 // len(p))
            for s in range(0, len(x), step):
                found = nearest_pairs(x[s : s + step], p, 1)
                if found is None:
                    d = nearest_of(x[s : s + step], p, 1)
                    best[s : s + step] = d.argmin(1)
                    far[s : s + step] = d.min(1)
                    continue
                row, at, d = found
                order = np.lexsort((at, d, row))
                first = order[np.searchsorted(row[order], np.arange(len(x[s : s + step])))]
                best[s : s + step] = at[first]
                far[s : s + step] = d[first]
            yield pdf.assign(cell=best, _far=far)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    if not pivots:
        return points.withColumn("cell", F.lit(0)), Cells([], [], [])
    placed = materialize(points.mapInPandas(nearest, f"{schema}, cell int, _far double"))
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("r")).collect()}
    sizes = [stats[i]["n"] if i in stats else 0 for i in range(len(pivots))]
    radii = [stats[i]["r"] if i in stats else 0.0 for i in range(len(pivots))]
    return placed.drop("_far"), Cells(pivots, sizes, radii)


def candidate_cells(queries: DataFrame, cells: Cells, want: int | None, reach: float | None) -> DataFrame:
    """One row per query and cell that can hold one of its ``want`` nearest points,
    or a point within ``reach``."""
    pivots, sizes, radii = cells.pivots, cells.sizes, cells.radii
    if not pivots:
        return queries.withColumn("cell", F.lit(0)).limit(0)

    def expand(batches):
        import numpy as np

        p, n, r = np.asarray(pivots), np.asarray(sizes), np.asarray(radii)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            step = max(1, 4_000_000 // max(p.size, 1))
            for s in range(0, len(x), step):
                with np.errstate(invalid="ignore", over="ignore"):
                    square, error = squares(x[s : s + step], p)
                    if np.isfinite(square + error).all():
                        low, d = np.sqrt(np.maximum(square - error, 0.0)), np.sqrt(square + error)
                    else:
                        low = d = np.sqrt(((x[s : s + step, None, :] - p[None, :, :]) ** 2).sum(-1))
                if reach is not None:
                    bound = np.full(len(d), reach)
                else:
                    # the nearest cells that surely hold enough points bound the distance; no more
                    # than ``want`` of those with points are needed
                    far = np.where(n > 0, d + r, np.inf)
                    some = min(want, far.shape[1])
                    order = np.argpartition(far, some - 1, axis=1)[:, :some]
                    order = np.take_along_axis(order, np.take_along_axis(far, order, 1).argsort(1), 1)
                    enough = n[order].cumsum(1) >= want
                    bound = np.take_along_axis(far, order, 1)[np.arange(len(far)), enough.argmax(1)]
                    bound = np.where(enough.any(1), bound, np.inf)
                slack = 1e-9 * (1.0 + np.abs(d))
                row, cell = np.nonzero((low - r - slack <= bound[:, None]) & (n > 0))
                yield pdf.iloc[s : s + step].iloc[row].assign(cell=cell.astype("int32"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInPandas(expand, f"{schema}, cell int")


def block_pairs(queries: DataFrame, points: DataFrame, cells: Cells, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with block columns (cell, pb, qb): every candidate query meets every
    block of its cell, and no group holds more than about a block of either side."""
    queries = materialize(queries)
    asked = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = F.col("cell") + 1
    sizes = cells.sizes or [0]
    pbs = F.array(*[F.lit(max(1, math.ceil(n / block_rows))) for n in sizes])
    qbs = F.array(*[F.lit(max(1, math.ceil(asked.get(i, 0) / block_rows))) for i in range(len(sizes))])
    spot = lambda blocks: F.pmod(F.xxhash64("key"), F.element_at(blocks, at)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.element_at(blocks, at) - 1))
    left = queries.withColumn("qb", spot(qbs)).withColumn("pb", every(pbs))
    right = points.withColumn("pb", spot(pbs)).withColumn("qb", every(qbs))
    return left, right


def knn(queries: DataFrame, points: DataFrame, k: int, exclude_same_key: bool = False, carry: list[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest points of each query by Euclidean distance, ties by key.

    Inputs have columns key and x (array of double); result: key, neighbor, dist,
    rank and the carried point columns.
    """
    want = k + 1 if exclude_same_key else k
    carry = list(carry)
    # of equal points only the first by key can matter, however many copies there are
    copies = Window.partitionBy("x").orderBy("key")
    unique = points.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= want).drop("_c")
    placed, cells = assign_cells(dealt(unique.select("key", "x", *carry), block_rows), block_rows)
    qtype, ptype = (d.schema["key"].dataType.simpleString() for d in (queries, placed))
    extra = "".join(f", `{c}` {placed.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"key {qtype}, neighbor {ptype}, dist double{extra}"
    if not cells.pivots:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    left, right = block_pairs(candidate_cells(dealt(queries.select("key", "x"), block_rows), cells, want, None), placed, cells, block_rows)

    def nearest(q, p):
        import numpy as np
        import pandas as pd

        names = ["key", "neighbor", "dist", *carry]
        if not len(q) or not len(p):
            return pd.DataFrame(columns=names)
        p = p.sort_values("key", kind="stable")
        px = np.stack(p["x"].to_numpy())
        qx = np.stack(q["x"].to_numpy())
        keys, pkeys = q["key"].to_numpy(), p["key"].to_numpy()
        out = []
        take = min(want + int(exclude_same_key), len(p))
        step = max(1, 1_000_000 // max(len(px), 1))
        for s in range(0, len(qx), step):
            barred = keys[s : s + step, None] == pkeys[None, :] if exclude_same_key else None
            found = nearest_pairs(qx[s : s + step], px, take, barred)
            if found is None:
                d = nearest_of(qx[s : s + step], px, take, barred)
                row, at = np.nonzero(np.isfinite(d))
                found = row, at, d[row, at]
            row, at, d = found
            # the nearest of each row, ties in key order
            order = np.lexsort((at, d, row))
            order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < take]
            row, at, d = row[order], at[order], d[order]
            part = {"key": keys[s : s + step][row], "neighbor": pkeys[at], "dist": d}
            part.update({c: p[c].to_numpy()[at] for c in carry})
            out.append(pd.DataFrame(part))
        return pd.concat(out)[names]

    near = left.groupBy("cell", "pb", "qb").cogroup(right.groupBy("cell", "pb", "qb")).applyInPandas(nearest, schema)
    order = Window.partitionBy("key").orderBy("dist", "neighbor")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class KnnModel:
    """k-nearest-neighbour prediction over a training table (key, x, label), by the exact
    cells or, with ``graph``, by the approximate index."""

    train: DataFrame
    k: int
    classify: bool
    key: str
    graph: object = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: majority class (ties to the smaller) or mean label."""
        asked = as_points(df, self.key, "features")
        if self.graph is None:
            near = knn(asked, self.train, self.k, carry=["label"])
        else:
            near = self.graph.search(asked, self.k).join(self.train.select(F.col("key").alias("neighbor"), "label"), "neighbor")
        if self.classify:
            votes = near.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
            best = votes.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("label"))).alias("b"))
            guess = best.select(F.col("key").alias("_k"), F.col("b.label").alias("prediction"))
        else:
            guess = near.groupBy(F.col("key").alias("_k")).agg(F.avg("label").alias("prediction"))
        return df.join(guess, col(self.key) == F.col("_k"), "left").drop("_k")


@dataclass
class Knn:
    k: int = 5
    classify: bool = True
    key: str = "_key"
    approximate: bool = False

    def fit(self, df: DataFrame) -> KnnModel:
        """``df`` has the key, ``features`` and ``label``."""
        from . import graph_index

        train = materialize(as_points(df, self.key, "features", "label"))
        return KnnModel(train, self.k, self.classify, self.key, graph_index.build(train) if self.approximate else None)
