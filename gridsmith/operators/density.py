"""Density clustering, exact, on (key, x) points.

Equal points are merged with a weight first. In up to four dimensions a grid
decides almost everything without distances: the cell diagonal is the radius, so
points of a cell are neighbours, and a cell with enough weight is all core. Only
points of thin cells are compared with the cells around them (fewer than
``min_samples`` such points a cell), and two full cells are linked by refining
their bounding boxes. With more dimensions the grid serves as well if its cells hold
several points each; the cells around a cell are then found among those that have points.
Otherwise blocks of points that can be within reach are compared, and a block pair returns
counts or a spanning set of links, never its pairs.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.distributed import lookup_join, running_totals
from ..functions.graph import components
from ..session import broadcast_if_small, materialize
from .neighbors import BLOCK_ROWS, assign_cells, block_pairs, candidate_cells, distances_at, within

#: Dimensions with a grid in any case; beyond them, distinct points a cell from which there is one.
GRID_DIMS, CELL_POINTS = 4, 4


def _distance(a: str, b: str, dims: int) -> Column:
    total = F.lit(0.0)
    for i in range(dims):
        total = total + (F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i])
    return F.sqrt(total)


def merge_copies(points: DataFrame) -> DataFrame:
    """id (smallest key as text), x, w, one row per distinct vector."""
    return points.groupBy("x").agg(F.min("key").cast("string").alias("id"), F.count(F.lit(1)).alias("w"))


def label(points: DataFrame, eps: float, min_samples: int, block_rows: int = BLOCK_ROWS, grid_dims: int = GRID_DIMS) -> DataFrame:
    """key, x, cluster (0.. in order of the smallest core key, -1 for noise), is_core.

    A point that is not core takes the cluster of its nearest core point in reach,
    ties to the smaller cluster.
    """
    points = materialize(points.select("key", "x"))
    merged = materialize(merge_copies(points))
    first = merged.first()
    if first is None:
        return points.select("key", "x", F.lit(-1).alias("cluster"), F.lit(False).alias("is_core"))
    dims = len(first["x"])
    solve = _grid_solve if dims <= grid_dims or _crowded(merged, eps, dims) else _block_solve
    core, links, border = solve(merged, eps, min_samples, dims, block_rows)

    comp = components(links)
    named = core.select("id", "x", "node").join(comp, F.col("node") == F.col("vertex"), "left")
    named = materialize(named.select("id", "x", "node", F.coalesce("component", "node").alias("comp")))
    heads = named.groupBy("comp").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = materialize(heads)
    order = running_totals(heads.withColumn("one", F.lit(1)), [], "head", ["one"], heads.count())
    number = order.select("comp", (F.col("cum_one") - 1).cast("int").alias("cluster"), "n")
    inside = lookup_join(named, number, ["comp"], "n").select("x", "cluster", F.lit(True).alias("is_core"))

    where = named.groupBy("node").agg(F.first("comp").alias("comp"), F.count(F.lit(1)).alias("n"))
    touched = lookup_join(border, where, ["node"], "n")
    touched = lookup_join(touched, number, ["comp"], "n")
    best = touched.groupBy("id").agg(F.min(F.struct("dist", "cluster")).alias("b"))
    edge = best.join(merged.select("id", "x"), "id").select("x", F.col("b.cluster").alias("cluster"), F.lit(False).alias("is_core"))

    known = inside.unionByName(edge).join(merged.select("x", "w"), "x")
    done = lookup_join(points, known, ["x"], "w")
    return done.select("key", "x", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


# ------------------------------------------------------------------ grid, few dimensions


def _cell(side: float, dims: int, x: str = "x") -> Column:
    return F.concat_ws(",", *[F.floor(F.col(x)[i] / F.lit(side)).cast("string") for i in range(dims)])


def _offsets(dims: int) -> list[tuple[int, ...]]:
    reach = math.ceil(math.sqrt(dims))
    return [o for o in product(range(-reach, reach + 1), repeat=dims) if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= dims]


def _side(eps: float, dims: int) -> float:
    return eps / math.sqrt(dims) * (1 - 1e-9)


def _crowded(merged: DataFrame, eps: float, dims: int) -> bool:
    if not eps > 0:
        return False
    cells = merged.select(_cell(_side(eps, dims), dims).alias("cell")).distinct().count()
    return cells * CELL_POINTS <= merged.count()


def _around(placed: DataFrame, dims: int, block_rows: int) -> DataFrame:
    """Pairs (cell, near) of cells with points, as ``_offsets`` has them; for many dimensions."""
    place = F.transform(F.split("cell", ","), lambda v: v.cast("double"))
    cells = materialize(placed.select("cell").distinct().select(F.col("cell").alias("id"), place.alias("x")))
    asked, held = _reach_blocks(cells, cells, 2 * math.sqrt(dims) + 1e-6, block_rows)

    def pairs(q, p):
        import numpy as np
        import pandas as pd

        out = [pd.DataFrame({"cell": [], "near": []}, dtype=object)]
        if len(q) and len(p):
            qx, px = np.stack(q["x"].to_numpy()), np.stack(p["x"].to_numpy())
            qk, pk = q["key"].to_numpy(), p["key"].to_numpy()
            step = max(1, 1_000_000 // px.size)
            for s in range(0, len(qx), step):
                gap = np.maximum(np.abs(qx[s : s + step, None, :] - px[None, :, :]) - 1, 0)
                row, at = np.nonzero((gap * gap).sum(-1) <= dims)
                out.append(pd.DataFrame({"cell": qk[s + row], "near": pk[at]}))
        return pd.concat(out)

    keys = ["cell", "pb", "qb"]
    return materialize(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(pairs, "cell string, near string"))


def _with_around(df: DataFrame, cell: str, out: str, dims: int, pairs: DataFrame | None = None) -> DataFrame:
    """One row per cell that can hold a point in reach, named in ``out``."""
    if pairs is not None:
        return df.join(pairs.select(F.col("cell").alias("_at"), F.col("near").alias(out)), F.col(cell) == F.col("_at")).drop("_at")
    steps = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in _offsets(dims)])
    moved = df.withColumn("_step", F.explode(steps))
    place = F.zip_with(F.split(F.col(cell), ","), "_step", lambda c, o: (c.cast("long") + o).cast("string"))
    return moved.withColumn(out, F.array_join(place, ",")).drop("_step")


def _grid_solve(merged: DataFrame, eps: float, min_samples: int, dims: int, block_rows: int):
    side = _side(eps, dims)
    placed = merged.withColumn("cell", _cell(side, dims))
    stats = placed.groupBy("cell").agg(
        F.sum("w").alias("cell_w"), F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks")
    )
    stats = materialize(stats)
    held = stats.select("cell", "n", (F.col("cell_w") >= min_samples).alias("full"), "blocks")
    placed = materialize(lookup_join(placed, held, ["cell"], "n"))

    around = _around(placed, dims, block_rows) if dims > GRID_DIMS else None
    # points of thin cells against every cell around them; a crowded cell is read in blocks
    thin = _with_around(placed.where(~F.col("full")).select("id", "x", "cell"), "cell", "near_cell", dims, around)
    thin = thin.join(stats.select(F.col("cell").alias("near_cell"), "blocks"), "near_cell")
    thin = thin.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    others = placed.select(
        F.col("cell").alias("near_cell"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"),
        F.col("id").alias("other"), F.col("x").alias("y"), "w", F.col("full").alias("other_full"),
    )
    near = thin.join(others, ["near_cell", "block"]).withColumn("dist", _distance("x", "y", dims))
    near = near.where((F.col("dist") <= eps) | (F.col("cell") == F.col("near_cell")))
    near = materialize(near.select("id", "cell", "other", "near_cell", "other_full", "w", "dist"))
    dense_thin = near.groupBy("id").agg(F.sum("w").alias("reach")).where(F.col("reach") >= min_samples).select("id")
    thin_core = materialize(placed.where(~F.col("full")).join(dense_thin, "id", "left_semi").select("id", "x", F.col("cell").alias("node")))
    core = placed.where("full").select("id", "x", F.col("cell").alias("node")).unionByName(thin_core)

    is_core = thin_core.select(F.col("id").alias("core_id"))
    from_core = near.join(is_core, near["id"] == is_core["core_id"], "left").withColumnRenamed("core_id", "a_core")
    other_core = is_core.withColumnRenamed("core_id", "b_core")
    both = from_core.join(other_core, F.col("other") == F.col("b_core"), "left")
    b_is_core = F.col("other_full") | F.col("b_core").isNotNull()
    links = both.where(F.col("a_core").isNotNull() & b_is_core).select(F.col("cell").alias("a"), F.col("near_cell").alias("b"))
    border = both.where(F.col("a_core").isNull() & b_is_core).select("id", F.col("near_cell").alias("node"), "dist")
    full_links = _link_full_cells(placed.where("full").select("x", "cell"), eps, side, dims, around)
    return core, links.unionByName(full_links).distinct(), border


def _boxes(points: DataFrame, step: float, dims: int) -> DataFrame:
    """Bounding boxes of the points of each cell, cut at ``step``."""
    sides = [e for i in range(dims) for e in (F.min(F.col("x")[i]).alias(f"lo{i}"), F.max(F.col("x")[i]).alias(f"hi{i}"))]
    return points.groupBy("cell", _cell(step, dims).alias("box")).agg(*sides)


def _box_bounds(dims: int) -> tuple[Column, Column]:
    """Least and greatest distance between points of box a and box b."""
    low, high = F.lit(0.0), F.lit(0.0)
    for i in range(dims):
        al, ah, bl, bh = (F.col(f"{s}_{e}{i}") for s in "ab" for e in ("lo", "hi"))
        gap = F.greatest(bl - ah, al - bh, F.lit(0.0))
        far = F.greatest(F.abs(ah - bl), F.abs(bh - al))
        low, high = low + gap * gap, high + far * far
    return F.sqrt(low), F.sqrt(high)


def _link_full_cells(points: DataFrame, eps: float, side: float, dims: int, around: DataFrame | None = None) -> DataFrame:
    """Pairs of full cells with two points in reach.

    Box pairs surely in reach link their cells, pairs surely out of reach are
    dropped, and the rest is cut in half on every axis. A box of one point decides
    exactly, so the loop ends.
    """
    spark = points.sparkSession
    linked = spark.createDataFrame([], "a string, b string")
    prefix = lambda df, s: df.select(*[col(c).alias(f"{s}_{c}") for c in df.columns])
    step = side
    boxes = materialize(_boxes(points, step, dims))
    if boxes.limit(1).count() == 0:
        return linked
    left = _with_around(prefix(boxes, "a"), "a_cell", "b_cell", dims, around).where("a_cell < b_cell")
    pairs = left.join(prefix(boxes, "b"), "b_cell")
    while True:
        low, high = _box_bounds(dims)
        judged = materialize(pairs.select("a_cell", "a_box", "b_cell", "b_box", low.alias("low"), high.alias("high")).where(F.col("low") <= eps))
        yes = judged.where(F.col("high") <= eps).select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b")).distinct()
        linked = materialize(linked.unionByName(yes))
        open_pairs = judged.where(F.col("high") > eps).join(yes, (F.col("a_cell") == F.col("a")) & (F.col("b_cell") == F.col("b")), "left_anti")
        open_pairs = materialize(open_pairs.select("a_cell", "a_box", "b_cell", "b_box"))
        if open_pairs.limit(1).count() == 0:
            return linked
        live = open_pairs.select(F.col("a_cell").alias("cell")).union(open_pairs.select("b_cell")).distinct()
        points = points.join(broadcast_if_small(live), "cell", "left_semi")
        finer = step / 2
        child = points.withColumn("up", _cell(step, dims))
        sides = [e for i in range(dims) for e in (F.min(F.col("x")[i]).alias(f"lo{i}"), F.max(F.col("x")[i]).alias(f"hi{i}"))]
        child = child.groupBy("cell", "up", _cell(finer, dims).alias("box")).agg(*sides)
        child = materialize(child)
        one, two = prefix(child, "a"), prefix(child, "b")
        pairs = open_pairs.withColumnsRenamed({"a_box": "a_up", "b_box": "b_up"}).join(one, ["a_cell", "a_up"]).join(two, ["b_cell", "b_up"])
        step = finer


# ------------------------------------------------------------------ blocks, many dimensions


def _reach_blocks(asking: DataFrame, held: DataFrame, eps: float, block_rows: int):
    placed, cells = assign_cells(held.withColumnRenamed("id", "key"), block_rows)
    queries = candidate_cells(asking.select(F.col("id").alias("key"), "x"), cells, None, eps)
    return block_pairs(queries, placed, cells, block_rows)


def _spanning(near):
    """Pairs (row, column) that connect whatever ``near`` (a matrix of booleans) connects: at
    most one a row and one a column. Each row and each column is looked at once."""
    import numpy as np

    turned = np.ascontiguousarray(near.T)
    open_row, open_column = near.any(1), near.any(0)
    a, b = [], []
    while open_row.any():
        start = int(open_row.argmax())
        open_row[start] = False
        front, head = np.array([start]), None
        while len(front):
            columns = np.flatnonzero(near[front].any(0) & open_column)
            open_column[columns] = False
            a.append(np.full(len(columns), start))
            b.append(columns)
            head = columns[0] if head is None else head
            front = np.flatnonzero(turned[columns].any(0) & open_row)
            open_row[front] = False
            a.append(front)
            b.append(np.full(len(front), head))
    none = np.zeros(0, int)
    return np.concatenate([none, *a]).astype(int), np.concatenate([none, *b]).astype(int)


def _block_solve(merged: DataFrame, eps: float, min_samples: int, dims: int, block_rows: int):
    def nears(q, p):
        import numpy as np

        qx, px = np.stack(q["x"].to_numpy()), np.stack(p["x"].to_numpy())
        step = max(1, 1_000_000 // max(len(px), 1))
        return qx, px, ((s, within(qx[s : s + step], px, eps)) for s in range(0, len(qx), step))

    def count(q, p):
        import numpy as np
        import pandas as pd

        if not len(q) or not len(p):
            return pd.DataFrame(columns=["id", "reach"])
        w = p["w"].to_numpy().astype("float64")
        sums = np.concatenate([near.astype("float64") @ w for _, near in nears(q, p)[2]])
        return pd.DataFrame({"id": q["key"].to_numpy(), "reach": sums.astype("int64")})

    def link(q, p):
        import numpy as np
        import pandas as pd

        if not len(q) or not len(p):
            return pd.DataFrame(columns=["a", "b"])
        near = np.concatenate([near for _, near in nears(q, p)[2]])
        qk, pk = q["key"].to_numpy(), p["key"].to_numpy()
        a, b = _spanning(near)
        return pd.DataFrame({"a": qk[a], "b": pk[b]})

    def closest(q, p):
        import numpy as np
        import pandas as pd

        cols = ["id", "node", "dist"]
        if not len(q) or not len(p):
            return pd.DataFrame(columns=cols)
        p = p.sort_values("key")
        out, keys, nodes = [], q["key"].to_numpy(), p["key"].to_numpy()
        qx, px, parts = nears(q, p)
        for s, near in parts:
            row, at = np.nonzero(near)
            d = distances_at(qx[s : s + len(near)], px, row, at)
            order = np.lexsort((at, d, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            out.append(pd.DataFrame({"id": keys[s + row[first]], "node": nodes[at[first]], "dist": d[first]}))
        return pd.concat(out)[cols]

    keys = ["cell", "pb", "qb"]
    pair = lambda sides, fn, schema: sides[0].groupBy(*keys).cogroup(sides[1].groupBy(*keys)).applyInPandas(fn, schema)
    counts = pair(_reach_blocks(merged, merged, eps, block_rows), count, "id string, reach long")
    dense = counts.groupBy("id").agg(F.sum("reach").alias("reach")).where(F.col("reach") >= min_samples).select("id")
    core = materialize(merged.join(dense, "id", "left_semi").select("id", "x"))
    links = pair(_reach_blocks(core, core, eps, block_rows), link, "a string, b string")
    rest = merged.join(core.select("id"), "id", "left_anti").select("id", "x")
    border = pair(_reach_blocks(rest, core, eps, block_rows), closest, "id string, node string, dist double")
    return core.withColumn("node", F.col("id")), links, border
