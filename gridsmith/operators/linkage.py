"""Single linkage of all rows: their minimum spanning tree, cell by cell.

Equal points count once. Planes chosen on a sample cut the space into cells, and lengths are
compared with their ends as ties, so there is one tree, and an edge of it is in the tree of any
subset that holds both its ends. A cell's own tree is grown in one task. An edge of it that is
shorter than the way from one of its sides to every other cell's box is final, so only points
near the border of a cell stay apart. The rest comes from pairs of cells:

* An edge between two cells that is no longer than the longest edge of either cell's tree ends
  in points that are as near to the other cell's box; the tree over these points has it.
* A longer one is the shortest edge between the two cells, as each is linked by then. It is
  looked for only if their boxes are nearer than some way over other cells, whose steps are
  bounded by shortest edges known already or by the far corners of two boxes.

The edges found are far fewer than the pairs of points; those that are not final are reduced
to a tree by Boruvka rounds over the edges alone.

The edges with their lengths are the merges of the dendrogram; without those above a height,
or without the k - 1 longest, what stays connected is a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributed import hash_sample, lookup_join
from ..functions.graph import _union_find, components
from ..session import LIMITS, materialize
from .neighbors import BLOCK_ROWS
from .trees import route

EDGES = "a string, b string, dist double"
#: Points of a cell, sampled points a cell, and the number of cells from which on cells grow.
CELL_ROWS, SAMPLED, MAX_CELLS = 800, 48, 1_024
#: Edges that a task connects at a time before a cut.
STAR_EDGES = 200_000
# Room for rounding where distances meet bounds.
SLACK = 1 + 1e-9


def _tree(x):
    """Ends (places, the smaller first) and lengths of the tree over the rows of ``x``, grown
    from the first one. Ties are broken by the places, which are in the order of the keys."""
    import numpy as np

    n = len(x)
    a, b, length = np.empty(max(n - 1, 0), int), np.empty(max(n - 1, 0), int), np.empty(max(n - 1, 0))
    # points outside the tree, the nearest place in the tree and its distance
    every, out, dist, other, at = np.arange(1, n), x[1:].copy(), np.full(max(n - 1, 0), np.inf), np.zeros(max(n - 1, 0), int), 0
    for i in range(n - 1):
        m = n - 1 - i
        d = np.sqrt(((out[:m] - x[at]) ** 2).sum(-1))
        better, tied = d < dist[:m], np.flatnonzero(d == dist[:m])
        if len(tied):
            v, o = every[tied], other[tied]
            new, old = (np.minimum(v, at), np.maximum(v, at)), (np.minimum(v, o), np.maximum(v, o))
            better[tied] = (new[0] < old[0]) | ((new[0] == old[0]) & (new[1] < old[1]))
        dist[:m][better], other[:m][better] = d[better], at
        near = np.flatnonzero(dist[:m] == dist[:m].min())
        pick = near[0] if len(near) == 1 else min(near, key=lambda p: (min(every[p], other[p]), max(every[p], other[p])))
        at = every[pick]
        a[i], b[i], length[i] = min(at, other[pick]), max(at, other[pick]), dist[pick]
        for held in (every, out, dist, other):  # the last one takes the place of the one that joined
            held[pick] = held[m - 1]
    return a, b, length


def _in_one_task(pdf):
    """The tree over the few points of one block."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("first")
    keys = pdf["first"].to_numpy(dtype=object)
    a, b, length = _tree(np.stack(pdf["x"].to_numpy()))
    return pd.DataFrame({"a": keys[a], "b": keys[b], "dist": length})


def _planes(sample, leaf: int) -> dict:
    """Cuts down to ``leaf`` sampled rows, in the form of ``trees.route``: the widest dimension
    at the widest gap of its middle half; leaves are numbered by -1 - feature."""
    import numpy as np

    feature, cut, left, todo, cells = [-1], [0.0], [-1], [(0, sample)], 0
    while todo:
        node, rows = todo.pop()
        spread = rows.max(0) - rows.min(0)
        f = int(spread.argmax())
        if len(rows) <= leaf or not spread[f] > 0:
            feature[node], cells = -1 - cells, cells + 1
            continue
        v = np.sort(rows[:, f])
        gaps, m = np.diff(v), len(v)
        middle = np.abs(np.arange(m - 1) - (m - 2) / 2)
        inner = np.flatnonzero((gaps > 0) & (middle <= m / 4))
        at = inner[gaps[inner].argmax()] if len(inner) else min(np.flatnonzero(gaps > 0), key=lambda p: middle[p])
        point = (v[at] + v[at + 1]) / 2
        point = point if v[at] <= point < v[at + 1] else v[at]
        feature[node], cut[node], left[node] = f, float(point), len(feature)
        below = rows[:, f] <= point
        todo += [(len(feature), rows[below]), (len(feature) + 1, rows[~below])]
        feature, cut, left = [*feature, -1, -1], [*cut, 0.0, 0.0], [*left, -1, -1]
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left)}


def _to_box(x, low, high):
    """Least distance of each row to a box."""
    import numpy as np

    return np.sqrt((np.maximum(np.maximum(low - x, x - high), 0.0) ** 2).sum(-1))


class _Boxes:
    """Least and greatest coordinates of the points of each cell, on the driver."""

    def __init__(self, placed: DataFrame, width: int):
        import numpy as np

        ends = [how(F.get("x", i)).alias(f"{name}{i}") for name, how in (("l", F.min), ("h", F.max)) for i in range(width)]
        rows = placed.groupBy("cell").agg(*ends).orderBy("cell").collect()
        self.at = {r["cell"]: i for i, r in enumerate(rows)}
        self.cells = [r["cell"] for r in rows]
        self.low = np.array([[r[f"l{i}"] for i in range(width)] for r in rows], float).reshape(len(rows), width)
        self.high = np.array([[r[f"h{i}"] for i in range(width)] for r in rows], float).reshape(len(rows), width)

    def nearest(self, i: int):
        import numpy as np

        return np.sqrt((np.maximum(np.maximum(self.low - self.high[i], self.low[i] - self.high), 0.0) ** 2).sum(-1))

    def farthest(self, i: int):
        import numpy as np

        return np.sqrt((np.maximum(self.high - self.low[i], self.high[i] - self.low) ** 2).sum(-1))


LOCAL = "kind int, cell int, a string, b string, u string, v string, dist double, x array<double>"


def _own_trees(boxes: _Boxes):
    """Of each cell: final edges (kind 0), other edges with the parts they link (1), the points
    with their parts (2), and the longest edge (3)."""

    def grow(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("key")
        keys, x, cell = pdf["key"].to_numpy(dtype=object), np.stack(pdf["x"].to_numpy()), int(pdf["cell"].iloc[0])
        a, b, length = _tree(x)
        longest = length.max() if len(length) else 0.0
        way = np.full(len(keys), np.inf)  # to the nearest other box
        for j in np.flatnonzero(boxes.nearest(boxes.at[cell]) <= longest * SLACK):
            if j != boxes.at[cell]:
                way = np.minimum(way, _to_box(x, boxes.low[j], boxes.high[j]))
        way, root, shut, final = (way / SLACK).tolist(), list(range(len(keys))), [False] * len(keys), []

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        order = np.lexsort((b, a, length))
        for e in order.tolist():
            p, q = find(int(a[e])), find(int(b[e]))
            # the shortest edge that leaves one side, of all edges, unless one was passed over
            sure = (not shut[p] and length[e] < way[p]) or (not shut[q] and length[e] < way[q])
            final.append(sure)
            if sure:
                root[q], way[p], shut[p] = p, min(way[p], way[q]), shut[p] or shut[q]
            else:
                shut[p] = shut[q] = True
        part = keys[[find(v) for v in range(len(keys))]]
        final = np.array(final, bool)
        sure, rest = order[final], order[~final]
        out = [
            pd.DataFrame({"kind": 0, "a": keys[a[sure]], "b": keys[b[sure]], "dist": length[sure]}),
            pd.DataFrame({"kind": 1, "a": keys[a[rest]], "b": keys[b[rest]], "u": part[a[rest]], "v": part[b[rest]], "dist": length[rest]}),
            pd.DataFrame({"kind": 2, "a": keys, "u": part, "x": list(x)}),
            pd.DataFrame({"kind": [3], "dist": [longest]}),
        ]
        out = pd.concat([f for f in out if len(f)]).assign(cell=cell).reindex(columns=["kind", "cell", "a", "b", "u", "v", "dist", "x"])
        # plain objects, as text of several frames has no single Arrow array
        return out.assign(**{c: out[c].astype(object).where(out[c].notna(), None) for c in ("a", "b", "u", "v", "x")})

    return grow


FOUND = "pair long, a string, b string, u string, v string, dist double"


def _between(placed: DataFrame, boxes: _Boxes, pairs: list[tuple[int, int, float]], closest: bool) -> DataFrame:
    """Edges between the points (cell, key, x, part) of pairs of cells that are as near to the
    other box as the bound of the pair: the shortest one, or those of the tree over them."""
    import numpy as np

    asked: dict[int, list] = {}
    for i, j, bound in pairs:
        pair = i * len(boxes.cells) + j
        asked.setdefault(boxes.cells[i], []).append((pair, 0, j, bound * SLACK))
        asked.setdefault(boxes.cells[j], []).append((pair, 1, i, bound * SLACK))
    spark = placed.sparkSession
    held = spark.sparkContext.broadcast((asked, boxes.low, boxes.high))

    def near(batches):
        asked, low, high = held.value
        for pdf in batches:
            for cell, rows in pdf.astype({"key": object, "part": object}).groupby("cell"):
                x = np.stack(rows["x"].to_numpy())
                for pair, side, other, bound in asked.get(cell, ()):
                    close = _to_box(x, low[other], high[other]) <= bound
                    if close.any():
                        yield rows.loc[close, ["key", "x", "part"]].assign(pair=pair, side=side)

    def link(pdf):
        import pandas as pd

        pdf = pdf.sort_values("key")
        keys, x = pdf["key"].to_numpy(dtype=object), np.stack(pdf["x"].to_numpy())
        part, side = pdf["part"].to_numpy(dtype=object), pdf["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a = b = np.zeros(0, int)
        length = np.zeros(0)
        if len(left) and len(right) and not closest:
            a, b, length = _tree(x)
            across = side[a] != side[b]
            a, b, length = a[across], b[across], length[across]
        elif len(left) and len(right):
            best, step = None, max(1, 1_000_000 // max(1, x[right].size))
            for s in range(0, len(left), step):
                d = np.sqrt(((x[left[s : s + step], None, :] - x[None, right, :]) ** 2).sum(-1))
                if best is None or d.min() <= best[0]:
                    row, at = np.nonzero(d == d.min())
                    p, q = left[s + row], right[at]
                    first = min(zip(np.minimum(p, q).tolist(), np.maximum(p, q).tolist()))
                    best = min(best or (np.inf,), (d.min(), *first))
            length, a, b = np.array(best[:1]), np.array(best[1:2]), np.array(best[2:])
        return pd.DataFrame({"pair": pdf["pair"].iloc[0], "a": keys[a], "b": keys[b], "u": part[a], "v": part[b], "dist": length})

    near_rows = placed.mapInPandas(near, "key string, x array<double>, part string, pair long, side int")
    return near_rows.repartition(4 * spark.sparkContext.defaultParallelism, "pair").groupBy("pair").applyInPandas(link, FOUND)


def _ways(weights):
    """The tree over the cells as (i, j), and for all pairs of cells the longest step on the way
    between them in it."""
    import numpy as np

    n = len(weights)
    step, best, parent, inside, edges = np.zeros((n, n)), weights[0].copy(), np.zeros(n, int), [0], []
    best[0] = np.inf
    for _ in range(n - 1):
        v = int(best.argmin())
        p, w = int(parent[v]), best[v]
        step[v, inside] = step[inside, v] = np.maximum(step[p, inside], w)
        edges.append((min(p, v), max(p, v)))
        inside.append(v)
        nearer = weights[v] < best
        nearer[inside] = False
        best[nearer], parent[nearer] = weights[v][nearer], v
        best[v] = np.inf
    return edges, step


def _across(placed: DataFrame, boxes: _Boxes, longest) -> list[DataFrame]:
    """Edges between cells that contain all those of the tree."""
    import numpy as np

    n = len(boxes.cells)
    inner = np.maximum(longest[:, None], longest[None, :])  # from there on both cells are linked
    low = np.array([boxes.nearest(i) for i in range(n)]) / SLACK
    high = np.array([boxes.farthest(i) for i in range(n)]) * SLACK
    known = np.eye(n, dtype=bool)
    out = []

    def search(mask, bound, closest):
        at = [(int(i), int(j), float(bound[i, j])) for i, j in np.argwhere(np.triu(mask, 1))]
        if not at:
            return
        found = materialize(_between(placed, boxes, at, closest))
        out.append(found.drop("pair"))
        least = {r["pair"]: r["d"] for r in found.groupBy("pair").agg(F.min("dist").alias("d")).collect()}  # one value a pair of cells
        for i, j, most in at:
            d = least.get(i * n + j, np.inf)
            known[i, j] = known[j, i] = d <= most
            low[i, j] = low[j, i] = d if d <= most else np.nextafter(most, np.inf)
            high[i, j] = high[j, i] = min(high[i, j], d)

    search(low <= inner, inner, False)
    steps, _ = _ways(np.maximum(high, inner))
    tree = np.zeros((n, n), bool)
    for i, j in steps:
        tree[i, j] = not known[i, j]
    search(tree, high, True)
    _, step = _ways(np.maximum(high, inner))
    search(~known & (low <= step), step, True)
    return out


def _kruskal(pdf):
    import pandas as pd

    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    kept = []
    for u, v, a, b, dist in pdf.sort_values(["dist", "a", "b"])[["u", "v", "a", "b", "dist"]].itertuples(index=False):
        p, q = find(u), find(v)
        if p != q:
            root[p] = q
            kept.append((a, b, dist))
    return pd.DataFrame(kept, columns=["a", "b", "dist"])


def _reduced(edges: DataFrame, one_task_edges: int | None = None) -> list[DataFrame]:
    """The tree over the parts u and v that ``edges`` (u, v, a, b, dist) link."""
    limit = LIMITS.single_task_rows // 8 if one_task_edges is None else one_task_edges
    shortest = F.min(F.struct("dist", "a", "b")).alias("e")

    def thinned(df):
        df = df.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        return materialize(df.agg(shortest).select("u", "v", "e.*"))

    out, edges = [], thinned(edges)
    while edges.count() > limit:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "dist", "a", "b"))
        ends = both.groupBy("u").agg(F.min(F.struct("dist", "a", "b", "v")).alias("e"), F.count(F.lit(1)).alias("n"))
        ends = materialize(ends.select("u", "e.*", "n"))
        out.append(ends.select("a", "b", "dist").distinct())
        joined = components(ends.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("vertex").alias("u"), F.col("component").alias("to"))
        to = joined.join(ends.select("u", "n"), "u")
        for end in ("u", "v"):
            named = to.select(F.col("u").alias(end), "to", "n")
            edges = lookup_join(edges, named, [end], "n").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = thinned(edges)
    return [*out, edges.groupBy().applyInPandas(_kruskal, EDGES)]


def spanning_tree(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b, dist of the edges of a minimum spanning tree over the rows (key, x) with equal
    keys as text; one edge less than there are rows, equal points at distance 0. Points of
    one block are linked in one task, with the same result."""
    import numpy as np

    rows = materialize(points.select(F.col("key").cast("string").alias("key"), "x"))
    groups = materialize(rows.groupBy("x").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")))
    copies = lookup_join(rows, groups, ["x"], "n").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"), F.lit(0.0).alias("dist"))
    tree = [materialize(copies)]
    n = groups.count()
    if n <= block_rows:
        return tree[0].unionByName(groups.groupBy().applyInPandas(_in_one_task, EDGES))
    # points without a place are endlessly far from all others, and linked to the first key
    lost = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fact = groups.agg(F.count_if(lost).alias("lost"), F.min("first").alias("least"), F.min(F.when(~lost, F.col("first"))).alias("placed")).first()
    if fact["lost"]:
        far = groups.where((lost & (F.col("first") != fact["least"])) | ((F.col("first") == F.lit(fact["placed"])) & F.lit(fact["placed"] != fact["least"])))
        tree.append(far.select(F.lit(fact["least"]).alias("a"), F.col("first").alias("b"), F.lit(float("inf")).alias("dist")))
        groups, n = materialize(groups.where(~lost)), n - fact["lost"]
    if n <= block_rows:
        tree += [groups.groupBy().applyInPandas(_in_one_task, EDGES)] if n else []
        return _all(tree)
    few = min(MAX_CELLS, n // min(CELL_ROWS, block_rows) + 1) * SAMPLED
    sample = groups.select("first", "x")
    sample = np.array([r["x"] for r in (hash_sample(sample, "first", few) if few < n else sample).collect()], float)  # bounded
    packed = _planes(sample, max(2, len(sample) * min(CELL_ROWS, block_rows) // n, len(sample) // MAX_CELLS))

    def cells(batches):
        for pdf in batches:
            if len(pdf):
                leaf = route(packed, np.ascontiguousarray(np.stack(pdf["x"].to_numpy()).T))
                yield pdf.assign(cell=(-1 - packed["feature"][leaf]).astype("int32"))

    placed = materialize(groups.select(F.col("first").alias("key"), "x").mapInPandas(cells, "key string, x array<double>, cell int"))
    boxes = _Boxes(placed, sample.shape[1])
    tasks = 4 * placed.sparkSession.sparkContext.defaultParallelism
    own = materialize(placed.repartition(tasks, "cell").groupBy("cell").applyInPandas(_own_trees(boxes), LOCAL))
    reach = {r["cell"]: r["dist"] for r in own.where("kind = 3").collect()}  # one value a cell
    parts = own.where("kind = 2").select("cell", F.col("a").alias("key"), "x", F.col("u").alias("part"))
    found = _across(parts, boxes, np.array([reach[c] for c in boxes.cells]))
    edges = own.where("kind = 1").select("u", "v", "a", "b", "dist")
    for more in found:
        edges = edges.unionByName(more)
    tree += [own.where("kind = 0").select("a", "b", "dist"), *_reduced(edges)]
    return _all(tree)


def _all(tree: list[DataFrame]) -> DataFrame:
    out = tree[0]
    for part in tree[1:]:
        out = out.unionByName(part)
    return out


def _stars(batches):
    """Links of the same components, each vertex to the smallest one that some edges of its task
    connect it with. Edges of a cell lie together, so long chains become short here."""
    import pandas as pd

    solve, held, size = _union_find(), [], 0

    def solved():
        out = solve(pd.concat(held))
        return out[out["vertex"] != out["component"]].rename(columns={"vertex": "a", "component": "b"}).astype(object)

    for pdf in batches:
        held, size = [*held, pdf.astype(object)], size + len(pdf)
        if size >= STAR_EDGES:
            yield solved()
            held, size = [], 0
    if held:
        yield solved()


def cut(points: DataFrame, tree: DataFrame, k: int | None = None, height: float | None = None) -> DataFrame:
    """key (text) and cluster (its smallest key) after leaving out the ``k`` - 1 longest
    edges, ties by their ends, or all edges longer than ``height``."""
    if height is not None:
        kept = tree.where(F.col("dist") <= height)
    else:
        gone = tree.orderBy(F.desc("dist"), F.desc("a"), F.desc("b")).limit(max(0, k - 1))
        kept = tree.join(F.broadcast(gone.select("a", "b")), ["a", "b"], "left_anti")
    found = components(kept.select("a", "b").mapInPandas(_stars, "a string, b string")).select(F.col("vertex").alias("key"), "component")
    keys = points.select(F.col("key").cast("string").alias("key"))
    return keys.join(found, "key", "left").select("key", F.coalesce("component", "key").alias("cluster"))
