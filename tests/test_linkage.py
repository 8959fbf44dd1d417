"""Minimum spanning trees against Kruskal over all pairs."""

import numpy as np
import pytest

from gridsmith.operators import cluster, linkage


def kruskal(rows):
    """Lengths of the tree, and a function that gives the clusters of a cut."""
    x, n = np.array([v for _, v in rows]), len(rows)
    edges = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), i, j) for i in range(n) for j in range(i))

    def joined(keep):
        root = list(range(n))

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        used = []
        for d, i, j in edges:
            a, b = find(i), find(j)
            if a != b and keep(d, len(used)):
                root[max(a, b)] = min(a, b)
                used.append(d)
        return used, [find(i) for i in range(n)]

    return joined(lambda d, _: True)[0], lambda keep: joined(keep)[1]


def groups(names):
    out = {}
    for i, name in names:
        out.setdefault(name, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("kind, block", [("grid", 16), ("spread", 16), ("grid", 4_096), ("spread", 4_096)])
def test_tree_and_cuts(spark, kind, block):
    rng = np.random.default_rng(5)
    made = rng.integers(0, 7, (110, 2)).astype(float) if kind == "grid" else rng.normal(size=(110, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    points = spark.createDataFrame(rows, "key long, x array<double>").repartition(3)
    tree = linkage.spanning_tree(points, block_rows=block)
    lengths, clusters = kruskal(rows)
    assert np.allclose(sorted(r["dist"] for r in tree.collect()), lengths)
    height = lengths[len(lengths) * 2 // 3]
    got = groups((int(r["key"]), r["cluster"]) for r in linkage.cut(points, tree, height=height).collect())
    assert got == groups(enumerate(clusters(lambda d, _: d <= height)))
    if kind == "spread":
        got = groups((int(r["key"]), r["cluster"]) for r in linkage.cut(points, tree, k=5).collect())
        assert got == groups(enumerate(clusters(lambda _, n: n < len(rows) - 5)))


def test_small_tables(spark):
    for rows, edges in (([], 0), ([(1, [0.0])], 0), ([(1, [2.0]), (2, [2.0]), (3, [2.0])], 2), ([(1, [0.0]), (2, [3.0])], 1)):
        points = spark.createDataFrame(rows, "key long, x array<double>")
        tree = linkage.spanning_tree(points)
        assert tree.count() == edges and linkage.cut(points, tree, k=1).count() == len(rows)


def test_single_linkage_of_all_rows(spark):
    rng = np.random.default_rng(2)
    made = np.concatenate([rng.normal(0, 0.1, (300, 2)), rng.normal(5, 0.1, (400, 2)), [[20.0, 20.0]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(made.tolist())], "id long, a double, b double")
    bundle = cluster.fit(df, ["a", "b"], "id", cluster.AGGLOMERATIVE, n_clusters=3, linkage="single")
    sizes = sorted((r["Label"], r["Count"]) for r in cluster.label_counts(bundle.assigned).collect())
    assert sizes == [("0", 300), ("1", 400), ("2", 1)]


def test_few_passes_with_ties_and_far_points(spark, monkeypatch):
    """The same edges as over all pairs, ties by their ends, in passes that do not grow with the rows."""
    rng = np.random.default_rng(9)
    lines = np.column_stack([rng.integers(0, 400, 900) / 50, rng.integers(0, 4, 900), rng.integers(0, 2, 900) * 3])
    made = np.unique(np.concatenate([lines, [[90.0, 1.0, 0.0], [-40.0, 2.0, 3.0]]]).astype(float), axis=0)
    keys = sorted(map(str, range(len(made))))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, made)], "key string, x array<double>").repartition(4)
    a, b, dist = linkage._tree(made)
    want = {(keys[p], keys[q], d) for p, q, d in zip(a, b, dist)}
    assert np.allclose(sorted(dist), kruskal(list(enumerate(made.tolist())))[0])
    calls, write = [], linkage.materialize
    monkeypatch.setattr(linkage, "materialize", lambda df: calls.append(1) or write(df))
    tree = linkage.spanning_tree(points, block_rows=32)
    assert {tuple(r) for r in tree.collect()} == want and len(calls) <= 9


def test_reduced_by_rounds(spark):
    rng = np.random.default_rng(4)
    ends = [(int(u), int(v), int(w)) for u, v, w in zip(rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 9, 400)) if u != v]
    rows = [(f"{u:02}", f"{v:02}", f"{min(u, v):02}", f"{max(u, v):02}", float(w)) for u, v, w in ends]
    edges = spark.createDataFrame(rows, "u string, v string, a string, b string, dist double")
    one, *more = ({tuple(r) for part in linkage._reduced(edges, limit) for r in part.collect()} for limit in (1_000, 20))
    assert more == [one] and len(one) == len({e for u, v, _ in ends for e in (u, v)}) - 1


def test_cut_of_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(linkage, "STAR_EDGES", 50)
    keys = [f"{i:04}" for i in range(500)]
    points = spark.createDataFrame([(k,) for k in keys], "key string")
    tree = spark.createDataFrame([(a, b, 2.0 if i == 299 else 1.0) for i, (a, b) in enumerate(zip(keys, keys[1:]))], linkage.EDGES)
    sizes = sorted((r["cluster"], r["count"]) for r in linkage.cut(points, tree, height=1.0).groupBy("cluster").count().collect())
    assert sizes == [("0000", 300), ("0300", 200)]


@pytest.mark.parametrize("first_lost", [False, True])
def test_points_without_a_place(spark, first_lost):
    """Missing and endless coordinates give the same edges in cells as in one task."""
    rng = np.random.default_rng(3)
    rows = [(f"{i:03}", v) for i, v in enumerate(rng.normal(size=(90, 2)).tolist())]
    for i in (17, 40, 0) if first_lost else (17, 40):
        rows[i] = (rows[i][0], [None if i == 17 else float("inf") if i == 40 else float("nan"), rows[i][1][1]])
    points = spark.createDataFrame(rows, "key string, x array<double>")
    one, cells = ({tuple(r) for r in linkage.spanning_tree(points, block_rows=b).collect()} for b in (4_096, 16))
    assert len(one) == 89 and cells == one
