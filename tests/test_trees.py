"""Tree ensembles against a plain recursion, and the same trees however they are grown."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from gridsmith import session
from gridsmith.operators import select, train, trees
from gridsmith.session import LIMITS


def plain(spec, x, y, w, seed, depth, gains):
    """One node as a dictionary, by trying every cut."""
    total = spec.table(y, w).sum(axis=1)[:, None]
    node = {"value": total[:, 0]}
    if not spec.impure(total)[0] or len(y) < 2 or depth <= 0:
        return node
    seeds, best, tried = np.array([seed], np.uint64), (-np.inf, None, None), 0
    for f in spec.order(seeds)[0]:
        values = np.unique(x[f])
        if tried < spec.tried and len(values) > 1:
            tried += 1
            cuts = spec.draw(seeds, int(f), values[:1], values[-1:]) if spec.random_cuts else (values[1:] + values[:-1]) / 2
            for c in cuts:
                left = spec.table(y, w)[:, x[f] <= c].sum(axis=1)[:, None]
                gain = float((spec.score(left) + spec.score(total - left) - spec.score(total))[0])
                if gain > best[0] + 1e-12:
                    best = gain, f, float(c)
    if best[1] is None:
        return node
    gains[best[1]] += max(best[0], 0)
    low, (a, b) = x[best[1]] <= best[2], trees.children(seeds)
    sides = [plain(spec, x[:, m], y[m], w[m], s, depth - 1, gains) for m, s in ((low, a), (~low, b))]
    return node | {"feature": best[1], "cut": best[2], "sides": sides}


def same(node, packed, i=0):
    assert np.allclose(packed["value"][i], node["value"])
    if "sides" not in node:
        assert packed["feature"][i] == -1
        return
    assert packed["feature"][i] == node["feature"] and packed["cut"][i] == pytest.approx(node["cut"])
    for k, side in enumerate(node["sides"]):
        same(side, packed, packed["left"][i] + k)


@pytest.mark.parametrize("case", range(48))
def test_growth_is_that_of_a_plain_recursion(case):
    rng = np.random.default_rng(case)
    n, d, classes = int(rng.integers(2, 80)), int(rng.integers(1, 5)), [0, 2, 3][case % 3]
    x = rng.integers(0, 6, (d, n)).astype(float)
    y, w = rng.integers(0, classes or 9, n).astype(float), rng.integers(1, 3, n).astype(float)
    spec = trees.Spec(classes, d, int(rng.integers(1, d + 1)), 1, [100, 3][case % 2], False, case % 4 == 1, case)
    gains = np.zeros(d)
    want = plain(spec, x, y, w, spec.root(0), spec.depth, gains)
    got, found = trees.grow(spec, x, y, w, spec.root(0), spec.depth)
    same(want, got)
    assert np.allclose(found, gains)
    shuffled = rng.permutation(n)
    again, _ = trees.grow(spec, x[:, shuffled], y[shuffled], w[shuffled], spec.root(0), spec.depth)
    assert all(np.allclose(got[k], again[k]) for k in got)


def ring(spark, n=1_500, parts=3):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (n, 3)).round(3)
    rows = [(i, *map(float, r), float(r[0] ** 2 + r[1] ** 2 < 0.5) + float(r[0] > 0.9)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, noise double, label double").repartition(parts)
    return VectorAssembler(inputCols=["a", "b", "noise"], outputCol="features").transform(df)


def predicted(model, df):
    return {r["id"]: r["prediction"] for r in model.transform(df).select("id", "prediction").collect()}


@pytest.mark.parametrize("random_cuts, classes", [(False, 3), (True, 3), (False, 0), (True, 0)])
def test_same_trees_for_any_partitioning_and_dealing(spark, monkeypatch, random_cuts, classes):
    maker = lambda: trees.Trees(classes, 4, None, "sqrt", bootstrap=not random_cuts, random_cuts=random_cuts, key="id")
    one = maker().fit(ring(spark, parts=1))
    df = ring(spark, parts=7)
    want = predicted(one, df)
    monkeypatch.setattr(LIMITS, "broadcast_bytes", 0)  # rows are dealt once a tree
    dealt = maker().fit(df)
    assert np.allclose(dealt.importances, one.importances)
    assert all(abs(want[i] - v) < 1e-9 for i, v in predicted(dealt, df).items())
    monkeypatch.setattr(trees, "CELLS", 2_500)  # the upper levels come from aggregates
    monkeypatch.setattr(trees, "PASS_CELLS", 3_000)
    monkeypatch.setattr(trees, "MODEL_BYTES", 20_000)
    first, second = maker().fit(df), maker().fit(ring(spark, parts=2))
    assert max(len(t["feature"]) for t in first.tops) > 3
    a, b = predicted(first, df), predicted(second, df)
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)
    assert first.importances[2] < 0.2 and np.allclose(first.importances, one.importances, atol=0.1)
    truth = {r["id"]: r["label"] for r in df.select("id", "label").collect()}
    for model in (one, first):
        found = predicted(model, df)
        assert sum(abs(found[i] - truth[i]) < 0.5 for i in truth) >= 0.95 * len(truth)


def leaves(model):
    """Feature and cut on the way to each leaf, and its sums."""
    out, held = set(), model._loaded(model.parts.collect())

    def walk(t, nodes, i, way):
        f = int(nodes["feature"][i])
        if f < -1:
            return walk(t, held[t][-2 - f], 0, way)
        if f < 0:
            return out.add((t, way, tuple(np.round(nodes["value"][i], 6))))
        for k in (0, 1):
            walk(t, nodes, int(nodes["left"][i]) + k, (*way, (f, round(float(nodes["cut"][i]), 9), k)))

    for t, top in enumerate(model.tops):
        walk(t, top, 0, ())
    return out


@pytest.mark.parametrize("classes", [3, 0])
def test_large_nodes_have_the_cuts_of_small_ones(spark, monkeypatch, classes):
    """Noise, ties, a rare value, constant features and a rule: whatever the size, one tree."""
    rng = np.random.default_rng(6)
    n = 1_500
    x = np.column_stack([rng.normal(size=n) ** 3, rng.integers(0, 5, n), np.where(np.arange(n) % 700 == 3, -1.0, 2.0), *[np.ones(n)] * 9, rng.normal(size=n)])
    y = (x[:, 0] > 0.1) + (rng.integers(0, 3, n) == 1) if classes else rng.integers(0, 50, n) + 9 * (x[:, 1] > 2)
    names = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], ["id", *names, "label"]).repartition(3)
    df = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    fit = lambda: trees.Trees(classes, 2, 4, "sqrt", key="id").fit(df)
    small = fit()
    monkeypatch.setattr(trees, "CELLS", 4_000)
    monkeypatch.setattr(trees, "BINS", 8)
    large = fit()
    assert max(len(t["feature"]) for t in large.tops) > 3 and leaves(large) == leaves(small)
    assert np.allclose(large.importances, small.importances)


def test_root_of_a_large_table(spark, monkeypatch, tmp_path):
    """The registered root queries where the root, and each child, is too large for one task."""
    import duckdb
    from __spark_entry__ import QUERIES, SQL

    rng = np.random.default_rng(2)
    rows = [(i, i % 4, float(rng.integers(1, 51)), float(rng.integers(90_000, 9_000_000)) / 100, int(rng.integers(0, 11)) / 100, int(rng.integers(0, 9)) / 100) for i in range(3_000)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(trees, "CELLS", 700)
    for name in ("tree_first_split", "tree_first_split_numeric"):
        lineitem = duckdb.read_parquet(f"{tmp_path}/lineitem.parquet/*.parquet")  # noqa: F841
        want = duckdb.sql(SQL[name]).fetchall()
        assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == want


def test_without_bootstrap_leaves_are_pure(spark):
    df = ring(spark)
    model = trees.Trees(3, 3, None, "sqrt", bootstrap=False).fit(df)
    assert predicted(model, df) == {r["id"]: r["label"] for r in df.collect()}


def test_extra_trees_follow_a_rule_better_than_coarse_bins(spark):
    from pyspark.ml.classification import RandomForestClassifier

    df, held = ring(spark), ring(spark, 4_000).where("id >= 1500")
    share = lambda m: held.count() and m.transform(held).where("prediction = label").count() / held.count()
    extra = train.catalogue(train.CLASSIFICATION, 3)["Extra Trees"]().fit(df)
    coarse = RandomForestClassifier(numTrees=100, maxDepth=15, bootstrap=False, featureSubsetStrategy="sqrt", maxBins=8, seed=42).fit(df)
    assert share(extra) > share(coarse)


def test_saved_bundle(spark, tmp_path):
    df = ring(spark).select("id", "a", "b", "noise", "label").withColumnRenamed("label", "kind")
    bundle = train.benchmark(df, "kind", "id", ["Extra Trees"], cv_folds=0, task=train.CLASSIFICATION).bundles["Extra Trees"]
    bundle.save(spark, str(tmp_path / "b"))
    again = train.ModelBundle.load(spark, str(tmp_path / "b"))
    rows = df.drop("kind")
    assert sorted(map(tuple, again.score(rows).collect())) == sorted(map(tuple, bundle.score(rows).collect()))


def test_importance_of_a_planted_column(spark):
    df = ring(spark).selectExpr("id", "a", "noise", "cast(a > 0.25 as int) AS target")
    got = {r["feature"]: r["importance"] for r in select.tree_importance(df, "target", ["a", "noise"], 20, key="id").collect()}
    assert got["a"] > 0.9 and sum(got.values()) == pytest.approx(1)


@pytest.mark.parametrize("classes", [0, 3])
def test_large_trees_stay_with_tasks(spark, monkeypatch, classes):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, float(rng.integers(0, 40)), float(rng.normal()), float(rng.integers(0, classes or 9))) for i in range(600)], "k long, a double, b double, label double")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    model = trees.Trees(classes, 3, None, "all", bootstrap=False, random_cuts=True).fit(rows)
    want = sorted(tuple(r) for r in model.transform(rows).select("k", "prediction").collect())
    monkeypatch.setattr(trees, "RANDOM_CELLS", 200, raising=False)
    monkeypatch.setattr(trees, "MODEL_BYTES", 100)
    monkeypatch.setattr(trees, "DEALT_ROWS", 7, raising=False)
    model = trees.Trees(classes, 3, None, "all", bootstrap=False, random_cuts=True).fit(rows)
    assert model.parts.count() > 20
    whole = []
    monkeypatch.setattr(trees.TreesModel, "_loaded", lambda self, rows: whole.append(len(rows)))
    found = sorted(tuple(r) for r in model.transform(rows).select("k", "prediction").collect())
    assert not whole
    assert [k for k, _ in found] == [k for k, _ in want] and np.allclose([p for _, p in found], [p for _, p in want])


def test_features_are_summed_once_a_level(monkeypatch):
    """Trees that try every feature look at each once a level for all nodes together, and
    equal gains fall to the feature a node tries first."""
    calls = []
    sides = trees._Rows.sides
    monkeypatch.setattr(trees._Rows, "sides", lambda *a: calls.append(1) or sides(*a))
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (6, 400)).astype(np.float64)
    x[5] = x[4]
    y = x[0] * 3 + x[1] + rng.normal(size=400)
    spec = trees.Spec(0, 6, 6, 1, 5, False, True, 7)
    nodes, _ = trees.grow(spec, x, y, np.ones(400), spec.root(0), 5)
    assert len(calls) <= 6 * 5
    at = trees.route(nodes, x)
    assert nodes["value"][at][:, 0].sum() >= 400 and np.allclose(nodes["value"][0], [400, y.sum(), (y * y).sum()])


def test_rows_are_dealt_in_blocks(spark, monkeypatch):
    """What a batch of rows gives a part of a tree leaves it as one record."""
    monkeypatch.setattr(trees, "RANDOM_CELLS", 700)
    dealt = []
    rows = spark.range(0, 2_000, 1, 2).selectExpr("array(double(id % 7), double(id % 11)) AS x", "double(id % 5) AS label", "id AS key")
    group = type(rows).groupBy
    monkeypatch.setattr(type(rows), "groupBy", lambda self, *c: (dealt.append(self) if c == ("tree", "part") else None) or group(self, *c))
    spec = trees.Spec(0, 2, 2, 3, 4, False, True, 3)
    growing = trees._Growing(spec, rows, 2_000, np.array([2_000.0, 4_000.0, 12_000.0]))
    growing.run()
    growing.finished()
    parts = sum(len(t.parts) for t in growing.trees)
    assert parts and dealt[0].count() <= 2 * parts


def test_rows_of_many_passes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(LIMITS, "spread_rows", 100)
    rows = spark.range(0, 300, 1, 1).selectExpr("id AS k", "id % 3 AS v")
    whole = session.spread(rows, "k")
    assert whole.rdd.getNumPartitions() > 1 and sorted(whole.collect()) == sorted(rows.collect())
    assert session.spread(rows.limit(99), "k").rdd.getNumPartitions() == 1
