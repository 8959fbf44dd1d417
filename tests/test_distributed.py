"""The distributed forms give the results of the one-pass forms, hot groups included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridsmith.functions import distributed as d
from gridsmith.functions.graph import components
from gridsmith.operators import chart, clean, density, encode, evaluate, features, neighbors, relate, scale, split


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one group and one value; some keys are missing."""
    rng = np.random.default_rng(3)
    n = 1500
    g = np.where(np.arange(n) % 3 == 0, "hot", rng.choice([f"g{i}" for i in range(60)], n))
    v = np.where(np.arange(n) % 3 == 1, 7.0, np.round(rng.gamma(2, 10, n), 2))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v, "y": rng.integers(0, 2, n)})
    pdf.loc[pdf.id % 17 == 0, "g"] = None
    pdf.loc[pdf.id % 23 == 0, "v"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, g string, v double, y int")
    return df.repartition(6).cache(), pdf


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_quantiles(skewed, tiny_limits):
    df, pdf = skewed
    got = d.quantiles(df, ["v", "y"], PROBS)
    for c in ("v", "y"):
        assert got[c] == pytest.approx(list(pdf[c].quantile(PROBS)))


def test_quantiles_refine_more_than_once(spark, tiny_limits):
    x = np.random.default_rng(1).normal(size=20_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    assert d.quantiles(df, ["x"], PROBS)["x"] == pytest.approx(list(np.quantile(x, PROBS)))


def test_group_quantiles(skewed, tiny_limits):
    df, pdf = skewed
    got = {r["g"]: list(r["q"]) for r in d.group_quantiles(df, ["g"], "v", [0.25, 0.5]).collect()}
    want = pdf.groupby("g", dropna=False)["v"].quantile([0.25, 0.5]).unstack()
    assert len(got) == len(want)
    for g, q in want.iterrows():
        assert got[None if pd.isna(g) else g] == pytest.approx(list(q))


def test_running_totals_both_directions(skewed, tiny_limits):
    df, pdf = skewed
    counts = df.where("v is not null and g is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for down in (False, True):
        got = rows(d.running_totals(counts, ["g"], "v", ["n"], 1500, down), "g", "v")
        want = pdf.dropna().groupby(["g", "v"]).size().rename("n").reset_index().sort_values(["g", "v"], ascending=[True, not down])
        want["cum"] = want.groupby("g")["n"].cumsum()
        want = want.sort_values(["g", "v"])
        assert got == [tuple(r) for r in want.itertuples(index=False)]


def test_hash_rank(skewed, tiny_limits):
    df, _ = skewed
    big = rows(d.hash_rank(df, "id", 42, ["g"]).select("id", "rn"), "id")
    tiny_limits.single_task_rows = 10_000
    assert big == rows(d.hash_rank(df, "id", 42, ["g"]).select("id", "rn"), "id")


def test_lookup_join(skewed, tiny_limits):
    df, pdf = skewed
    table = df.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    got = {r["id"]: r["s"] for r in d.lookup_join(df, table, ["g"], "n").collect()}
    want = pdf.groupby("g")["v"].sum()
    assert len(got) == len(pdf)
    for r in pdf.itertuples():
        assert got[r.id] is None if pd.isna(r.g) else got[r.id] == pytest.approx(want[r.g])


def test_label_frequency_and_groups(skewed, tiny_limits, monkeypatch):
    df, pdf = skewed
    monkeypatch.setattr(encode, "LITERAL_LEVELS", 3)
    codes = pdf["g"].astype("category").cat.codes
    got = [r["g"] for r in encode.label(df, ["g"]).transform(df).orderBy("id").collect()]
    assert got == list(codes)
    share = pdf["g"].map(pdf["g"].value_counts(normalize=True)).fillna(0)
    got = [r["g_freq"] for r in encode.frequency_feature(df, "g").transform(df).orderBy("id").collect()]
    assert got == pytest.approx(list(share))
    out = features.group_features(df, "g", "v", ["mean", "median"]).transform(df).orderBy("id").toPandas()
    for f in ("mean", "median"):
        want = pdf.groupby("g")["v"].transform(f)
        assert np.allclose(out[f"v_by_g_{f}"].astype(float), want, equal_nan=True)


def test_spearman_and_kendall(skewed, tiny_limits):
    df, pdf = skewed
    got = relate.spearman(df, ["id", "v", "y"]).orderBy("position").collect()
    for r in got:
        both = pdf[[r["a"], r["b"]]].dropna()
        assert r["r"] == pytest.approx(both[r["a"]].rank().corr(both[r["b"]].rank()))
    both = pdf[["v", "y"]].dropna().to_numpy(dtype=float)
    assert relate.kendall(df, "v", "y", strip_rows=25).first()["r"] == pytest.approx(tau_b(both[:, 0], both[:, 1]))
    both = pdf[["id", "v"]].dropna().to_numpy(dtype=float)
    assert relate.kendall(df, "id", "v", strip_rows=25).first()["r"] == pytest.approx(tau_b(both[:, 0], both[:, 1]))


def tau_b(x, y):
    a, b = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (a * b).sum() / np.sqrt((a != 0).sum() * (b != 0).sum())


def test_ecdf_roc_auc(skewed, tiny_limits):
    df, pdf = skewed
    got = {r["value"]: r["share"] for r in chart.ecdf(df, "v").collect()}
    v = np.sort(pdf["v"].dropna())
    for x, s in got.items():
        assert s == pytest.approx((v <= x).mean())
    live, p = df.where("v is not null"), pdf.dropna(subset=["v"])
    area = evaluate.auc(live, "y", "v").first()["auc"]
    pos, neg = p[p.y == 1]["v"].to_numpy(), p[p.y == 0]["v"].to_numpy()
    diff = pos[:, None] - neg[None, :]
    assert area == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())


def test_box_and_bins(skewed, tiny_limits):
    df, pdf = skewed
    got = {r["g"]: r for r in chart.box(df, "v", "g").collect()}
    for g, part in pdf.dropna().groupby("g"):
        q1, q3 = part["v"].quantile(0.25), part["v"].quantile(0.75)
        out = ((part["v"] < q1 - 1.5 * (q3 - q1)) | (part["v"] > q3 + 1.5 * (q3 - q1))).sum()
        assert (got[g]["count"], got[g]["outliers"]) == (len(part), out)
    codes = [r["v_binned"] for r in features.bins(df, "v", 4).transform(df).orderBy("id").collect()]
    want = pd.qcut(pdf["v"], 4, labels=False, duplicates="drop")
    assert [(-1 if c is None else c) for c in codes] == list(want.fillna(-1).astype(int))


def test_split_and_folds(skewed, tiny_limits):
    df, pdf = skewed
    live = df.where("g is not null")
    got = split.assign(live, "id", 0.3, stratify="g").groupBy("g", "split").count().collect()
    tests = {r["g"]: r["count"] for r in got if r["split"] == "test"}
    sizes = pdf.dropna(subset=["g"]).groupby("g").size()
    assert sum(tests.values()) == int(np.ceil(sizes.sum() * 0.3))
    for g, n in sizes.items():
        assert abs(tests.get(g, 0) - 0.3 * n) < 1
    per = split.folds(live, "id", 4, stratify="g").groupBy("g", "fold").count().groupBy("g").agg((F.max("count") - F.min("count")).alias("d"))
    assert per.agg(F.max("d")).first()[0] <= 1


@pytest.mark.parametrize("dims,eps", [(1, 0.02), (2, 0.2), (3, 0.45), (6, 1.4)])
@pytest.mark.parametrize("grid", [True, False])
def test_density_clusters(spark, dims, eps, grid):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 0.3, (150, dims)), rng.normal(2, 0.4, (100, dims)), rng.uniform(-2, 4, (80, dims))])
    x = np.concatenate([x, np.repeat(x[:1], 60, 0)])
    df = spark.createDataFrame([(f"{i:05d}", [float(v) for v in r]) for i, r in enumerate(x)], "key string, x array<double>")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = dist <= eps
    core = near.sum(1) >= 5
    label, c = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = c
            while stack:
                for j in np.nonzero(near[stack.pop()] & core & (label < 0))[0]:
                    label[j] = c
                    stack.append(j)
            c += 1
    for i in np.nonzero(~core)[0]:
        js = np.nonzero(near[i] & core)[0]
        if len(js):
            label[i] = label[min(js, key=lambda j: (dist[i, j], label[j]))]
    got = density.label(df, eps, 5, block_rows=64, grid_dims=4 if grid else 0).orderBy("key").collect()
    assert [r["is_core"] for r in got] == list(core)
    assert [r["cluster"] for r in got] == list(label)


@pytest.mark.parametrize("block", [16, 4096])
def test_neighbors(spark, block):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (120, 3)), np.zeros((60, 3))])  # a third are copies
    q = rng.normal(0, 1, (40, 3))
    make = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "key long, x array<double>")
    got = neighbors.knn(make(q), make(x), 4, block_rows=block).orderBy("key", "rank").collect()
    dist = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    want = [(i, int(j)) for i in range(len(q)) for j in sorted(range(len(x)), key=lambda j: (dist[i, j], j))[:4]]
    assert [(r["key"], r["neighbor"]) for r in got] == want
    own = neighbors.knn(make(x), make(x), 3, exclude_same_key=True, block_rows=block)
    assert own.where("key = neighbor").count() == 0 and own.count() == 3 * len(x)


def test_components(spark):
    links = [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(80) if i % 10 != 9] + [("hub", f"v{i:03d}") for i in range(0, 40, 10)]
    edges = spark.createDataFrame(links, "a string, b string")
    one = sorted(map(tuple, components(edges).collect()))
    assert one == sorted(map(tuple, components(edges, 0).collect()))
    assert len({c for _, c in one}) == 5


def test_imputing_with_large_forms(skewed, tiny_limits):
    df, pdf = skewed
    out = clean.Imputer("auto").fit(df).transform(df).orderBy("id").toPandas()
    assert list(out["v"]) == pytest.approx(list(pdf["v"].fillna(pdf["v"].median())))
    assert list(out["g"]) == list(pdf["g"].fillna(pdf["g"].mode().iloc[0]))
    model = scale.fit(out_df := clean.Imputer("auto").fit(df).transform(df), ["v"], "robust")
    got = model.transform(out_df).orderBy("id").toPandas()["v"]
    v = pdf["v"].fillna(pdf["v"].median())
    assert list(got) == pytest.approx(list((v - v.median()) / (v.quantile(0.75) - v.quantile(0.25))))


def test_intermediates_are_written_and_dropped(spark, tmp_path, monkeypatch):
    from gridsmith import session

    monkeypatch.setattr(session, "checkpoint_dir", lambda s: str(tmp_path))
    kept = session.materialize(spark.range(5))
    assert kept.count() == 5 and any(tmp_path.rglob("*.parquet"))
    session.drop_intermediates(spark)
    assert not any(tmp_path.rglob("*.parquet"))


def test_crowded_cells_of_many_dimensions_are_not_compared_in_blocks(spark, monkeypatch):
    import numpy as np

    from gridsmith.operators import density

    rng = np.random.default_rng(3)
    x = np.concatenate([np.concatenate([rng.normal(0, 0.05, (150, 2)), np.tile(c, (150, 1))], axis=1) for c in np.eye(4)[:3] * 3] + [rng.normal(0, 6, (9, 6))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = (d <= 0.5).sum(1) >= 5
    monkeypatch.setattr(density, "_block_solve", None)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>")
    found = {r["key"]: r for r in density.label(rows, 0.5, 5).collect()}
    assert [found[i]["is_core"] for i in range(len(x))] == core.tolist()
    for i in range(450):
        assert found[i]["cluster"] == i // 150 or not (d[i] <= 0.5)[core].any()
    assert all(found[i]["cluster"] == -1 for i in range(450, 459) if not (d[i] <= 0.5)[core].any())


def test_product_distances_decide_as_plain_ones():
    import numpy as np

    from gridsmith.operators import density, neighbors

    for case in range(40):
        rng = np.random.default_rng(case)
        dims = int(rng.integers(1, 70))
        p, q = rng.integers(-2, 3, (60, dims)) + 1000.0 * (case % 3), rng.integers(-2, 3, (40, dims)) + 1000.0 * (case % 3)
        q[:10] = p[:10]
        if case % 2:
            p, q = p + rng.normal(0, 1e-9, p.shape), q + rng.normal(0, 1e-9, q.shape)
        plain = np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1))
        for eps in (0.0, float(np.median(plain)), 1.0):
            near = neighbors.within(q, p, eps)
            assert (near == (plain <= eps)).all()
            a, b = density._spanning(near)
            assert near.any() == bool(len(a)) and len(a) <= sum(near.shape)
            root = {}

            def find(v):
                while root.setdefault(v, v) != v:
                    v = root[v]
                return v

            for i, j in zip(a, b):
                root[find(("q", i))] = find(("p", j))
            assert all(find(("q", i)) == find(("p", j)) for i, j in zip(*np.nonzero(near)))
        some = neighbors.nearest_of(q, p, 5)
        kept = np.isfinite(some)
        assert (some[kept] == plain[kept]).all() and (plain[~kept] >= np.broadcast_to(np.sort(plain, axis=1)[:, 4:5], plain.shape)[~kept]).all()


def test_cluster_rows_are_dealt_over_cores(spark, monkeypatch):
    from gridsmith.operators import cluster
    from gridsmith.session import LIMITS

    monkeypatch.setattr(LIMITS, "spread_rows", 50)
    seen, merge = [], cluster._agglomerate
    monkeypatch.setattr(cluster, "_agglomerate", lambda rows, *rest: seen.append(rows.rdd.getNumPartitions()) or merge(rows, *rest))
    df = spark.range(200).coalesce(1).selectExpr("id", "cast(id % 4 * 100 + id % 3 as double) AS v")
    found = cluster.fit(df, ["v"], "id", cluster.AGGLOMERATIVE, n_clusters=4).assigned
    assert seen[0] == spark.sparkContext.defaultParallelism > 1
    assert found.groupBy("Cluster").agg(F.count_distinct(F.col("id") % 4).alias("n"), F.count("id").alias("rows")).where("n = 1 AND rows = 50").count() == 4


def test_neighbour_rows_are_dealt_over_cores(spark, monkeypatch):
    seen, expand = [], neighbors.candidate_cells
    monkeypatch.setattr(neighbors, "candidate_cells", lambda rows, *rest: seen.append(rows.rdd.getNumPartitions()) or expand(rows, *rest))
    rows = spark.range(300).coalesce(1).selectExpr("id AS key", "array(cast(id * id % 101 as double), cast(id % 7 as double)) AS x")
    found = neighbors.knn(rows, rows, 2, exclude_same_key=True, block_rows=32)
    x = np.array([[i * i % 101, i % 7] for i in range(300)], float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {(i, j) for i in range(300) for j in sorted((j for j in range(300) if j != i), key=lambda j: (d[i, j], j))[:2]}
    assert seen == [spark.sparkContext.defaultParallelism] and {(r["key"], r["neighbor"]) for r in found.collect()} == want


def test_pairs_hold_the_nearest():
    for case in range(30):
        rng = np.random.default_rng(case)
        dims, k = int(rng.integers(1, 70)), int(rng.integers(1, 6))
        p, q = rng.integers(-2, 3, (60, dims)) + 1000.0 * (case % 3), rng.integers(-2, 3, (40, dims)) + 1000.0 * (case % 3)
        if case % 2:
            p = p + rng.normal(0, 1e-9, p.shape)
        plain = np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1))
        barred = rng.random(plain.shape) < 0.1
        row, at, d = neighbors.nearest_pairs(q, p, k, barred)
        assert (d == plain[row, at]).all() and not barred[row, at].any()
        free = np.where(barred, np.inf, plain)
        kept = np.full(plain.shape, np.inf)
        kept[row, at] = d
        assert (np.sort(kept, axis=1)[:, :k] == np.sort(free, axis=1)[:, :k]).all()
    assert neighbors.nearest_pairs(np.array([[np.inf, 0.0]]), np.zeros((3, 2)), 1) is None
