"""Models by invariants on tables with a planted signal."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gridsmith.operators import autofe, balance, cluster, mlprep, score, select, split, train


@pytest.fixture(scope="module")
def planted(spark):
    """Class and amount depend on a and c; noise does not matter; some gaps."""
    rng = np.random.default_rng(11)
    n = 400
    a, noise = rng.normal(size=n), rng.normal(size=n)
    c = rng.choice(["u", "v", "w"], n)
    y = np.where(a + (c == "u") > 0.4, "yes", "no")
    amount = 3 * a + 2 * (c == "v") + rng.normal(0, 0.05, n)
    rows = [
        (i, None if i % 29 == 0 else float(a[i]), float(noise[i]), None if i % 31 == 0 else str(c[i]), str(y[i]), float(amount[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id long, a double, noise double, c string, y string, amount double").cache()


def test_comparison_and_saved_models(spark, planted, tmp_path):
    names = ["Decision Tree", "Logistic Regression", "K-Nearest Neighbors", "Support Vector Classifier"]
    done = train.benchmark(planted.drop("amount"), "y", "id", names, cv_folds=0)
    folds = train.cross_validate(planted.drop("amount"), "y", "id", ["a", "noise", "c"], done.task, train.Labels("y", ["no", "yes"]), names[:1], 2)
    assert 0.75 < folds[names[0]] <= 1
    board = done.leaderboard.collect()
    assert done.task == "Classification" and {r["Model"] for r in board} == set(names)
    assert [r["Accuracy"] for r in board] == sorted((r["Accuracy"] for r in board), reverse=True)
    assert min(r["Accuracy"] for r in board) > 0.75
    assert done.test.count() == 80
    for name in names:
        path = str(tmp_path / name.replace(" ", ""))
        done.bundles[name].save(spark, path)
        again = train.ModelBundle.load(spark, path)
        one = score.supervised(done.bundles[name], planted, "id").orderBy("id").collect()
        two = score.supervised(again, planted, "id").orderBy("id").collect()
        assert [r["Prediction"] for r in one] == [r["Prediction"] for r in two]
        assert one[0].asDict().keys() == {*planted.columns, "Prediction"} and one[1]["a"] == planted.where("id = 1").first()["a"]
    with pytest.raises(ValueError):
        score.supervised(done.bundles["Decision Tree"], planted.drop("a"))


def test_regression_models(planted):
    names = ["Linear Regression", "Ridge Regression", "Lasso Regression", "Decision Tree"]
    done = train.benchmark(planted.drop("y"), "amount", "id", names, cv_folds=0)
    got = {r["Model"]: r["R2 Score"] for r in done.leaderboard.collect()}
    assert done.task == "Regression" and got["Linear Regression"] > 0.85 and got["Lasso Regression"] < got["Ridge Regression"]
    with pytest.raises(ValueError):
        train.benchmark(planted.drop("y"), "amount", "id", names, strategy="smote")


def test_model_names():
    assert len(train.model_names("Classification")) == 7 and len(train.model_names("Regression")) == 9


def test_balancing(spark, planted):
    df = planted.withColumn("k", F.when(F.col("id") < 30, "rare").otherwise("common"))
    rows = mlprep.build(df, ["a", "noise"]).transform(df)
    for strategy, size in (("oversample", 370), ("undersample", 30), ("smote", 370)):
        out, info = balance.apply(rows.select("id", "k", "features"), "k", strategy, "id")
        assert {r["count"] for r in out.groupBy("k").count().collect()} == {size}
        assert info["applied"] and info["imbalance_ratio_before"] == pytest.approx(370 / 30)
    made = balance.smote(rows, "k", "id").where("synthetic").select(vector_to_array("features").alias("x")).collect()
    own = np.array([r["x"] for r in rows.where("k = 'rare'").select(vector_to_array("features").alias("x")).collect()])
    new = np.array([r["x"] for r in made])
    assert (new >= own.min(0) - 1e-9).all() and (new <= own.max(0) + 1e-9).all()
    tiny = rows.where("id < 4 or id >= 30")
    out, info = balance.apply(tiny.select("id", "k", "features"), "k", "smote", "id")
    assert info["warning"] and {r["count"] for r in out.groupBy("k").count().collect()} == {370}
    with pytest.raises(ValueError):
        balance.apply(rows, "k", "magic", "id")


def test_repeat_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(balance, "_CHUNK", 7)
    df = spark.createDataFrame([(1, 20), (2, 7), (3, 0), (4, 1)], "id int, n int")
    got = balance._repeat(df, F.col("n"), "id").groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("copy").alias("d"), F.max("copy").alias("m"))
    assert {r["id"]: (r["c"], r["d"], r["m"]) for r in got.collect()} == {1: (20, 20, 20), 2: (7, 7, 7), 4: (1, 1, 1)}


def test_preparation_of_unseen_values(spark, planted):
    prep = mlprep.build(planted, ["a", "c"])
    new = spark.createDataFrame([(1, None, "zzz"), (2, 1.0, None)], "id int, a double, c string")
    rows = prep.transform(new).orderBy("id").collect()
    assert [n for n, _ in prep.names] == ["a", "c_u", "c_v", "c_w"]
    assert list(rows[0]["features"].toArray()[1:]) == [0, 0, 0] and sum(rows[1]["features"].toArray()[1:]) == 1
    assert rows[0]["a"] is None  # input columns are returned as given


def test_feature_search(planted):
    squared = planted.select("id", "a", "noise", (F.col("a") * F.col("a") + F.lit(0.0)).alias("t")).na.drop()
    found = autofe.recommend(squared, "t", "id", cv=3, trees=10, depth=5, top=2)
    best = found.tested.first()
    assert best["feature_name"] in ("a_squared", "a_x_noise", "a_Binned") and best["improvement"] == max(r["improvement"] for r in found.tested.collect())
    assert found.importance.first()["feature"] == "a"
    out = autofe.fit_features(squared, [autofe.Candidate("a_squared", autofe.SQUARE, ("a",))]).transform(squared)
    assert out.where("abs(a_squared - t) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        autofe.prepare(planted.withColumn("one", F.lit("k")), "one", "id")


def test_forest_importance(planted):
    got = select.tree_importance(planted, "amount", ["a", "noise"], num_trees=20)
    assert got.first()["feature"] == "a"


def test_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.2, (60, 2)) for m in (0, 4, 9)])
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], "id int, p double, q double")
    truth = [i // 60 for i in range(180)]
    for algorithm, params in (
        (cluster.KMEANS, {"restarts": 2}), *[(cluster.AGGLOMERATIVE, {"linkage": k}) for k in ("ward", "average")], (cluster.DBSCAN, {"eps": 0.4}),
    ):
        b = cluster.fit(df, ["p", "q"], "id", algorithm, **params)
        labels = [r["Cluster"] for r in b.assigned.orderBy("id").collect()]
        assert b.n_clusters == 3 and len(set(zip(truth, labels))) == 3 and b.silhouette > 0.8
        assert b.centers.count() == 3
        again = [r["Cluster"] for r in b.score(df, "id").orderBy("id").collect()]
        assert again == labels
    far = spark.createDataFrame([(1, 100.0, 100.0)], "id int, p double, q double")
    assert b.score(far, "id").first()["Cluster"] == "-1"
    with pytest.raises(ValueError):
        cluster.fit(df.limit(3), ["p", "q"], "id")
    with pytest.raises(ValueError):
        cluster.fit(df, ["p", "q"], "id", "Spectral")
    peers = score.peers(b.assigned, labels[0], "id")
    assert [r["id"] for r in peers.collect()] == list(range(10))


def test_silhouette_and_projection(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) * [5, 2, 1]
    c = (x[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, c))], "_key int, x array<double>, _cluster int")
    rows = rows.withColumn("features", array_to_vector("x"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(50):
        own = (c == c[i]) & (np.arange(50) != i)
        a, b = d[i, own].mean(), d[i, c != c[i]].mean()
        s.append((b - a) / max(a, b))
    assert cluster.silhouette_euclidean(rows) == pytest.approx(np.mean(s))
    d, s = d**2, []
    for i in range(50):
        own = c == c[i]
        a, b = d[i, own].sum() / (own.sum() - 1), d[i, ~own].mean()
        s.append((b - a) / max(a, b))
    assert cluster.silhouette(rows) == pytest.approx(np.mean(s))
    assert cluster.silhouette(rows.where("_cluster = 0")) is None
    flat = cluster.pca_2d(rows).orderBy("_key").collect()
    centred = x - x.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = centred @ vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
    assert [r["PCA1"] for r in flat] == pytest.approx(list(want))


def test_isolation_forest_finds_planted_rows(spark):
    rng = np.random.default_rng(9)
    turn, reach = np.arange(10) * 0.63, rng.uniform(8, 14, 10)
    x = np.concatenate([rng.normal(size=(190, 2)), np.stack([reach * np.cos(turn), reach * np.sin(turn)], 1)])
    df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], "id int, p double, q double")
    b = cluster.fit(df, ["p", "q"], "id", cluster.ISOLATION, contamination=0.05)
    found = {r["id"] for r in b.assigned.where("Cluster = 'Anomaly'").collect()}
    assert len(found) == 10 and len(found & set(range(190, 200))) >= 9
    out = b.score(df)
    assert out.where("Anomaly_Label = 'Anomaly' and Anomaly_Score < 0.5").count() == 0
    assert {r["Label"]: r["Count"] for r in cluster.label_counts(b.assigned).collect()} == {"Anomaly": 10, "Normal": 190}


def test_split_is_reproducible_and_disjoint(planted):
    one, two = split.train_test(planted, "id", 0.25, stratify="y")
    again, _ = split.train_test(planted.repartition(7), "id", 0.25, stratify="y")
    ids = lambda d: {r["id"] for r in d.collect()}
    assert ids(one) == ids(again) and not ids(one) & ids(two) and len(ids(two)) == 100


@pytest.mark.parametrize("algorithm", [cluster.KMEANS, cluster.DBSCAN, cluster.ISOLATION])
def test_saved_clusters_score_alike(spark, tmp_path, algorithm):
    df = spark.range(120).selectExpr("id", "cast(id % 7 as double) AS a", "cast((id * 13) % 11 as double) + if(id = 5, 50, 0) AS b", "if(id % 2 = 0, 'x', 'y') AS c")
    bundle = cluster.fit(df, ["a", "b", "c"], "id", algorithm)
    bundle.save(spark, str(tmp_path / "b"))
    again = cluster.UnsupervisedBundle.load(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, again.score(df, "id").collect())) == sorted(map(tuple, bundle.score(df, "id").collect()))
    assert (again.n_clusters, again.silhouette, again.features) == (bundle.n_clusters, bundle.silhouette, bundle.features)
    assert again.assigned.count() == 120 and (again.centers is None) == (bundle.centers is None)


def test_euclidean_silhouette_moves_rows_by_large_blocks(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from gridsmith.operators import cluster

    rng = np.random.default_rng(2)
    x, c = rng.normal(0, 1, (2500, 2)), rng.integers(0, 3, 2500)
    rows = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c))], "_key long, x array<double>, _cluster int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sums = np.stack([d[:, c == k].sum(1) for k in range(3)])
    n = np.bincount(c)
    own = sums[c, np.arange(2500)] / (n[c] - 1)
    other = np.where(np.arange(3)[:, None] == c, np.inf, sums / n[:, None]).min(0)
    blocks, plain = [], F.pmod
    monkeypatch.setattr(cluster.F, "pmod", lambda a, b: blocks.append(b) or plain(a, b))
    found = cluster.silhouette_euclidean(rows.select("_key", array_to_vector("x").alias("features"), "_cluster"))
    assert np.isclose(found, ((other - own) / np.maximum(own, other)).mean())
    assert "1" in str(blocks[0])  # 2,500 rows are one block
