"""Model operators held against SQL: signals planted in the tables, nearest rows and
centres, closed forms and totals that hold for any fitted model."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gridsmith.operators import autofe, chart, cluster, density, evaluate, mlprep, neighbors, score, select, train
from gridsmith.operators.neighbors import as_points

from .base import query, rnd, rounded, table, union
from .charts import MD5
from .modelling import EMB
from .unsupervised import _fit

# ---------------------------------------------------------------- planted signals

PLANTED = "SELECT p_partkey, (p_size % 10)::DOUBLE AS x, p_retailprice AS z, CASE WHEN p_size % 10 >= 5 THEN 'high' ELSE 'low' END AS y FROM part"


def planted(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "CAST(p_size % 10 AS DOUBLE) AS x", "p_retailprice AS z", "CASE WHEN p_size % 10 >= 5 THEN 'high' ELSE 'low' END AS y"
    )


def planted_line(spark, sf):
    return planted(spark, sf).withColumn("y", 3 * F.col("x") + 2)


def _names(task: str) -> str:
    return union([f"SELECT '{n}' AS \"Model\", count(*) > 10 AS learned FROM part" for n in train.model_names(task)])


@query("models_learn_classes", _names(train.CLASSIFICATION))
def models_learn_classes(spark, sf):
    """Accuracy of at least 0.85 on held-out rows of a planted rule."""
    board = train.benchmark(planted(spark, sf), "y", "p_partkey", cv_folds=0).leaderboard
    return board.select("Model", (F.col("Accuracy") >= 0.85).alias("learned"))


@query("models_learn_line", _names(train.REGRESSION))
def models_learn_line(spark, sf):
    """R2 of at least 0.8 on held-out rows of a planted line."""
    board = train.benchmark(planted_line(spark, sf), "y", "p_partkey", cv_folds=0, task=train.REGRESSION).leaderboard
    return board.select("Model", (F.col("R2 Score") >= 0.8).alias("learned"))


@query("planted_predictions", f"SELECT p_partkey, x, z, y AS \"Prediction\" FROM ({PLANTED})")
def planted_predictions(spark, sf):
    df = planted(spark, sf)
    done = train.benchmark(df, "y", "p_partkey", ["Decision Tree"], cv_folds=0)
    return score.supervised(done.bundles[done.best()], df.drop("y"), "p_partkey")


@query("cross_validated_tree", "SELECT 'Decision Tree' AS \"Model\", avg(CASE WHEN p_size >= 0 THEN 1.0 END) AS \"CV Accuracy\" FROM part")
def cross_validated_tree(spark, sf):
    board = train.benchmark(planted(spark, sf), "y", "p_partkey", ["Decision Tree"], cv_folds=4).leaderboard
    return rounded(board.select("Model", "CV Accuracy"), 6)


@query("best_of_benchmark", f"SELECT 'Decision Tree' AS best, count(DISTINCT y) AS classes FROM ({PLANTED})")
def best_of_benchmark(spark, sf):
    """The rule has no straight border when every other value is turned round: a tree learns it, a linear model does not."""
    df = planted(spark, sf).withColumn("y", F.when(F.col("x") % 2 == 0, "high").otherwise("low"))
    done = train.benchmark(df, "y", "p_partkey", ["Logistic Regression", "Decision Tree"], cv_folds=0)
    return df.agg(F.count_distinct("y").alias("classes")).select(F.lit(done.best()).alias("best"), "classes")


@query("importance_of_planted", "SELECT DISTINCT 'x' AS feature, true AS most FROM part")
def importance_of_planted(spark, sf):
    found = autofe.importance(planted(spark, sf), "y", "p_partkey")
    return found.limit(1).select("feature", (F.col("importance") > 0.8).alias("most"))


@query("forest_importance_of_planted", "SELECT DISTINCT 'x' AS feature, true AS most FROM part")
def forest_importance_of_planted(spark, sf):
    found = select.tree_importance(planted(spark, sf), "y", ["x", "z"], num_trees=20)
    return found.limit(1).select("feature", (F.col("importance") > 0.5).alias("most"))


@query("baseline_of_planted", "SELECT 'accuracy' AS metric, count(*) >= 0 AS full FROM part")
def baseline_of_planted(spark, sf):
    """The planted rule is learned in every fold, and all rows are evaluated."""
    base = autofe.prepare(planted(spark, sf), "y", "p_partkey").baseline()
    rows = table(spark, sf, "part")
    return rows.agg((F.count(F.lit(1)) == base["eval_rows"]).alias("all")).select(F.lit("accuracy").alias("metric"), (F.col("all") & F.lit(base["accuracy"] > 0.95)).alias("full"))


@query("impact_of_product", "SELECT DISTINCT 'x_x_z' AS feature_name, true AS is_recommended FROM part")
def impact_of_product(spark, sf):
    """A target that is the product of two columns is found as an interaction."""
    df = planted(spark, sf).withColumn("z", F.col("p_partkey") % 13 - 6.0).withColumn("x", F.col("x") - 4.5).withColumn("y", F.col("x") * F.col("z"))
    evaluation = autofe.prepare(df, "y", "p_partkey", train.REGRESSION, cv=3, trees=10, depth=4)
    found = [c for c in autofe.candidates(df.drop("p_partkey"), ["x", "z"], "y") if c.name == "x_x_z"]
    tested = autofe.impact(evaluation, found, evaluation.baseline()["primary_score"])
    return spark.createDataFrame([(r[0], r[6]) for r in tested], "feature_name string, is_recommended boolean")


@query("prep_routes", union([
    f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 20 THEN 'onehot' ELSE 'ordinal' END AS branch FROM part" for c in ("p_brand", "p_type", "p_name")
] + [f"SELECT DISTINCT '{c}', 'numeric' FROM part" for c in ("p_size", "p_retailprice")]))
def prep_routes(spark, sf):
    df = table(spark, sf, "part")
    prep = mlprep.build(df, ["p_brand", "p_type", "p_name", "p_size", "p_retailprice"])
    rows = [(c, b) for b, cs in (("numeric", prep.numeric), ("onehot", prep.low), ("ordinal", prep.high)) for c in cs]
    return spark.createDataFrame(rows, "column string, branch string")


# ---------------------------------------------------------------- closed forms


def _one_feature(spark, sf, name):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.col("l_extendedprice").alias("label"))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(df)
    model = train.catalogue(train.REGRESSION, rows=df.count())[name]().fit(rows.select("features", "label"))
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


def _line_sql(slope: str) -> str:
    sums = "SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_extendedprice, l_quantity) AS cxy, var_pop(l_quantity) AS vx FROM lineitem"
    return f"SELECT {rnd(slope, 3)} AS slope, {rnd(f'my - ({slope}) * mx', 2)} AS intercept FROM ({sums})"


@query("ridge_one_feature", _line_sql("n * cxy / (n * vx + 1)"))
def ridge_one_feature(spark, sf):
    return rounded(rounded(_one_feature(spark, sf, "Ridge Regression"), 3, "slope"), 2, "intercept")


@query("lasso_one_feature", _line_sql("sign(cxy) * greatest(abs(cxy) - 1, 0) / vx"))
def lasso_one_feature(spark, sf):
    return rounded(rounded(_one_feature(spark, sf, "Lasso Regression"), 3, "slope"), 2, "intercept")


KNN_MEAN = (
    f"e AS ({EMB}), s AS (SELECT *, row_number() OVER (ORDER BY {MD5.format(k='vec_id')}, vec_id) <= ceil((SELECT count(*) FROM e) * 0.2) AS test FROM e), "
    "d AS (SELECT a.vec_id, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rn FROM s a JOIN s b ON a.test AND NOT b.test)"
)


@query("knn_regression", f"WITH {KNN_MEAN} SELECT vec_id, {rnd('avg(other % 17)', 8)} AS prediction FROM d WHERE rn <= 5 GROUP BY 1")
def knn_regression(spark, sf):
    from gridsmith.operators import split

    df = table(spark, sf, "embeddings").select(
        "vec_id", (F.col("vec_id") % 17).cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    fit_rows, test = split.train_test(df, "vec_id")
    return rounded(neighbors.Knn(5, False, "vec_id").fit(fit_rows).transform(test).select("vec_id", "prediction"), 8)


@query("metric_mixed_types", "SELECT avg(CASE WHEN (n_chars > 1000)::INT = quality THEN 1.0 ELSE 0.0 END) AS accuracy FROM labels JOIN documents USING (doc_id)")
def metric_mixed_types(spark, sf):
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    pred = docs.select("quality", (F.col("n_chars") > 1000).cast("double").alias("guess"))
    return evaluate.classification(pred, "quality", "guess").select("accuracy")


# ---------------------------------------------------------------- clusters


def _same_label(bundle, scored):
    own = bundle.assigned.select("c_custkey", F.col("Cluster").alias("_own"))
    return scored.join(own, "c_custkey").select("c_custkey", (F.col("Cluster") == F.col("_own")).alias("same"))


@query("kmeans_scores_training_rows", "SELECT c_custkey, true AS same FROM customer")
def kmeans_scores_training_rows(spark, sf):
    df, b = _fit(spark, sf, cluster.KMEANS, n_clusters=3)
    return _same_label(b, score.unsupervised(b, df))


@query("kmeans_nearest_mean", "SELECT c_custkey, true AS same FROM customer")
def kmeans_nearest_mean(spark, sf):
    """Every row lies nearest to the mean of its own cluster in prepared space."""
    df, b = _fit(spark, sf, cluster.KMEANS, n_clusters=3)
    rows = b.prep.transform(df, "_features").select("c_custkey", vector_to_array("_features").alias("x")).join(b.assigned.select("c_custkey", "Cluster"), "c_custkey")
    at = F.posexplode("x").alias("i", "v")
    cells = rows.select("c_custkey", "Cluster", at)
    means = cells.groupBy(F.col("Cluster").alias("c"), "i").agg(F.avg("v").alias("m"))
    gaps = cells.join(F.broadcast(means), "i").groupBy("c_custkey", "Cluster", "c").agg(F.round(F.sum((F.col("v") - F.col("m")) ** 2), 6).alias("d"))
    own = gaps.groupBy("c_custkey").agg(F.min("d").alias("least"), F.min(F.when(F.col("c") == F.col("Cluster"), F.col("d"))).alias("mine"))
    # Lloyd's steps end within a tolerance of the means
    return own.select("c_custkey", (F.col("mine") <= F.col("least") + 0.05).alias("same"))


@query("density_scores_core_rows", "SELECT count(*) > 0 AS some, true AS same FROM customer")
def density_scores_core_rows(spark, sf):
    df, b = _fit(spark, sf, cluster.DBSCAN, eps=0.5, min_samples=5)
    core = b.model.select(F.col("key").alias("c_custkey"), F.col("cluster").cast("string").alias("_own"))
    scored = score.unsupervised(b, df, "c_custkey").join(core, "c_custkey")
    return scored.agg((F.count(F.lit(1)) > 0).alias("some"), F.coalesce(F.bool_and(F.col("Cluster") == F.col("_own")), F.lit(True)).alias("same"))


REACHED = f"e AS ({EMB}), n AS (SELECT a.vec_id, count(*) AS reach FROM e a JOIN e b ON list_distance(a.x, b.x) <= 1.0 GROUP BY 1)"


@query("dbscan_embeddings_core", f"WITH {REACHED} SELECT vec_id, reach >= 5 AS is_core FROM n")
def dbscan_embeddings_core(spark, sf):
    points = as_points(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return density.label(points, 1.0, 5).select(F.col("key").alias("vec_id"), "is_core")


@query(
    "dbscan_embeddings_noise",
    f"WITH {REACHED}, c AS (SELECT e.* FROM e JOIN n USING (vec_id) WHERE reach >= 5) "
    "SELECT count(*) AS noise FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE list_distance(e.x, c.x) <= 1.0)",
)
def dbscan_embeddings_noise(spark, sf):
    points = as_points(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return density.label(points, 1.0, 5).agg(F.count_if(F.col("cluster") == -1).alias("noise"))


@query("anomaly_share", "SELECT count(*) AS n, true AS share FROM customer")
def anomaly_share(spark, sf):
    """Rows above the score quantile: the wanted share, but for rows tied at the threshold."""
    _, b = _fit(spark, sf, cluster.ISOLATION, contamination=0.05)
    n, found, tied = F.count(F.lit(1)), F.count_if(F.col("Cluster") == "Anomaly"), F.count_if(F.abs(F.col("Anomaly_Score") - F.lit(b.model.threshold)) < 1e-9)
    return b.assigned.agg(n.alias("n"), (F.abs(found - n * 0.05) <= tied + 1).alias("share"))


@query("anomaly_scores_training_rows", "SELECT c_custkey, true AS same FROM customer")
def anomaly_scores_training_rows(spark, sf):
    df, b = _fit(spark, sf, cluster.ISOLATION)
    scored = score.unsupervised(b, df)
    own = b.assigned.select("c_custkey", "Cluster", F.round("Anomaly_Score", 4).alias("s"))
    return scored.join(own, "c_custkey").select("c_custkey", ((F.col("Anomaly_Label") == F.col("Cluster")) & (F.abs(F.col("Anomaly_Score") - F.col("s")) < 2e-4)).alias("same"))


def _scaled(name):
    return f"({name} - avg({name}) OVER ()) / stddev_pop({name}) OVER ()"


@query(
    "silhouette_squared",
    f"WITH p AS (SELECT c_custkey AS id, c_nationkey % 2 AS c, {_scaled('c_acctbal')} AS a, {_scaled('c_nationkey')} AS b FROM customer), "
    "m AS (SELECT c, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a * a + b * b) AS q FROM p GROUP BY 1), "
    "d AS (SELECT p.id, p.c AS own, m.c, m.n, (p.a * p.a + p.b * p.b - 2 * (p.a * m.ma + p.b * m.mb) + m.q) AS d FROM p, m), "
    "s AS (SELECT id, max(CASE WHEN own = c THEN d * n / (n - 1) END) AS a, min(CASE WHEN own <> c THEN d END) AS b FROM d GROUP BY 1) "
    f"SELECT {rnd('avg((b - a) / greatest(a, b))', 6)} AS silhouette FROM s",
)
def silhouette_squared(spark, sf):
    return _silhouette(spark, sf, cluster.silhouette)


@query(
    "silhouette_euclidean",
    f"WITH p AS (SELECT c_custkey AS id, c_nationkey % 2 AS c, {_scaled('c_acctbal')} AS a, {_scaled('c_nationkey')} AS b FROM customer), "
    "m AS (SELECT c AS k, count(*) AS n FROM p GROUP BY 1), "
    "d AS (SELECT x.id, x.c AS own, y.c, sum(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) AS t FROM p x, p y GROUP BY 1, 2, 3), "
    "s AS (SELECT id, max(CASE WHEN own = c THEN t / (n - 1) END) AS a, min(CASE WHEN own <> c THEN t / n END) AS b FROM d JOIN m ON m.k = d.c GROUP BY 1) "
    f"SELECT {rnd('avg((b - a) / greatest(a, b))', 6)} AS silhouette FROM s",
)
def silhouette_euclidean(spark, sf):
    return _silhouette(spark, sf, cluster.silhouette_euclidean)


def _silhouette(spark, sf, measure):
    df = table(spark, sf, "customer")
    vectors = mlprep.build(df, ["c_acctbal", "c_nationkey"]).transform(df)
    rows = vectors.select(F.col("c_custkey").alias("_key"), "features", (F.col("c_nationkey") % 2).cast("int").alias("_cluster"))
    return rounded(spark.createDataFrame([(measure(rows),)], "silhouette double"), 6)


@query("pca_keeps_variance", f"SELECT {rnd('0.0 * count(*)', 6)} AS mean, 2.0 AS variance FROM customer")
def pca_keeps_variance(spark, sf):
    """Two prepared columns have variance 1 each, and a rotation keeps the sum."""
    df = table(spark, sf, "customer")
    vectors = mlprep.build(df, ["c_acctbal", "c_nationkey"]).transform(df)
    flat = cluster.pca_2d(vectors)
    out = flat.agg((F.abs(F.avg("PCA1")) + F.abs(F.avg("PCA2"))).alias("mean"), (F.var_pop("PCA1") + F.var_pop("PCA2")).alias("variance"))
    return rounded(out, 6)


@query("cluster_histogram_total", "SELECT count(*) AS \"rows\" FROM customer")
def cluster_histogram_total(spark, sf):
    _, b = _fit(spark, sf, cluster.KMEANS, n_clusters=3)
    return chart.histogram(b.assigned, "c_acctbal", color="Cluster").agg(F.sum("count").cast("long").alias("rows"))


@query("linkage_nearest_mean", union([f"SELECT '{k}' AS linkage, 4 AS clusters, count(*) AS \"rows\" FROM customer" for k in cluster.LINKAGES]))
def linkage_nearest_mean(spark, sf):
    out = None
    for name in cluster.LINKAGES:
        _, b = _fit(spark, sf, cluster.AGGLOMERATIVE, n_clusters=4, linkage=name)
        one = b.assigned.agg(F.lit(name).alias("linkage"), F.count_distinct("Cluster").cast("int").alias("clusters"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out
