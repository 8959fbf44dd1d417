"""Clustering, anomaly and assignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsmith.operators import chart, cluster, density, mlprep, score
from gridsmith.operators.neighbors import as_points

from .base import query, rnd, rounded, table


def _fit(spark, sf, algorithm, **params):
    df = table(spark, sf, "customer")
    return df, cluster.fit(df, ["c_acctbal", "c_nationkey", "c_mktsegment"], "c_custkey", algorithm, **params)


def _assigned(algorithm, **params):
    def run(spark, sf):
        return _fit(spark, sf, algorithm, **params)[1].assigned

    return run


query("cluster_kmeans")(_assigned(cluster.KMEANS, n_clusters=3))
query("cluster_dbscan")(_assigned(cluster.DBSCAN, eps=0.5, min_samples=5))
query("anomaly_isolation_forest")(_assigned(cluster.ISOLATION, contamination=0.05))
for _linkage in cluster.LINKAGES:
    query(f"cluster_agglomerative_{_linkage}")(_assigned(cluster.AGGLOMERATIVE, n_clusters=4, linkage=_linkage))


@query("cluster_summary")
def cluster_summary(spark, sf):
    _, b = _fit(spark, sf, cluster.KMEANS, n_clusters=3)
    return spark.createDataFrame([(b.algorithm, b.n_clusters, b.silhouette)], "algorithm string, n_clusters int, silhouette double")


POINTS = "SELECT c_custkey AS id, c_acctbal / 500.0 AS a, c_nationkey::DOUBLE AS b FROM customer"
EPS, LEAST = 0.6, 4
REACH = (
    f"p AS ({POINTS}), n AS (SELECT x.id, count(*) AS reach FROM p x JOIN p y ON sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) <= {EPS} GROUP BY 1)"
)


def customer_points(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.array(F.col("c_acctbal") / 500.0, F.col("c_nationkey").cast("double")).alias("x")
    )


@query("dbscan_core", f"WITH {REACH} SELECT id AS key, reach >= {LEAST} AS is_core FROM n")
def dbscan_core(spark, sf):
    return density.label(customer_points(spark, sf), EPS, LEAST).select("key", "is_core")


@query(
    "dbscan_noise",
    f"WITH {REACH}, c AS (SELECT p.* FROM p JOIN n ON p.id = n.id WHERE reach >= {LEAST}) "
    f"SELECT count(*) AS noise FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE sqrt((p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b)) <= {EPS})",
)
def dbscan_noise(spark, sf):
    return density.label(customer_points(spark, sf), EPS, LEAST).where("cluster = -1").agg(F.count(F.lit(1)).alias("noise"))


@query(
    "dbscan_clusters",
    f"WITH RECURSIVE {REACH}, c AS (SELECT p.* FROM p JOIN n ON p.id = n.id WHERE reach >= {LEAST}), "
    f"e AS (SELECT x.id AS u, y.id AS v FROM c x JOIN c y ON sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) <= {EPS}), "
    "w AS (SELECT id, id AS root FROM c UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.id WHERE w.root < e.v), "
    "m AS (SELECT id, min(root) AS root FROM w GROUP BY 1) "
    "SELECT count(*) AS size FROM m GROUP BY root",
)
def dbscan_clusters(spark, sf):
    return density.label(customer_points(spark, sf), EPS, LEAST).where("is_core").groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).select("size")


@query(
    "cluster_centers",
    f"SELECT c_mktsegment AS \"Cluster\", {rnd('avg(c_acctbal)', 4)} AS c_acctbal, {rnd('avg(c_nationkey)', 6)} AS c_nationkey FROM customer GROUP BY 1",
)
def cluster_centers(spark, sf):
    out = cluster.cluster_centers(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment")
    return rounded(rounded(out, 4, "c_acctbal"), 6, "c_nationkey")


@query("cluster_label_counts", "SELECT label::VARCHAR AS \"Label\", count(*) AS \"Count\" FROM embeddings GROUP BY 1")
def cluster_label_counts(spark, sf):
    return cluster.label_counts(table(spark, sf, "embeddings"), "label")


@query(
    "nearest_centroid",
    "WITH c AS (SELECT c_mktsegment AS g, avg(c_acctbal / 500.0) AS a, avg(c_nationkey::DOUBLE) AS b FROM customer GROUP BY 1), "
    "d AS (SELECT c_custkey, g, row_number() OVER (PARTITION BY c_custkey ORDER BY (c_acctbal / 500.0 - a) * (c_acctbal / 500.0 - a) + (c_nationkey - b) * (c_nationkey - b), g) AS rn FROM customer, c) "
    "SELECT c_custkey, g AS \"Cluster\" FROM d WHERE rn = 1",
)
def nearest_centroid(spark, sf):
    df = table(spark, sf, "customer").withColumns({"a": F.col("c_acctbal") / 500.0, "b": F.col("c_nationkey").cast("double")})
    centres = cluster.cluster_centers(df, ["a", "b"], "c_mktsegment").orderBy("Cluster").collect()
    at = cluster.nearest_centre(F.array("a", "b"), [[r["a"], r["b"]] for r in centres], [r["Cluster"] for r in centres])
    return df.select("c_custkey", at.alias("Cluster"))


@query("score_kmeans")
def score_kmeans(spark, sf):
    df, b = _fit(spark, sf, cluster.KMEANS, n_clusters=3)
    return score.unsupervised(b, df)


@query("score_agglomerative")
def score_agglomerative(spark, sf):
    df, b = _fit(spark, sf, cluster.AGGLOMERATIVE, n_clusters=4)
    return score.unsupervised(b, df)


@query("score_isolation_forest")
def score_isolation_forest(spark, sf):
    df, b = _fit(spark, sf, cluster.ISOLATION)
    return score.unsupervised(b, df)


CORE = f"c AS (SELECT p.* FROM p JOIN n ON p.id = n.id WHERE reach >= {LEAST})"


@query(
    "score_dbscan_reach",
    f"WITH {REACH}, {CORE}, s AS (SELECT s_suppkey, s_acctbal / 500.0 AS a, s_nationkey::DOUBLE AS b FROM supplier) "
    f"SELECT s_suppkey, EXISTS (SELECT 1 FROM c WHERE sqrt((s.a - c.a) * (s.a - c.a) + (s.b - c.b) * (s.b - c.b)) <= {EPS}) AS reached FROM s",
)
def score_dbscan_reach(spark, sf):
    from gridsmith.operators.neighbors import knn

    core = density.label(customer_points(spark, sf), EPS, LEAST).where("is_core").select("key", "x", "cluster")
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.array(F.col("s_acctbal") / 500.0, F.col("s_nationkey").cast("double")).alias("x")
    )
    near = knn(rows, core, 1, carry=["cluster"])
    return near.select(F.col("key").alias("s_suppkey"), (F.col("dist") <= EPS).alias("reached"))


@query("score_dbscan")
def score_dbscan(spark, sf):
    df, b = _fit(spark, sf, cluster.DBSCAN, eps=0.5, min_samples=5)
    return score.unsupervised(b, df, "c_custkey")


@query(
    "score_fill",
    "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN (SELECT quantile_cont(c_acctbal, 0.5) FROM customer) ELSE c_acctbal END AS c_acctbal, "
    "CASE WHEN c_nationkey = 4 THEN (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def score_fill(spark, sf):
    df = table(spark, sf, "customer")
    prep = mlprep.build(df, ["c_acctbal", "c_mktsegment"])
    gaps = df.selectExpr(
        "c_custkey", "CASE WHEN c_nationkey = 3 THEN NULL ELSE c_acctbal END AS c_acctbal", "CASE WHEN c_nationkey = 4 THEN NULL ELSE c_mktsegment END AS c_mktsegment"
    )
    return prep.fill.transform(gaps)


@query("cluster_peers", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 10")
def cluster_peers(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return score.peers(df, "MACHINERY", "c_custkey", label="c_mktsegment")


@query("cluster_box")
def cluster_box(spark, sf):
    _, b = _fit(spark, sf, cluster.KMEANS, n_clusters=3)
    return chart.box(b.assigned, "c_acctbal", "Cluster")


@query("cluster_histogram")
def cluster_histogram(spark, sf):
    _, b = _fit(spark, sf, cluster.KMEANS, n_clusters=3)
    return chart.histogram(b.assigned, "c_acctbal", color="Cluster")


@query("anomaly_score_histogram")
def anomaly_score_histogram(spark, sf):
    _, b = _fit(spark, sf, cluster.ISOLATION)
    return chart.histogram(b.assigned, "Anomaly_Score", 50, color="Cluster")


@query("cluster_embeddings")
def cluster_embeddings(spark, sf):
    from pyspark.ml.functions import array_to_vector

    df = table(spark, sf, "embeddings")
    vectors = df.select(F.col("vec_id").alias("_key"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = cluster.best_kmeans(vectors, 10, restarts=3)
    rows = cluster.pca_2d(model.transform(vectors))
    return rows.select(F.col("_key").alias("vec_id"), F.col("prediction").alias("cluster"), "PCA1", "PCA2")


@query("dbscan_embeddings")
def dbscan_embeddings(spark, sf):
    points = as_points(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return density.label(points, 1.0, 5).select(F.col("key").alias("vec_id"), "cluster", "is_core")
