"""Clustering: one entry point, fitted bundles that score new rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, is_numeric, numeric_columns
from ..functions.distributed import lookup_join
from ..session import materialize, spread
from . import anomaly, density, hierarchy, linkage, mlprep
from .neighbors import as_points, knn

KMEANS = "K-Means Clustering"
AGGLOMERATIVE = "Agglomerative Clustering"
DBSCAN = "DBSCAN"
ISOLATION = "Isolation Forest (Anomaly Detection)"
ALGORITHMS = [KMEANS, AGGLOMERATIVE, DBSCAN, ISOLATION]
# Restarts, seed, fewest rows.
RESTARTS, SEED, LEAST_ROWS = 10, 42, 5
LINKAGES = ("ward", "complete", "average", "single")


def nearest_centre(x: Column, centres: list[list[float]], names: list | None = None) -> Column:
    """Index (or name) of the nearest centre of an array column, ties to the first."""
    ranked = []
    for i, c in enumerate(centres):
        other = F.array(*[F.lit(float(v)) for v in c])
        gap = F.aggregate(F.zip_with(x, other, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        ranked.append(F.struct(gap.alias("d"), F.lit(i).alias("i")))
    at = F.array_min(F.array(*ranked))["i"]
    return at if names is None else F.element_at(F.array(*[F.lit(n) for n in names]), at + 1)


def best_kmeans(vectors: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED, parallelism: int = 4):
    """The restart with the lowest cost; a few are submitted at a time."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        models = list(pool.map(lambda i: KMeans(k=k, seed=seed + i, maxIter=100).fit(vectors), range(restarts)))
    return min(models, key=lambda m: m.summary.trainingCost)


def pca_2d(vectors: DataFrame) -> DataFrame:
    """Adds PCA1 and PCA2: centred projection, each axis signed so that its largest
    loading is positive. A single feature has PCA2 = 0."""
    mean = vectors.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    k = min(2, len(mean))
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(vectors)
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    shift = mean @ axes
    p = vector_to_array("_pca")
    out = model.transform(vectors)
    score = [(p[i] - F.lit(float(shift[i]))) * F.lit(signs[i]) for i in range(k)]
    return out.withColumns({"PCA1": score[0], "PCA2": score[1] if k == 2 else F.lit(0.0)}).drop("_pca")


def silhouette(rows: DataFrame, cluster: str = "_cluster") -> float | None:
    """Mean silhouette on squared distances, in one pass over all rows from the means of
    the clusters; noise (-1) is left out and fewer than two clusters give None."""
    rows = materialize(rows.where(col(cluster) != -1).select("features", col(cluster).cast("int").alias("c")))
    if rows.agg(F.min("c") == F.max("c")).first()[0] in (None, True):
        return None
    return ClusteringEvaluator(predictionCol="c").evaluate(rows)


def silhouette_euclidean(rows: DataFrame, cluster: str = "_cluster") -> float | None:
    """Mean silhouette on Euclidean distances, for tables on which the work of comparing
    all rows is wanted: it grows with the square of their number. Every row meets every
    block of rows, a block returning one sum a cluster."""
    rows = materialize(rows.where(col(cluster) != -1).select("_key", "features", col(cluster).cast("int").alias("c")))
    sizes = {r["c"]: r["count"] for r in rows.groupBy("c").count().collect()}
    if len(sizes) < 2:
        return None
    block = 10_000
    parts = max(1, -(-sum(sizes.values()) // block))
    pts = rows.select(F.col("_key").alias("key"), vector_to_array("features").alias("x"), "c")
    spot = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = pts.withColumn("qb", spot).withColumn("pb", every)
    right = pts.withColumn("pb", spot).withColumn("qb", every)

    def sums(q, p):
        import numpy as np
        import pandas as pd

        cols = ["key", "own", "c", "total"]
        if not len(q) or not len(p):
            return pd.DataFrame(columns=cols)
        labels = p["c"].to_numpy()
        order = np.argsort(labels, kind="stable")
        named, first = np.unique(labels[order], return_index=True)
        qx, px = np.stack(q["x"].to_numpy()).T, np.ascontiguousarray(np.stack(p["x"].to_numpy())[order].T)
        total = np.empty((len(named), qx.shape[1]))
        # tiles that stay in a core's cache, one dimension at a time
        step = max(1, 200_000 // px.shape[1])
        for s in range(0, qx.shape[1], step):
            d = np.zeros((len(qx[0, s : s + step]), px.shape[1]))
            for a, b in zip(qx, px):
                gap = a[s : s + step, None] - b[None, :]
                gap *= gap
                d += gap
            total[:, s : s + step] = np.add.reduceat(np.sqrt(d, out=d), first, axis=1).T
        out = [pd.DataFrame({"key": q["key"].to_numpy(), "own": q["c"].to_numpy(), "c": c, "total": t}) for c, t in zip(named, total)]
        return pd.concat(out)[cols]

    ktype = rows.schema["_key"].dataType.simpleString()
    got = left.groupBy("pb", "qb").cogroup(right.groupBy("pb", "qb")).applyInPandas(sums, f"key {ktype}, own int, c int, total double")
    size = F.create_map(*[F.lit(int(v)) for kv in sizes.items() for v in kv])
    per = got.groupBy("key", "own", "c").agg(F.sum("total").alias("total"))
    mine, n = F.col("own") == F.col("c"), size[F.col("c")]
    per = per.groupBy("key", "own").agg(
        F.max(F.when(mine & (n > 1), F.col("total") / (n - 1))).alias("a"), F.min(F.when(~mine, F.col("total") / n)).alias("b")
    )
    s = F.when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per.agg(F.avg(s)).first()[0]


@dataclass
class UnsupervisedBundle:
    """Fitted clustering: assignments of the training rows, centres and the scorer."""

    algorithm: str
    features: list[str]
    prep: mlprep.Prep
    assigned: DataFrame
    centers: DataFrame | None
    silhouette: float | None
    n_clusters: int | None
    model: object
    params: dict = field(default_factory=dict)

    def score(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """Input columns plus the cluster or the anomaly label and score. Gaps are
        filled with training statistics; density clusters need a row key."""
        keep = [col(c) for c in df.columns]
        ready = self.prep.transform(df, "_features")
        if self.algorithm == ISOLATION:
            s = self.model.score_expr("_features")
            out = ready.withColumn("_score", s)
            flag = F.when(F.col("_score") > F.lit(self.model.threshold), "Anomaly").otherwise("Normal")
            return out.select(*keep, flag.alias("Anomaly_Label"), F.round("_score", 4).alias("Anomaly_Score"))
        if self.algorithm == DBSCAN:
            if key is None:
                raise ValueError("density clusters need the key column of the rows")
            near = knn(as_points(ready, key, "_features"), self.model, 1, carry=["cluster"])
            near = near.where(F.col("dist") <= F.lit(float(self.params["eps"])))
            near = near.select(F.col("key").alias("_k"), "cluster")
            joined = ready.join(near, col(key) == F.col("_k"), "left")
            return joined.select(*keep, F.coalesce("cluster", F.lit(-1)).cast("string").alias("Cluster"))
        at = nearest_centre(vector_to_array("_features"), self.model)
        return ready.select(*keep, at.cast("string").alias("Cluster"))


    def save(self, spark: SparkSession, path: str) -> None:
        """Preparation, assignments, centres and scorer as tables and JSON under ``path``."""
        meta = {"algorithm": self.algorithm, "features": self.features, "silhouette": self.silhouette, "n_clusters": self.n_clusters, "params": self.params}
        self.prep.save(spark, f"{path}/prep")
        self.assigned.write.parquet(f"{path}/assigned")
        if self.centers is not None:
            self.centers.write.parquet(f"{path}/centers")
        if self.algorithm == DBSCAN:
            self.model.write.parquet(f"{path}/core")
        elif self.algorithm == ISOLATION:
            meta["model"] = {"nodes": self.model.nodes, "rows": self.model.rows, "threshold": self.model.threshold}
        else:
            meta["model"] = self.model
        mlprep.write_json(spark, meta, f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "UnsupervisedBundle":
        meta = mlprep.read_json(spark, f"{path}/meta")
        algorithm, model = meta["algorithm"], meta.get("model")
        if algorithm == DBSCAN:
            model = spark.read.parquet(f"{path}/core")
        elif algorithm == ISOLATION:
            model = anomaly.ForestModel([tuple(n) for n in model["nodes"]], model["rows"], model["threshold"])
        centers = None if algorithm == ISOLATION else spark.read.parquet(f"{path}/centers")
        prep, assigned = mlprep.Prep.load(spark, f"{path}/prep"), spark.read.parquet(f"{path}/assigned")
        return UnsupervisedBundle(algorithm, meta["features"], prep, assigned, centers, meta["silhouette"], meta["n_clusters"], model, meta["params"])


def fit(df: DataFrame, features: list[str] | None, key: str, algorithm: str = KMEANS, **params) -> UnsupervisedBundle:
    """Fit on the complete rows of ``features`` (numeric columns by default)."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm '{algorithm}'")
    features = features or [c for c in numeric_columns(df) if c != key]
    raw = df.select(col(key).alias("_key"), *[col(c) for c in features]).na.drop()
    raw = materialize(raw)
    if raw.count() < LEAST_ROWS:
        raise ValueError(f"needs at least {LEAST_ROWS} complete rows")
    prep = mlprep.build(raw, features)
    vectors = spread(prep.transform(raw), "_key")
    scores, model, sil = False, None, None
    if algorithm == KMEANS:
        best = best_kmeans(vectors, int(params.get("n_clusters", 3)), int(params.get("restarts", RESTARTS)))
        model = [list(map(float, c)) for c in best.clusterCenters()]
        rows = best.transform(vectors).withColumnRenamed("prediction", "_cluster")
    elif algorithm == AGGLOMERATIVE and params.get("linkage") == "single":
        rows = _single_linkage(vectors, int(params.get("n_clusters", 3)))
    elif algorithm == AGGLOMERATIVE:
        rows = _agglomerate(vectors, int(params.get("n_clusters", 3)), params.get("linkage", "ward"))
    elif algorithm == DBSCAN:
        params = {"eps": float(params.get("eps", 0.5)), "min_samples": int(params.get("min_samples", 5))}
        done = density.label(as_points(vectors, "_key", "features"), params["eps"], params["min_samples"])
        done = materialize(done)
        model = materialize(done.where("is_core").select("key", "x", "cluster"))
        rows = vectors.join(done.select(F.col("key").alias("_key"), F.col("cluster").alias("_cluster")), "_key")
    else:
        model = anomaly.IsolationForest(contamination=float(params.get("contamination", 0.05))).fit(vectors, "_key")
        rows = vectors.withColumn("Anomaly_Score", model.score_expr("features"))
        rows = rows.withColumn("_cluster", F.when(F.col("Anomaly_Score") > F.lit(model.threshold), "Anomaly").otherwise("Normal"))
        scores = True
    rows = materialize(rows)
    if algorithm == AGGLOMERATIVE:
        means = rows.groupBy("_cluster").agg(Summarizer.mean(F.col("features")).alias("m")).orderBy("_cluster").collect()
        model = [list(map(float, r["m"])) for r in means]
    if not scores:
        sil = silhouette(rows)
    shown = pca_2d(rows)
    extra = [F.col("Anomaly_Score")] if scores else []
    assigned = shown.select(
        F.col("_key").alias(key), *[col(c) for c in features if c != key], F.col("_cluster").cast("string").alias("Cluster"), "PCA1", "PCA2", *extra
    )
    centres = None if scores else cluster_centers(assigned, features)
    count = None if scores else rows.where(F.col("_cluster") != -1).agg(F.count_distinct("_cluster")).first()[0]
    return UnsupervisedBundle(algorithm, features, prep, assigned, centres, sil, count, model, params)


def cluster_centers(assigned: DataFrame, features: list[str], cluster: str = "Cluster") -> DataFrame:
    """Mean of each numeric feature per cluster, noise left out."""
    numeric = [c for c in features if is_numeric(assigned.schema[c].dataType)]
    rows = assigned.where(col(cluster).cast("string") != "-1")
    return rows.groupBy(col(cluster).cast("string").alias("Cluster")).agg(*[F.avg(col(c).cast("double")).alias(c) for c in numeric])


def label_counts(assigned: DataFrame, label: str = "Cluster") -> DataFrame:
    """Rows per cluster or anomaly label, noise included."""
    return assigned.groupBy(col(label).cast("string").alias("Label")).agg(F.count(F.lit(1)).alias("Count"))


def _single_linkage(vectors: DataFrame, k: int) -> DataFrame:
    """Clusters of all rows by their minimum spanning tree, numbered by their smallest key."""
    points = as_points(vectors, "_key", "features")
    found = linkage.cut(points, linkage.spanning_tree(points), k)
    named = materialize(vectors.join(found.select(F.col("key").alias("_text"), "cluster"), F.col("_key").cast("string") == F.col("_text")).drop("_text"))
    firsts = named.groupBy("cluster").agg(F.min("_key").alias("first")).orderBy("first").collect()  # k rows
    place = F.create_map(*[F.lit(v) for i, r in enumerate(firsts) for v in (r["cluster"], i)])
    return named.withColumn("_cluster", place[F.col("cluster")]).drop("cluster")


def _agglomerate(vectors: DataFrame, k: int, how: str) -> DataFrame:
    """Clusters of all rows by ward, complete or average linkage, numbered by their smallest key."""
    rows = vectors.withColumn("x", vector_to_array("features"))
    groups = rows.groupBy("x").agg(F.min("_key").cast("string").alias("key"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.withColumn("key", F.concat("key", F.lit("|"), F.hex(F.xxhash64("x")))))  # keys may repeat
    found = groups.join(hierarchy.cut(groups, hierarchy.dendrogram(groups, how), k), "key").select("x", "cluster", "n")
    named = materialize(lookup_join(rows, found, ["x"], "n").drop("x"))
    firsts = named.groupBy("cluster").agg(F.min("_key").alias("first")).orderBy("first", "cluster").collect()  # k rows
    place = F.create_map(*[F.lit(v) for i, r in enumerate(firsts) for v in (r["cluster"], i)])
    return named.withColumn("_cluster", place[F.col("cluster")]).drop("cluster")
