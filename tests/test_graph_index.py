"""The neighbour graph against the exact form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsmith.operators import graph_index, neighbors


def points_of(spark, x, parts=3):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "key long, x array<double>").repartition(parts)


@pytest.mark.parametrize("kind", ["clusters", "flat"])
def test_recall_in_many_dimensions(spark, kind):
    rng = np.random.default_rng(4)
    n, d = 1_500, 24
    x = rng.normal(size=(n, d)) + (6 * rng.normal(size=(10, d))[rng.integers(0, 10, n)] if kind == "clusters" else 0)
    if kind == "flat":
        x[:, 6:] *= 0.05
    points = points_of(spark, x)
    graph = graph_index.build(points)
    asked = points.where("key % 50 = 0")
    assert graph_index.recall(graph.neighbors(10), asked, points, 10, exclude_same_key=True) >= 0.9
    found = graph.neighbors(graph_index.WIDTH)
    assert found.count() == n * graph_index.WIDTH and found.where("key = neighbor").isEmpty()
    far = {(r["key"], r["neighbor"]): r["dist"] for r in found.where("key < 20").collect()}
    assert all(d == pytest.approx(float(np.sqrt(((x[a] - x[b]) ** 2).sum()))) for (a, b), d in far.items())
    fresh = points_of(spark, x[:40] + rng.normal(scale=0.01, size=(40, d)))
    assert graph_index.recall(graph.search(fresh, 5), fresh, points, 5) >= 0.9


def test_copies_and_small_tables(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.zeros((400, 3)), rng.normal(size=(200, 3))])
    points = points_of(spark, x)
    graph = graph_index.build(points, width=8)
    near = {r["key"]: r["dist"] for r in graph.neighbors(8).groupBy("key").agg(F.max("dist").alias("dist")).collect()}
    assert len(near) == 600 and all(near[i] == 0 for i in range(400))
    for rows in ([], [[1.0]], [[1.0], [4.0]]):
        small = graph_index.build(points_of(spark, np.array(rows).reshape(-1, 1), 1))
        assert small.neighbors(3).count() == (2 if len(rows) == 2 else 0)
        assert small.search(points_of(spark, np.array([[3.0]]), 1), 3).count() == len(rows)


def test_prediction_by_the_graph(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 10))
    df = points_of(spark, x).withColumn("label", (F.element_at("x", 1) > 0).cast("double")).select(F.col("key").alias("_key"), array_to_vector("x").alias("features"), "label")
    fit_rows, held = df.where("_key < 600"), df.where("_key >= 600")
    exact, fast = (neighbors.Knn(approximate=a).fit(fit_rows).transform(held).select("_key", "prediction").collect() for a in (False, True))
    same = dict(map(tuple, exact)).items() & dict(map(tuple, fast)).items()
    assert len(same) >= 92
