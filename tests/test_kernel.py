"""Kernel machines on planted shapes, and their optimum against plain gradient checks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gridsmith.operators import kernel, train


def frame(spark, x, y, parts=4):
    rows = [(i, list(map(float, v)), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "_key long, x array<double>, label double").repartition(parts)
    return df.select("_key", "label", array_to_vector("x").alias("features"))


def share(model, df):
    return model.transform(df).where("prediction = label").count() / df.count()


def test_ring_and_three_classes(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (1_200, 2))
    far = np.sqrt((x * x).sum(axis=1))
    ring, held = frame(spark, x[:800], far[:800] < 0.6), frame(spark, x[800:], far[800:] < 0.6)
    model = kernel.KernelMachine(2, landmarks=64).fit(ring)
    assert share(model, held) > 0.95 and 0 < model.support < 800
    bands = (far > 0.45).astype(int) + (far > 0.85)
    model = kernel.KernelMachine(3, landmarks=64).fit(frame(spark, x[:800], bands[:800]))
    assert share(model, frame(spark, x[800:], bands[800:])) > 0.9


def test_sine_within_a_tube(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, (900, 1))
    y = np.sin(2 * x[:, 0])
    model = kernel.KernelMachine(0, landmarks=40).fit(frame(spark, x[:600], y[:600]))
    out = model.transform(frame(spark, x[600:], y[600:])).select("label", "prediction").toPandas()
    gap = out["label"] - out["prediction"]
    assert 1 - (gap**2).sum() / ((out["label"] - out["label"].mean()) ** 2).sum() > 0.95
    assert 0 < model.support < 600  # the others lie inside the tube


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_weights_are_the_optimum(spark, classes):
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(scale=0.5, size=300) > 0).astype(float) + (x[:, 1] > 0.8 if classes == 3 else 0) if classes else x[:, 0] ** 2 + rng.normal(size=300)
    machine = kernel.KernelMachine(classes, landmarks=12)
    model = machine.fit(frame(spark, x, y))
    z = model.features(x)
    for c in range(model.weights.shape[1]):
        if classes == 2 and c == 0:
            continue
        w = model.weights[:, c]
        off, want = kernel.losses(z @ w, y, c, classes, machine.tube)
        out = off > 0
        ridge = np.append(np.ones(len(w) - 1), 1e-6)
        gradient = ridge * w - machine.penalty * z[out].T @ (want[out] - z[out] @ w)
        assert np.abs(gradient).max() < 1e-3 * max(1.0, np.abs(z[out].T @ want[out]).max())


def test_saved_machine(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("y", F.when(F.col("a") * F.col("b") > 0, "same").otherwise("apart"))
    bundle = train.benchmark(df, "y", "id", ["Support Vector Classifier"], cv_folds=0, task=train.CLASSIFICATION).bundles["Support Vector Classifier"]
    bundle.save(spark, str(tmp_path / "b"))
    again = train.ModelBundle.load(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, again.score(df.drop("y")).collect())) == sorted(map(tuple, bundle.score(df.drop("y")).collect()))
