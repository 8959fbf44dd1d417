"""Kernel machines: radial kernels through landmarks, fitted by Newton steps.

Rows become features phi(x) = K(x, L) K(L, L)^(-1/2) for landmarks L, the centres that k-means
finds over all rows (Nystroem); their inner products are the kernel wherever landmarks
reach. A linear machine over phi minimises |w|^2 / 2 + C * sum of squared losses: for
regression what a residual exceeds the tube by, for classes what a margin lacks of one,
each class against the rest. The squared losses make the objective piecewise quadratic, so
a Newton step needs only the products of the rows outside the tube (the support rows): one
scan sums them in the tasks, rows of the matrix are added up by key, and a few steps end at
the exact optimum. A step that does not lower the objective is halved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Penalty and tube of the compared machines.
PENALTY, TUBE = 1.0, 0.1
LANDMARKS, STEPS, HALVINGS = 256, 30, 12


@dataclass
class KernelModel:
    """``weights``: one column a class (one for regression), the last row is the bias."""

    landmarks: np.ndarray
    root: np.ndarray
    gamma: float
    weights: np.ndarray
    classes: int
    support: int

    def as_dict(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}

    @staticmethod
    def of(saved: dict) -> "KernelModel":
        return KernelModel(**{k: np.array(v, np.float64) if isinstance(v, list) else v for k, v in saved.items()})

    def features(self, x: np.ndarray) -> np.ndarray:
        return phi(x, self.landmarks, self.root, self.gamma)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""

        @F.pandas_udf("double")
        def predicted(column):
            import pandas as pd

            if not len(column):
                return pd.Series([], dtype=float)
            found = self.features(np.stack(column.to_numpy())) @ self.weights
            return pd.Series(found.argmax(axis=1).astype(float) if self.classes else found[:, 0])

        return df.withColumn("prediction", predicted(vector_to_array("features")))


def phi(x: np.ndarray, landmarks: np.ndarray, root: np.ndarray, gamma: float) -> np.ndarray:
    """(rows, landmarks + 1): mapped rows with a constant."""
    far = np.maximum((x * x).sum(axis=1)[:, None] + (landmarks * landmarks).sum(axis=1)[None] - 2 * x @ landmarks.T, 0.0)
    return np.concatenate([np.exp(-gamma * far) @ root, np.ones((len(x), 1))], axis=1)


def inverse_root(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    far = ((landmarks[:, None] - landmarks[None]) ** 2).sum(axis=2)
    values, vectors = np.linalg.eigh(np.exp(-gamma * far))
    good = values > 1e-10 * values.max()
    return vectors[:, good] / np.sqrt(values[good])


def losses(score: np.ndarray, y: np.ndarray, column: int, classes: int, tube: float) -> tuple[np.ndarray, np.ndarray]:
    """What each row is off by (0 inside), and the value that would bring it to the border."""
    if classes:
        sign = np.where(y == column, 1.0, -1.0)
        return np.maximum(0.0, 1.0 - sign * score), sign
    gap = y - score
    return np.maximum(0.0, np.abs(gap) - tube), y - np.sign(gap) * tube


@dataclass
class KernelMachine:
    """``classes`` 0 means regression. ``gamma`` None is 1 / (features * variance of all
    cells)."""

    classes: int
    landmarks: int = LANDMARKS
    penalty: float = PENALTY
    tube: float = TUBE
    gamma: float | None = None
    seed: int = 42

    def fit(self, df: DataFrame) -> KernelModel:
        rows = materialize(df.select("features", F.col("label").cast("double").alias("label")))
        x = vector_to_array("features")
        sums = [F.avg(F.aggregate(x, F.lit(0.0), f)) for f in (lambda a, v: a + v, lambda a, v: a + v * v)]
        fact = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(x)).alias("d"), sums[0].alias("s"), sums[1].alias("q")).first()
        if not fact["n"]:
            raise ValueError("no rows to fit")
        spread = fact["q"] / fact["d"] - (fact["s"] / fact["d"]) ** 2
        gamma = self.gamma or (1.0 / (fact["d"] * spread) if spread > 0 else 1.0)
        centres = KMeans(k=max(2, min(self.landmarks, fact["n"])), maxIter=10, seed=self.seed).fit(rows).clusterCenters()
        landmarks = np.unique(np.array(centres, np.float64), axis=0)
        root = inverse_root(landmarks, gamma)
        narrow = rows.select(x.alias("x"), "label")
        columns = self.classes if self.classes > 2 else 1
        model = KernelModel(landmarks, root, gamma, np.zeros((root.shape[1] + 1, columns)), self.classes, 0)
        self._newton(narrow, model)
        if self.classes == 2:  # one machine decides: class 1 where its score is positive
            model.weights = np.concatenate([-model.weights, model.weights], axis=1)
        return model

    def _pass(self, rows: DataFrame, model: KernelModel, tried: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Losses of each tried set of weights, and the products over the support rows of the
        first; a task sends one row for each row of a matrix."""
        classes, tube, width, columns = self.classes, self.tube, *model.weights.shape
        held = rows.sparkSession.sparkContext.broadcast((model.landmarks, model.root, model.gamma, tried))

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            landmarks, root, gamma, weights = held.value
            square, target = np.zeros((columns, width, width)), np.zeros((columns, width))
            loss, support = np.zeros((len(weights), columns)), 0
            for batch in batches:
                if not len(batch):
                    continue
                y = np.asarray(batch.column(1), np.float64)
                z = phi(np.asarray(batch.column(0).flatten(), np.float64).reshape(len(y), -1), landmarks, root, gamma)
                for t, w in enumerate(weights):
                    score = z @ w
                    for c in range(columns):
                        off, want = losses(score[:, c], y, c if columns > 1 else 1, classes, tube)
                        loss[t, c] += (off * off).sum()
                        if t == 0:
                            out = off > 0
                            square[c] += z[out].T @ z[out]
                            target[c] += z[out].T @ want[out]
                            support += int(out.sum())
            lines = np.concatenate([square.reshape(columns * width, width), target, np.pad(loss.ravel(), (0, -loss.size % width)).reshape(-1, width), np.full((1, width), float(support))])
            at = np.repeat(np.arange(len(lines)), width)
            place = np.tile(np.arange(width), len(lines))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(place), pa.array(lines.ravel())], names=["line", "place", "total"])

        found = rows.mapInArrow(products, "line long, place long, total double").groupBy("line", "place").agg(F.sum("total").alias("total")).toArrow()
        n = columns * width
        extra = -(-len(tried) * columns // width)
        lines = np.zeros((n + columns + extra + 1, width))
        lines[np.asarray(found["line"]), np.asarray(found["place"])] = np.asarray(found["total"])
        loss = lines[n + columns : n + columns + extra].ravel()[: len(tried) * columns].reshape(len(tried), columns)
        return lines[:n].reshape(columns, width, width), lines[n : n + columns], loss, int(lines[-1, 0])

    def _newton(self, rows: DataFrame, model: KernelModel) -> None:
        width, columns = model.weights.shape
        ridge = np.eye(width)
        ridge[-1, -1] = 1e-6  # the bias is hardly held

        def size(w: np.ndarray) -> np.ndarray:
            return (w * (ridge @ w)).sum(axis=0) / 2

        best, step = model.weights, None
        square, target, loss, model.support = self._pass(rows, model, [best])
        value = size(best) + self.penalty * loss[0] / 2
        for _ in range(STEPS):
            step = np.stack([np.linalg.solve(ridge + self.penalty * square[c], self.penalty * target[c]) for c in range(columns)], axis=1) - best
            # several lengths are tried in the scan that would follow anyway
            lengths = [0.5**i for i in range(HALVINGS)]
            products = self._pass(rows, model, [best + a * step for a in lengths])
            loss = products[2]
            tried = np.stack([size(best + a * step) + self.penalty * loss[i] / 2 for i, a in enumerate(lengths)])
            at = tried.argmin(axis=0)
            better = tried[at, np.arange(columns)] < value - 1e-9 * np.maximum(1.0, np.abs(value))
            if not better.any():
                break
            best = np.where(better[None], best + np.array(lengths)[at][None] * step, best)
            value = np.where(better, tried[at, np.arange(columns)], value)
            model.weights = best
            whole_step = better.all() and not at.any()  # then the scan has its products already
            square, target, _, model.support = products if whole_step else self._pass(rows, model, [best])
