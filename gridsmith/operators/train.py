"""Supervised models: catalogue, comparison on one split, cross-validation."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import materialize
from . import balance, encode, evaluate, mlprep, profile, split
from .kernel import KernelMachine, KernelModel
from .neighbors import Knn, KnnModel
from .trees import Trees, TreesModel

CLASSIFICATION, REGRESSION = "Classification", "Regression"
KEY = "_key"

# Sizes of the compared models.
TREES, DEPTH, ROUNDS, BOOST_DEPTH, NEIGHBORS, MAX_ITER = 100, 15, 100, 6, 5, 1000


def catalogue(task: str, classes: int = 2, rows: int = 1, seed: int = 42) -> dict[str, Callable[[], object]]:
    """Model factories by display name. Penalties are per row, so they depend on ``rows``."""
    n = max(rows, 1)
    if task == CLASSIFICATION:
        boost = lambda: GBTClassifier(maxIter=ROUNDS, maxDepth=BOOST_DEPTH, seed=seed)
        return {
            "Random Forest": lambda: RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed),
            "Gradient Boosting": lambda: boost() if classes <= 2 else OneVsRest(classifier=boost()),
            "Extra Trees": lambda: Trees(max(classes, 2), TREES, DEPTH, "sqrt", bootstrap=False, random_cuts=True, seed=seed),
            "Logistic Regression": lambda: LogisticRegression(maxIter=MAX_ITER, regParam=1.0 / n, standardization=False),
            "Decision Tree": lambda: DecisionTreeClassifier(maxDepth=DEPTH, seed=seed),
            "K-Nearest Neighbors": lambda: Knn(NEIGHBORS, True, KEY),
            "Support Vector Classifier": lambda: KernelMachine(max(classes, 2), seed=seed),
        }
    if task != REGRESSION:
        raise ValueError(f"unknown task '{task}'")
    return {
        "Random Forest": lambda: RandomForestRegressor(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", seed=seed),
        "Gradient Boosting": lambda: GBTRegressor(maxIter=ROUNDS, maxDepth=BOOST_DEPTH, seed=seed),
        "Extra Trees": lambda: Trees(0, TREES, DEPTH, "all", bootstrap=False, random_cuts=True, seed=seed),
        "Linear Regression": lambda: LinearRegression(regParam=0.0, solver="auto"),
        "Ridge Regression": lambda: LinearRegression(elasticNetParam=0.0, regParam=1.0 / n, standardization=False),
        "Lasso Regression": lambda: LinearRegression(elasticNetParam=1.0, regParam=1.0, standardization=False),
        "Decision Tree": lambda: DecisionTreeRegressor(maxDepth=DEPTH, seed=seed),
        "K-Nearest Neighbors": lambda: Knn(NEIGHBORS, False, KEY),
        "Support Vector Regressor": lambda: KernelMachine(0, seed=seed),
    }


@dataclass
class Labels:
    """Classes in sorted order; empty for a numeric target."""

    target: str
    classes: list[str] = field(default_factory=list)

    @staticmethod
    def fit(df: DataFrame, target: str, task: str) -> "Labels":
        if task != CLASSIFICATION:
            return Labels(target)
        return Labels(target, [str(v) for v in encode.levels(df, target)])

    def add(self, df: DataFrame) -> DataFrame:
        if not self.classes:
            return df.withColumn("label", col(self.target).cast("double"))
        place = F.array_position(F.array(*[F.lit(c) for c in self.classes]), col(self.target).cast("string"))
        return df.withColumn("label", (place - 1).cast("double"))

    def name(self, prediction: str = "prediction"):
        if not self.classes:
            return F.col(prediction)
        return F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.col(prediction).cast("int") + 1)


@dataclass
class ModelBundle:
    """A fitted model with everything needed to score new rows."""

    algorithm: str
    task: str
    prep: mlprep.Prep
    labels: Labels
    model: object

    @property
    def features(self) -> list[str]:
        return self.prep.features

    def score(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """Input columns plus ``Prediction``. Neighbour models need the row key."""
        ready = self.prep.transform(df)
        if isinstance(self.model, KnnModel):
            if key is None:
                raise ValueError("this model needs the key column of the rows")
            ready = ready.withColumn(KEY, col(key))
        done = self.model.transform(ready)
        return done.select(*[col(c) for c in df.columns], self.labels.name().alias("Prediction"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Preparation as JSON and tables, estimators in MLlib's own format."""
        meta = {"algorithm": self.algorithm, "task": self.task, "target": self.labels.target, "classes": self.labels.classes}
        self.prep.save(spark, f"{path}/prep")
        if isinstance(self.model, KnnModel):
            meta |= {"kind": "knn", "k": self.model.k, "classify": self.model.classify}
            self.model.train.write.parquet(f"{path}/train")
        elif isinstance(self.model, TreesModel):
            meta |= {"kind": "trees"}
            self.model.save(f"{path}/model")
        elif isinstance(self.model, KernelModel):
            meta |= {"kind": "kernel", "kernel": self.model.as_dict()}
        else:
            PipelineModel([self.model]).write().save(f"{path}/model")
        mlprep.write_json(spark, meta, f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ModelBundle":
        meta = mlprep.read_json(spark, f"{path}/meta")
        if meta.get("kind") == "knn":
            model = KnnModel(spark.read.parquet(f"{path}/train"), meta["k"], meta["classify"], KEY)
        elif meta.get("kind") == "trees":
            model = TreesModel.load(spark, f"{path}/model")
        elif meta.get("kind") == "kernel":
            model = KernelModel.of(meta["kernel"])
        else:
            model = PipelineModel.load(f"{path}/model").stages[0]
        prep = mlprep.Prep.load(spark, f"{path}/prep")
        return ModelBundle(meta["algorithm"], meta["task"], prep, Labels(meta["target"], meta["classes"]), model)


@dataclass
class Comparison:
    task: str
    leaderboard: DataFrame
    bundles: dict[str, ModelBundle]
    features: list[str]
    test: DataFrame
    balance: dict | None

    def best(self) -> str:
        return self.leaderboard.first()["Model"]


def _vectors(prep: mlprep.Prep, labels: Labels, df: DataFrame, key: str) -> DataFrame:
    ready = prep.transform(labels.add(df))
    return ready.select(col(key).alias(KEY), "features", "label")


def _score(task: str, pred: DataFrame) -> dict[str, float]:
    if task == CLASSIFICATION:
        r = evaluate.classification(pred, "label", "prediction").first()
        return {"Accuracy": r["accuracy"], "F1 Score": r["f1"], "Precision": r["precision"], "Recall": r["recall"]}
    r = evaluate.regression(pred, "label", "prediction").first()
    return {"R2 Score": r["r2"], "MAE": r["mae"], "RMSE": r["rmse"]}


MAIN = {CLASSIFICATION: "Accuracy", REGRESSION: "R2 Score"}
CV_NAME = {CLASSIFICATION: "CV Accuracy", REGRESSION: "CV R2"}


def cross_validate(df: DataFrame, target: str, key: str, features: list[str], task: str, labels: Labels,
                   names: list[str], k: int, seed: int = 42, strategy: str = "none") -> dict[str, float]:
    """Mean main score over the folds that hold rows; preparation and balancing are
    refitted in each fold on its training part, once for all models."""
    stratify = target if task == CLASSIFICATION and split.can_stratify(df, target) else None
    rows = materialize(split.folds(df, key, k, seed, stratify))
    totals: dict[str, list[float]] = {name: [] for name in names}
    for f in range(k):
        inner, held = rows.where(F.col("fold") != f).drop("fold"), rows.where(F.col("fold") == f).drop("fold")
        prep = mlprep.build(inner, features)
        fit_rows = materialize(_vectors(prep, labels, inner, key))
        test_rows = materialize(_vectors(prep, labels, held, key))
        fit_rows, report = balance.apply(fit_rows, "label", strategy, KEY, seed)
        if report is not None:
            fit_rows = materialize(fit_rows)
        makers = catalogue(task, len(labels.classes), fit_rows.count(), seed)
        for name in names:
            pred = makers[name]().fit(fit_rows).transform(test_rows)
            found = _score(task, pred)[MAIN[task]]
            if found is not None:
                totals[name].append(found)
    return {name: sum(scores) / len(scores) if scores else None for name, scores in totals.items()}


def benchmark(df: DataFrame, target: str, key: str, models: list[str] | None = None, test_size: float = 0.2, cv_folds: int = 5,
              seed: int = 42, strategy: str = "none", task: str | None = None, rank_by: str | None = None) -> Comparison:
    """Fit the chosen models on one split and rank them.

    Preparation is fitted once on the training rows and its vectors are written
    once. The cross-validated score uses training rows only; ``cv_folds=0`` skips it.
    """
    rows = split.drop_missing_target(df, target)
    task = task or profile.detect_task(rows, target).first()["task"]
    if strategy != "none" and task != CLASSIFICATION:
        raise ValueError("class balancing needs a classification target")
    features = [c for c in df.columns if c not in (target, key)]
    stratify = target if task == CLASSIFICATION and split.can_stratify(rows, target) else None
    train, test = split.train_test(rows, key, test_size, seed, stratify)
    labels = Labels.fit(rows, target, task)
    prep = mlprep.build(train, features)
    fit_rows = materialize(_vectors(prep, labels, train, key))
    test_rows = materialize(_vectors(prep, labels, test, key))
    fit_rows, report = balance.apply(fit_rows, "label", strategy, KEY, seed)
    if report is not None:
        fit_rows = materialize(fit_rows)
    makers = catalogue(task, len(labels.classes), fit_rows.count(), seed)
    names = [m for m in makers if models is None or m in models]
    cv = cross_validate(train, target, key, features, task, labels, names, cv_folds, seed, strategy) if cv_folds else {}
    board, bundles = [], {}
    for name in names:
        model = makers[name]().fit(fit_rows)
        scores = _score(task, model.transform(test_rows))
        bundles[name] = ModelBundle(name, task, prep, labels, model)
        board.append((name, *scores.values(), cv.get(name)))
    columns = ["Model", *(["Accuracy", "F1 Score", "Precision", "Recall"] if task == CLASSIFICATION else ["R2 Score", "MAE", "RMSE"]), CV_NAME[task]]
    schema = ", ".join(f"`{c}` {'string' if c == 'Model' else 'double'}" for c in columns)
    leaderboard = df.sparkSession.createDataFrame(board, schema).orderBy(F.desc_nulls_last(f"`{rank_by or MAIN[task]}`"), "Model")
    return Comparison(task, leaderboard, bundles, features, test, report)


def model_names(task: str) -> list[str]:
    return list(catalogue(task))
