"""Model metrics as frames computed from (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_numeric
from ..functions.distributed import running_totals
from ..session import materialize
from .encode import levels

# Classes up to which a matrix with its zero cells is made.
MATRIX_CLASSES = 1_000


def _name(pred: DataFrame, name: str, both_numeric: bool) -> Column:
    """Class as text. Two numeric columns are compared by value: 1 and 1.0 are one class."""
    if not both_numeric:
        return col(name).cast("string")
    v = col(name).cast("double")
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def _cells(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    kinds = [pred.schema[c].dataType for c in (label, prediction)]
    by_value = kinds[0] != kinds[1] and all(is_numeric(k) for k in kinds)
    names = [_name(pred, label, by_value).alias("label"), _name(pred, prediction, by_value).alias("prediction")]
    return pred.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def confusion(pred: DataFrame, label: str, prediction: str, filled_only: bool = False) -> DataFrame:
    """Rows per (label, prediction), zero cells included unless ``filled_only``.

    The zero cells of more than ``MATRIX_CLASSES`` classes are refused: ask for the
    filled ones.
    """
    if filled_only:
        return _cells(pred, label, prediction)
    cells = materialize(_cells(pred, label, prediction))  # read three times, scored once
    classes = cells.select("label").union(cells.select("prediction")).distinct().toDF("label")
    if classes.count() > MATRIX_CLASSES:
        raise ValueError(f"more than {MATRIX_CLASSES} classes: use filled_only=True")
    names = levels(classes, "label")
    spine = classes.withColumn("prediction", F.explode(F.array(*[F.lit(v) for v in names])))
    return spine.join(cells, ["label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classification(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; 0 for an empty denominator."""
    cells = _cells(pred, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    by_label = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    per = by_label.join(by_pred, "label", "left").withColumns({"p": p, "r": r}).withColumn("f", f)
    mean = lambda c: F.sum(F.col("support") * F.col(c)) / F.sum("support")
    return per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        mean("f").alias("f1"),
        mean("p").alias("precision"),
        mean("r").alias("recall"),
    )


def regression(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """R2, mean absolute error, mean squared error and its root in one aggregate."""
    y, e = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    one = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"))
    r2 = F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return one.select(r2.alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"))


def roc(pred: DataFrame, label: str, score: str, positive=None) -> DataFrame:
    """Exact curve: one row per distinct score, from the counts per score.

    ``positive`` defaults to the larger label.
    """
    if positive is None:
        positive = pred.agg(F.max(col(label))).first()[0]
    hit = (col(label) == F.lit(positive)).cast("long")
    counts = pred.groupBy(col(score).cast("double").alias("threshold")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )
    counts = materialize(counts)  # scoring runs once, the curve reads the counts
    curve = running_totals(counts, [], "threshold", ["pos", "neg"], counts.count(), descending=True)
    total = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = total.select("p").scalar(), total.select("n").scalar()
    return curve.select(
        "threshold", "pos", "neg",
        F.try_divide(F.col("cum_neg").cast("double"), n.cast("double")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), p.cast("double")).alias("tpr"),
    )


def auc(pred: DataFrame, label: str, score: str, positive=None) -> DataFrame:
    """Area under the exact curve by trapezoids, one per distinct score."""
    curve = roc(pred, label, score, positive)
    n, p = F.col("neg"), F.col("pos")
    total_n, total_p = F.sum("neg").cast("double"), F.sum("pos").cast("double")
    # height is the tpr before this score plus half of its own step
    height = F.col("tpr") * curve.agg(total_p).scalar() - p / 2.0
    return curve.agg(F.try_divide(F.sum(n * height), total_n * total_p).alias("auc"))


def residuals(pred: DataFrame, label: str, prediction: str, keep: list[str] = ()) -> DataFrame:
    y, yhat = col(label).cast("double"), col(prediction).cast("double")
    return pred.select(*[col(k) for k in keep], y.alias("actual"), yhat.alias("predicted"), (y - yhat).alias("residual"))
