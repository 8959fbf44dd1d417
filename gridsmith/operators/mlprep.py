"""Model inputs: fitted column preparation and the assembled feature vector."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import col, is_numeric, is_text
from . import clean, encode, scale
from .profile import distinct_counts

# Fixed value: most levels of a column that is one-hot encoded.
ONEHOT_LEVELS = 20


def screen_features(df: DataFrame, target: str) -> list[str]:
    """Columns fit for training: not named id or *_id, and no text column with a
    distinct value on more than 80 % of the rows."""
    names = [c for c in df.columns if c != target and c.lower() != "id" and not c.lower().endswith("_id")]
    texts = [c for c in names if is_text(df.schema[c].dataType)]
    if not texts:
        return names
    rows, counts = df.count(), distinct_counts(df, texts)
    return [c for c in names if c not in texts or counts[c] <= 0.8 * rows]


def missing_features(df: DataFrame, features: list[str]) -> list[str]:
    return [f for f in features if f not in df.columns]


def align(df: DataFrame, numeric: list[str], other: list[str]) -> DataFrame:
    """Scoring rows in the types of training: numbers or NULL, and text kept as it is."""
    absent = missing_features(df, [*numeric, *other])
    if absent:
        raise ValueError(f"input lacks the features {absent}")
    out = {}
    for c in numeric:
        kind = df.schema[c].dataType
        if isinstance(kind, T.BooleanType):
            out[c] = col(c).cast("int").cast("double")
        elif is_numeric(kind):
            out[c] = col(c).cast("double")
        else:
            out[c] = col(c).cast("string").try_cast("double")
    out.update({c: col(c).cast("string") for c in other})
    return df.withColumns(out) if out else df


@dataclass
class Prep:
    """Fitted preparation: median fill and standard scaling of numbers, one-hot of
    columns with few levels, sorted codes (-1 for unseen) of the others."""

    numeric: list[str]
    low: list[str]
    high: list[str]
    fill: clean.Filler
    scaling: scale.ScaleModel
    onehot: encode.OneHotModel
    codes: encode.LookupModel
    names: list[tuple[str, str]] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.low, *self.high]

    def prepare(self, df: DataFrame) -> DataFrame:
        """Only the input columns, filled, scaled and encoded; other columns are kept."""
        out = self.fill.transform(align(df, self.numeric, [*self.low, *self.high]))
        return self.onehot.transform(self.codes.transform(self.scaling.transform(out)))

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        """Adds the feature vector and keeps the input columns as they were."""
        kept = [c for c in df.columns if c != output]
        used = self.features
        copies = df.select(*[col(c) for c in kept], *[col(c).alias(f"_in_{i}") for i, c in enumerate(kept) if c in used])
        ready = self.prepare(copies)
        vector = VectorAssembler(inputCols=[n for n, _ in self.names], outputCol=output, handleInvalid="keep")
        done = vector.transform(ready)
        return done.select(
            *[col(f"_in_{i}").alias(c) if c in used else col(c) for i, c in enumerate(kept)], col(output)
        )

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {
            "numeric": self.numeric, "low": self.low, "high": self.high, "fill": self.fill.values,
            "scaling": self.scaling.params, "levels": self.onehot.levels, "names": self.names,
        }
        write_json(spark, plain, f"{path}/prep")
        for i, c in enumerate(self.high):
            self.codes.tables[c].write.parquet(f"{path}/codes_{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Prep":
        p = read_json(spark, f"{path}/prep")
        tables = {c: spark.read.parquet(f"{path}/codes_{i}") for i, c in enumerate(p["high"])}
        return Prep(
            p["numeric"], p["low"], p["high"], clean.Filler(p["fill"]),
            scale.ScaleModel({c: tuple(v) for c, v in p["scaling"].items()}),
            encode.OneHotModel(p["levels"], all_levels=True), encode.LookupModel(tables, -1, "int"),
            [tuple(n) for n in p["names"]],
        )


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def build(df: DataFrame, cols: list[str], max_levels: int = ONEHOT_LEVELS) -> Prep:
    """Route the columns and fit each branch. A column without any value is left out."""
    numeric = [c for c in cols if is_numeric(df.schema[c].dataType)]
    other = [c for c in cols if c not in numeric]
    typed = align(df.select(*[col(c) for c in cols]), numeric, other)
    counts = distinct_counts(typed, other) if other else {}
    low = [c for c in other if 0 < counts[c] <= max_levels]
    high = [c for c in other if counts[c] > max_levels]
    fill = clean.Imputer("auto", [*numeric, *low, *high]).fit(typed)
    numeric = [c for c in numeric if fill.values.get(c) is not None]
    filled = fill.transform(typed)
    scaling = scale.fit(filled, numeric, "standard")
    onehot = encode.OneHotModel({c: encode.levels(filled, c) for c in low}, all_levels=True)
    codes = encode.label(filled, high)
    names = [(c, c) for c in numeric] + [(c, c) for c in high]
    names += [(n, c) for c in low for n, _ in onehot.names(c)]
    return Prep(numeric, low, high, fill, scaling, onehot, codes, names)
