"""A recorded chain of steps that is fitted on one table and replayed on others."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    """``fit`` takes the table so far and returns a table-to-table function or a
    fitted object with ``transform``."""

    label: str
    fit: Callable[[DataFrame], object]

    @staticmethod
    def plain(label: str, change: Callable[[DataFrame], DataFrame]) -> "Step":
        """A step without fitted state."""
        return Step(label, lambda df: change)


def _run(fitted: object, df: DataFrame) -> DataFrame:
    return fitted.transform(df) if hasattr(fitted, "transform") else fitted(df)


@dataclass(frozen=True)
class FittedRecipe:
    parts: tuple[tuple[str, object], ...]

    def transform(self, df: DataFrame) -> DataFrame:
        for _, part in self.parts:
            df = _run(part, df)
        return df


@dataclass(frozen=True)
class Recipe:
    """Immutable list of steps: adding or stepping back gives another recipe, and
    the raw table is never copied."""

    steps: tuple[Step, ...] = ()

    def add(self, step: Step) -> "Recipe":
        return Recipe((*self.steps, step))

    def back(self, steps: int = 1) -> "Recipe":
        return Recipe(self.steps[: max(len(self.steps) - steps, 0)])

    def fit(self, raw: DataFrame) -> FittedRecipe:
        parts, df = [], raw
        for step in self.steps:
            fitted = step.fit(df)
            parts.append((step.label, fitted))
            df = _run(fitted, df)
        return FittedRecipe(tuple(parts))

    def apply(self, raw: DataFrame) -> DataFrame:
        return self.fit(raw).transform(raw)

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i + 1, s.label) for i, s in enumerate(self.steps)], "step int, action string")
