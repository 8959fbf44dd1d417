"""Workflow report: a metrics frame and its Markdown text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import profile


def metrics(df: DataFrame, active: list[str] | None = None, actions: list[str] = (), model: dict | None = None, leaderboard: DataFrame | None = None) -> DataFrame:
    """(section, position, metric, value) rows of the report."""
    active = [c for c in (active or df.columns) if c in df.columns]
    head: list[tuple[str, Column]] = [
        ("rows", F.col("rows").cast("string")),
        ("columns", F.col("columns").cast("string")),
        ("active_features", F.lit(str(len(active)))),
        ("missing_cells", profile.missing_cells(df).scalar().cast("string")),
        ("duplicate_rows", profile.duplicate_rows(df).scalar().cast("string")),
        ("size_mb", F.format_number(profile.data_size(df).select("size_mb").scalar(), 2)),
    ]
    cells = [
        F.struct(F.lit("dataset").alias("section"), F.lit(i).alias("position"), F.lit(k).alias("metric"), v.alias("value"))
        for i, (k, v) in enumerate(head)
    ]
    parts = [profile.shape(df).select(F.inline(F.array(*cells)))]
    notes = [("actions", i, f"step_{i + 1}", a) for i, a in enumerate(actions)]
    notes += [("model", i, k, str(v)) for i, (k, v) in enumerate((model or {}).items())]
    if notes:
        parts.append(df.sparkSession.createDataFrame(notes, "section string, position int, metric string, value string"))
    if leaderboard is not None:
        name, *scores = leaderboard.columns
        for i, s in enumerate(scores):
            parts.append(
                leaderboard.select(
                    F.lit("leaderboard").alias("section"), F.lit(i).alias("position"),
                    F.concat_ws(" / ", F.col(name), F.lit(s)).alias("metric"), F.round(F.col(f"`{s}`"), 4).cast("string").alias("value"),
                )
            )
    return reduce(DataFrame.unionByName, parts)


def markdown(report: DataFrame) -> str:
    """The metrics frame, a few rows a section, as Markdown."""
    lines, section = ["# Workflow report"], None
    for r in report.orderBy("section", "position", "metric").collect():
        if r["section"] != section:
            section = r["section"]
            lines += ["", f"## {section.capitalize()}"]
        lines.append(f"- **{r['metric']}**: {r['value']}")
    return "\n".join(lines)
