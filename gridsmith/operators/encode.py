"""Category encodings. Levels are fitted once; small level sets become literals in
the projection, larger ones a looked-up table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, require
from ..functions.distributed import lookup_join, running_totals
from ..session import materialize
from .profile import distinct_counts

LITERAL_LEVELS = 200


def encodable(df: DataFrame, limit: int = 50) -> list[str]:
    counts = distinct_counts(df)
    return [c for c in df.columns if counts[c] <= limit]


def level_counts(df: DataFrame, name: str) -> DataFrame:
    """Rows per non-null value: level (typed as the column), _n."""
    return df.where(col(name).isNotNull()).groupBy(col(name).alias("level")).agg(F.count(F.lit(1)).alias("_n"))


def levels(df: DataFrame, name: str) -> list:
    """Sorted levels of a column already known to have few."""
    return [r[0] for r in df.select(col(name)).where(col(name).isNotNull()).distinct().orderBy(col(name)).collect()]


@dataclass
class OneHotModel:
    """Fitted levels per column; the first is dropped unless ``all_levels``."""

    levels: dict[str, list]
    all_levels: bool = False

    def names(self, column: str) -> list[tuple[str, object]]:
        kept = self.levels[column] if self.all_levels else self.levels[column][1:]
        return [(f"{column}_{v}", v) for v in kept]

    def transform(self, df: DataFrame) -> DataFrame:
        live = [c for c in self.levels if c in df.columns]
        flags = [
            F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(n) for c in live for n, v in self.names(c)
        ]
        return df.select(*[col(c) for c in df.columns if c not in live], *flags)


def onehot(df: DataFrame, cols: list[str], max_levels: int = 15) -> OneHotModel:
    """Columns with more levels than ``max_levels`` are left as they are."""
    cols = [c for c in cols if c in df.columns]
    counts = distinct_counts(df, cols) if cols else {}
    return OneHotModel({c: levels(df, c) for c in cols if counts[c] <= max_levels})


@dataclass
class LookupModel:
    """Fitted table (level, _n, code) per column; unseen and missing values get ``default``."""

    tables: dict[str, DataFrame]
    default: float
    kind: str
    suffix: str = ""
    small: dict[str, dict] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        added = []
        for name, table in self.tables.items():
            if name not in df.columns:
                continue
            out = f"{name}{self.suffix}"
            if name in self.small:
                items = [x for k, v in self.small[name].items() for x in (F.lit(k), F.lit(v))]
                code = F.create_map(*items)[col(name)] if items else F.lit(None)
            else:
                side = table.select(F.col("level").alias(name), "_n", F.col("code").alias("_code"))
                df = lookup_join(df, side, [name], "_n")
                code = F.col("_code")
            df = df.withColumn(out, F.coalesce(code.cast(self.kind), F.lit(self.default).cast(self.kind)))
            df = df.drop("_code")
            if out not in order:
                added.append(out)
        return df.select(*[col(c) for c in [*order, *added]])


def _lookup(df: DataFrame, cols: list[str], code, default: float, kind: str, suffix: str = "") -> LookupModel:
    tables, small = {}, {}
    rows = df.count()
    for c in cols:
        table = materialize(code(level_counts(df, c), rows))
        tables[c] = table
        few = table.limit(LITERAL_LEVELS + 1).collect()
        if len(few) <= LITERAL_LEVELS:
            small[c] = {r["level"]: r["code"] for r in few}
    return LookupModel(tables, default, kind, suffix, small)


def label(df: DataFrame, cols: list[str]) -> LookupModel:
    """Codes 0.. in sorted order of the values; missing and unseen are -1."""

    def code(counts: DataFrame, rows: int) -> DataFrame:
        ranked = running_totals(counts.withColumn("one", F.lit(1)), [], "level", ["one"], rows)
        return ranked.select("level", "_n", (F.col("cum_one") - 1).cast("int").alias("code"))

    return _lookup(df, [c for c in cols if c in df.columns], code, -1, "int")


def frequency(df: DataFrame, cols: list[str], suffix: str = "") -> LookupModel:
    """Share of the non-missing rows that hold the value; missing and unseen are 0."""

    def code(counts: DataFrame, rows: int) -> DataFrame:
        total = counts.agg(F.sum("_n")).scalar()
        return counts.select("level", "_n", (F.col("_n") / total).alias("code"))

    return _lookup(df, [c for c in cols if c in df.columns], code, 0.0, "double", suffix)


def frequency_feature(df: DataFrame, name: str) -> LookupModel:
    """Frequency as a new column ``<name>_freq``."""
    require(df, name)
    return frequency(df, [name], "_freq")


def encode(df: DataFrame, cols: list[str], method: str = "onehot", max_levels: int = 15):
    if method == "onehot":
        return onehot(df, cols, max_levels)
    if method == "label":
        return label(df, cols)
    if method == "frequency":
        return frequency(df, cols)
    raise ValueError(f"unknown method '{method}'")
