"""Rules over the profile: cleaning advice and feature advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, datetime_columns, is_numeric, is_text
from . import clean, encode, features, profile, relate

# Issue names, action names and severities of the advice frame.
DUPLICATES = ("Duplicate Rows", "high", "remove_duplicates")
MOSTLY_MISSING = ("High Missing Ratio", "high", "drop_column")
MISSING_SKEWED = ("Missing Values (Skewed)", "medium", "impute_median")
MISSING_NUMERIC = ("Missing Values", "medium", "impute_mean")
MISSING_CATEGORY = ("Missing Values (Categorical)", "medium", "impute_mode")
CONSTANT = ("Constant Column", "medium", "drop_column")
IDENTIFIER = ("Identifier Detection", "info", "drop_column")
OUTLIERS = ("Outliers Detected", "medium", "cap_outliers_iqr")
SKEWED = ("High Right Skewness", "info", "apply_log1p")
COLLINEAR = ("High Collinearity", "info", "drop_column_col2")

ADVICE_COLUMNS = ["id", "issue", "column", "severity", "recommendation", "action_type", "action_label", "target_col"]


def _advice(source: DataFrame, rule: int, kind: tuple, order: list[Column], column: Column, text: Column, target: Column) -> DataFrame:
    issue, severity, action = kind
    verb = F.lit(action.replace("_col2", "").replace("_", " "))
    return source.select(
        F.lit(rule).alias("_rule"),
        F.array(*[o.cast("double") for o in order]).alias("_order"),
        F.lit(issue).alias("issue"),
        column.alias("column"),
        F.lit(severity).alias("severity"),
        text.alias("recommendation"),
        F.lit(action).alias("action_type"),
        F.concat_ws(": ", verb, target).alias("action_label"),
        target.alias("target_col"),
    )


def quality(df: DataFrame) -> DataFrame:
    """Cleaning advice, one row per finding, numbered in rule order.

    The advice frame has at most a few rows per column and correlated pair, so its
    numbering window is small whatever the size of the table.
    """
    flags = profile.column_flags(df)
    skew = profile.skewness(df).select("column", "skew")
    out = profile.outliers(df).select("column", "outliers")
    p = flags.join(skew, "column", "left").join(out, "column", "left")
    c, pos, pct, skw = F.col("column"), F.col("position"), F.col("missing_pct"), F.coalesce("skew", F.lit(0.0))
    gap, numeric, many = F.col("missing") > 0, F.col("kind") == "numeric", F.col("missing_pct") > 60
    by_gap, share = [-pct, pos], F.col("outliers") * 100.0 / F.col("rows")
    say = F.format_string
    parts = [
        _advice(
            profile.duplicate_rows(df).where("duplicates > 0"), 1, DUPLICATES, [F.lit(0)], F.lit("All Rows"),
            say("%d rows repeat an earlier row; remove them before splitting or modelling", F.col("duplicates")),
            F.lit("All Rows"),
        ),
        _advice(
            p.where(gap & many), 2, MOSTLY_MISSING, by_gap, c,
            say("'%s' lacks %.1f%% of its values (%d rows); drop the column", c, pct, F.col("missing")), c,
        ),
        _advice(
            p.where(gap & ~many & numeric & (F.abs(skw) > 1)), 2, MISSING_SKEWED, by_gap, c,
            say("'%s' lacks %.1f%% of its values and is skewed (%.2f); fill with the median", c, pct, F.abs(skw)), c,
        ),
        _advice(
            p.where(gap & ~many & numeric & (F.abs(skw) <= 1)), 2, MISSING_NUMERIC, by_gap, c,
            say("'%s' lacks %.1f%% of its values; fill with the mean", c, pct), c,
        ),
        _advice(
            p.where(gap & ~many & ~numeric), 2, MISSING_CATEGORY, by_gap, c,
            say("'%s' lacks %.1f%% of its values; fill with the most frequent one", c, pct), c,
        ),
        _advice(p.where("is_constant"), 3, CONSTANT, [pos], c, say("'%s' has a single value; drop it", c), c),
        _advice(
            p.where("is_identifier"), 4, IDENTIFIER, [pos], c,
            say("'%s' looks like a key; leave it out of models", c), c,
        ),
        _advice(
            p.where((F.col("outliers") > 0) & (share >= 1.0)), 5, OUTLIERS, [pos], c,
            say("'%s' has %d outliers (%.1f%% of rows); cap them at the quartile fences", c, F.col("outliers"), share), c,
        ),
        _advice(
            p.where((F.col("skew") > 1.5) & ~F.col("is_constant")), 6, SKEWED, [pos], c,
            say("'%s' is right-skewed (%.2f); take log(1 + x)", c, skw), c,
        ),
    ]
    if sum(is_numeric(f.dataType) for f in df.schema.fields) >= 2:
        a, b = F.col("a"), F.col("b")
        parts.append(
            _advice(
                relate.high_pairs(df), 7, COLLINEAR, [F.col("position")], F.concat_ws(" & ", a, b),
                say("'%s' and '%s' move together (r = %.2f); drop '%s'", a, b, F.col("r"), b), b,
            )
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    number = F.row_number().over(Window.orderBy("_rule", "_order"))
    return found.withColumn("id", F.concat(F.lit("rec_"), number.cast("string"))).select(*ADVICE_COLUMNS)


def apply(df: DataFrame, action_type: str, target: str) -> DataFrame:
    """Carry out one piece of advice; an unknown action leaves the table as it is."""
    actions = {
        "remove_duplicates": lambda: clean.remove_duplicates(df),
        "drop_column": lambda: clean.drop_columns(df, [target]),
        "drop_column_col2": lambda: clean.drop_columns(df, [target]),
        "impute_median": lambda: clean.Imputer("median", [target]).fit(df).transform(df),
        "impute_mean": lambda: clean.Imputer("mean", [target]).fit(df).transform(df),
        "impute_mode": lambda: clean.Imputer("mode", [target]).fit(df).transform(df),
        "cap_outliers_iqr": lambda: clean.OutlierCap([target]).fit(df).transform(df),
        "apply_log1p": lambda: clean.apply_log1p(df, target),
    }
    return actions[action_type]() if action_type in actions else df


FEATURE_SCHEMA = (
    "position int, type string, columns array<string>, title string, description string, "
    "priority string, action string, params map<string,string>"
)


def features_advice(df: DataFrame, target: str | None = None) -> DataFrame:
    """Feature advice by type, distinct values, skew and correlation, in rule order."""
    cols = [c for c in df.columns if c != target]
    kept = df.select(*[col(c) for c in cols])
    if not cols or kept.limit(1).count() == 0:
        return df.sparkSession.createDataFrame([], FEATURE_SCHEMA)
    kinds = {f.name: f.dataType for f in kept.schema.fields}
    distinct = profile.distinct_counts(kept)
    numbers = [c for c in cols if is_numeric(kinds[c]) and distinct[c] > 2]
    texts = [c for c in cols if is_text(kinds[c])]
    row = kept.agg(
        F.lit(0),
        *[e for c in numbers for e in (F.count(col(c)), profile.adjusted_skew(col(c)))],
        *[F.avg(F.length(col(c))) for c in texts],
    ).first()
    present = {c: row[1 + 2 * i] for i, c in enumerate(numbers)}
    skew = {c: row[2 + 2 * i] for i, c in enumerate(numbers)}
    mean_len = {c: row[1 + 2 * len(numbers) + i] or 0 for i, c in enumerate(texts)}

    found: list[tuple] = []

    def add(kind: str, columns: list[str], title: str, why: str, priority: str, action: str, params: dict) -> None:
        found.append((len(found), kind, columns, title, why, priority, action, {k: str(v) for k, v in params.items()}))

    for c in datetime_columns(kept):
        add("datetime", [c], f"Date parts of '{c}'", f"'{c}' holds dates; year, month, day, weekday and weekend show seasons",
            "High", "create_datetime_features", {"column": c})
    for c in numbers:
        if present[c] > 10 and skew[c] is not None and skew[c] > 1:
            add("log_transform", [c], f"Log of '{c}'", f"'{c}' is right-skewed ({skew[c]:.2f})",
                "High" if skew[c] > 2 else "Medium", "create_log_transform", {"column": c, "method": "log1p"})
    if len(numbers) >= 2:
        pairs = relate.pearson(kept, numbers).where(F.abs("r").between(0.3, 0.85)).orderBy("position").limit(3)
        for p in pairs.collect():
            add("interaction", [p["a"], p["b"]], f"'{p['a']}' times '{p['b']}'",
                f"moderate correlation ({abs(p['r']):.2f}) may carry a joint signal",
                "Medium", "create_interaction_features", {"col1": p["a"], "col2": p["b"], "operation": "multiply"})
    groups = [c for c in cols if 2 <= distinct[c] <= 30 and (not is_numeric(kinds[c]) or distinct[c] <= 10)]
    for g, t in [(g, t) for g in groups for t in numbers if g != t][:3]:
        add("group_aggregate", [g, t], f"Mean of '{t}' by '{g}'", f"'{t}' within each '{g}' gives a segment level",
            "Medium", "create_group_aggregate_features", {"group_col": g, "target_col": t, "agg_funcs": "mean,std"})
    for c in [c for c in numbers if distinct[c] > 20][:2]:
        add("binning", [c], f"Quantile bins of '{c}'", f"'{c}' is continuous ({distinct[c]} values)",
            "Low", "create_binned_features", {"column": c, "num_bins": 4, "strategy": "quantile"})
    for c in texts:
        if distinct[c] > 10 and mean_len[c] > 15:
            add("text_stats", [c], f"Length and words of '{c}'", f"'{c}' is text of {mean_len[c]:.1f} characters on average",
                "Medium", "create_text_stats_features", {"column": c})
    for c in texts:
        if distinct[c] > 15:
            add("frequency_encode", [c], f"Frequency of '{c}'", f"'{c}' has {distinct[c]} categories",
                "High", "create_frequency_encoding", {"column": c})
    return df.sparkSession.createDataFrame(found, FEATURE_SCHEMA)


def apply_feature(df: DataFrame, action: str, params: dict) -> DataFrame:
    """Carry out one piece of feature advice."""
    actions = {
        "create_datetime_features": lambda: features.datetime_features(df, params["column"]),
        "create_log_transform": lambda: features.log_transform(df, params["column"], params.get("method", "log1p")).transform(df),
        "create_interaction_features": lambda: features.interaction(
            df, params["col1"], params["col2"], params.get("operation", "multiply")
        ),
        "create_group_aggregate_features": lambda: features.group_features(
            df, params["group_col"], params["target_col"], params.get("agg_funcs", "mean,std").split(",")
        ).transform(df),
        "create_binned_features": lambda: features.bins(
            df, params["column"], int(params.get("num_bins", 4)), params.get("strategy", "quantile"), labels=True
        ).transform(df),
        "create_text_stats_features": lambda: features.text_stats(df, params["column"]),
        "create_frequency_encoding": lambda: encode.frequency_feature(df, params["column"]).transform(df),
    }
    if action not in actions:
        raise ValueError(f"unknown action '{action}'")
    return actions[action]()


def generate_features(df: DataFrame, target: str | None = None, max_features: int = 5) -> tuple[DataFrame, list[str]]:
    """Apply the first advised features; returns the table and the applied titles."""
    applied = []
    for rec in features_advice(df, target).orderBy("position").limit(max_features).collect():
        df = apply_feature(df, rec["action"], rec["params"])
        applied.append(rec["title"])
    return df, applied
