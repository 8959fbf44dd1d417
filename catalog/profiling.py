"""Profile, relation and advice queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gridsmith.functions import columns as cl
from gridsmith.operators import profile, recommend, relate
from gridsmith.sources import tables

from .base import and_with, query, rnd, rounded, table, union, view, with_view

LI_COLS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
           "l_returnflag", "l_linestatus", "l_shipdate"]
LI_NUM = LI_COLS[:7]
LI_TXT = LI_COLS[7:]
EV_COLS = ["event_id", "user_id", "ts", "event_type", "value"]
PA_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "p_small", "p_const"]
PA_NUM = ["p_partkey", "p_size", "p_retailprice", "p_small"]


def summary_sql(name: str, cols: list[str]) -> str:
    def one(c: str) -> str:
        return (
            f"SELECT '{c}' AS \"column\", count(x) AS \"count\", count(*) - count(x) AS missing, {rnd('avg(x)', 4)} AS mean, "
            f"{rnd('quantile_cont(x, 0.5)', 4)} AS median, {rnd('stddev_samp(x)', 4)} AS std, min(x) AS \"min\", max(x) AS \"max\", "
            f"{rnd('max(q3) - max(q1)', 4)} AS iqr, {rnd('coalesce(skewness(x), 0.0)', 5)} AS skew, "
            "coalesce(sum(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END), 0)::BIGINT AS outliers "
            f"FROM (SELECT {c}::DOUBLE AS x FROM {name}) t, "
            f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {name}) q"
        )

    return union([one(c) for c in cols])


@query("profile_lineitem", with_view("li", summary_sql("li", LI_NUM)))
def profile_lineitem(spark, sf):
    out = profile.numeric_summary(tables.normalize_missing(view(spark, sf, "li"))).drop("position")
    return rounded(rounded(out, 4, "mean", "median", "std", "iqr"), 5, "skew")


@query("profile_events", with_view("ev", summary_sql("ev", ["event_id", "user_id", "value"])))
def profile_events(spark, sf):
    out = profile.numeric_summary(view(spark, sf, "ev")).drop("position")
    return rounded(rounded(out, 4, "mean", "median", "std", "iqr"), 5, "skew")


@query("table_shape", "SELECT count(*) AS \"rows\", 11::BIGINT AS \"columns\" FROM lineitem")
def table_shape(spark, sf):
    return profile.shape(table(spark, sf, "lineitem"))


@query(
    "data_size",
    "SELECT sum(8 + 8 + strlen(text) + strlen(lang) + strlen(source))::BIGINT AS bytes, "
    f"{rnd('sum(8 + 8 + strlen(text) + strlen(lang) + strlen(source)) / 1048576.0', 6)} AS size_mb FROM documents",
)
def data_size(spark, sf):
    return rounded(profile.data_size(table(spark, sf, "documents")), 6)


def missing_sql(name: str, cols: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, "
            f"{rnd(f'(count(*) - count({c})) * 100.0 / count(*)', 6)} AS missing_pct FROM {name}"
            for c in cols
        ]
    )


@query("missing_by_column", with_view("li", missing_sql("li", LI_COLS)))
def missing_by_column(spark, sf):
    return rounded(profile.missing(view(spark, sf, "li")).drop("position"), 6)


@query("missing_cells", and_with("pa", f"m AS ({missing_sql('pa', PA_COLS)}) SELECT sum(missing)::BIGINT AS missing_cells FROM m"))
def missing_cells(spark, sf):
    return profile.missing_cells(view(spark, sf, "pa"))


@query(
    "missing_table",
    and_with(
        "pa",
        f"m AS ({missing_sql('pa', PA_COLS)}) SELECT \"column\", missing, missing_pct, "
        "CASE \"column\" WHEN 'p_brand' THEN 'string' ELSE 'int' END AS dtype FROM m WHERE missing > 0",
    ),
)
def missing_table(spark, sf):
    return rounded(profile.missing_table(view(spark, sf, "pa")).drop("position"), 6)


@query(
    "top_missing",
    and_with("li", f"m AS ({missing_sql('li', LI_COLS)}) SELECT * FROM m WHERE missing > 0 ORDER BY missing_pct DESC, \"column\" LIMIT 10"),
)
def top_missing(spark, sf):
    return rounded(profile.top_missing(view(spark, sf, "li")).drop("position"), 6)


KINDS = union(
    [
        f"SELECT '{c}' AS \"column\", '{'numeric' if c in LI_NUM else 'categorical'}' AS kind, count(*) - count({c}) AS missing FROM li" for c in LI_COLS
    ]
)


@query("column_kinds", with_view("li", KINDS))
def column_kinds(spark, sf):
    df = view(spark, sf, "li")
    return cl.column_kinds(df).select("column", "kind").join(profile.missing(df).select("column", "missing"), "column")


@query(
    "feature_type_counts",
    "SELECT CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'Numeric Features' ELSE 'Categorical Features' END AS \"type\", count(*) AS \"count\" "
    "FROM information_schema.columns WHERE table_name = 'part' GROUP BY 1",
)
def feature_type_counts(spark, sf):
    return profile.type_counts(table(spark, sf, "part"))


@query("type_counts", and_with("li", f"k AS ({KINDS}) SELECT kind, count(*) AS \"count\", sum(missing)::BIGINT AS missing FROM k GROUP BY 1"))
def type_counts(spark, sf):
    return column_kinds(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("count"), F.sum("missing").alias("missing"))


@query(
    "duplicate_rows",
    "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)",
)
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "events").select("user_id", "event_type"))


@query(
    "duplicate_texts",
    "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)",
)
def duplicate_texts(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


def distinct_sql(name: str, cols: list[str]) -> str:
    return union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM {name}" for c in cols])


@query("cardinality", with_view("li", distinct_sql("li", LI_COLS)))
def cardinality(spark, sf):
    return profile.cardinality(view(spark, sf, "li")).drop("position")


@query("constant_columns", with_view("pa", "SELECT 'p_const' AS \"column\" FROM pa HAVING count(DISTINCT p_const) <= 1"))
def constant_columns(spark, sf):
    names = profile.constant_columns(view(spark, sf, "pa"))
    return spark.createDataFrame([(n,) for n in names], "column string")


def flags_sql(name: str, cols: list[str], numeric: list[str]) -> str:
    def one(c: str) -> str:
        kind = "numeric" if c in numeric else "categorical"
        d = f"count(DISTINCT {c})"
        named = any(c.lower().endswith(e) for e in cl.IDENTIFIER_ENDINGS)
        return (
            f"SELECT '{c}' AS \"column\", '{kind}' AS kind, {d} AS \"distinct\", "
            f"({d} + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END) <= 1 AS is_constant, "
            f"({str(named).lower()} OR ({d} >= greatest(count(*) * 0.95, 1) AND count(*) > 10)) AS is_identifier, "
            f"({str(kind == 'categorical').lower()} AND {d} > greatest(20, count(*) * 0.05)) AS is_high_cardinality FROM {name}"
        )

    return union([one(c) for c in cols])


@query("column_flags", with_view("pa", flags_sql("pa", PA_COLS, PA_NUM)))
def column_flags(spark, sf):
    return profile.column_flags(view(spark, sf, "pa")).drop("position", "rows", "missing", "missing_pct")


@query("column_flags_events", with_view("ev", flags_sql("ev", EV_COLS, ["event_id", "user_id", "value"])))
def column_flags_events(spark, sf):
    return profile.column_flags(view(spark, sf, "ev")).drop("position", "rows", "missing", "missing_pct")


@query(
    "high_cardinality",
    "SELECT c AS \"column\" FROM (" + union(
        [f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d, count(*) AS n FROM documents" for c in ("text", "lang", "source")]
    ) + ") WHERE d > greatest(20, n * 0.05)",
)
def high_cardinality(spark, sf):
    return profile.column_flags(table(spark, sf, "documents")).where("is_high_cardinality").select("column")


@query(
    "skewness",
    with_view("li", union([f"SELECT '{c}' AS \"column\", {rnd(f'skewness({c})', 5)} AS skew FROM li" for c in LI_NUM])),
)
def skewness(spark, sf):
    return rounded(profile.skewness(view(spark, sf, "li")).drop("position"), 5)


def outlier_sql(name: str, cols: list[str]) -> str:
    return "SELECT * FROM (" + union(
        [
            f"SELECT '{c}' AS \"column\", sum(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END)::BIGINT "
            f"AS outliers FROM {name}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {name}) q "
            "WHERE q3 > q1"
            for c in cols
        ]
    ) + ") WHERE outliers > 0"


@query("outlier_counts", with_view("ev", outlier_sql("ev", ["event_id", "user_id", "value"])))
def outlier_counts(spark, sf):
    return profile.outliers(view(spark, sf, "ev")).drop("position")


def cat_sql(name: str, cols: list[str]) -> str:
    def one(c: str) -> str:
        return (
            f"SELECT '{c}' AS \"column\", (SELECT count({c}) FROM {name}) AS \"count\", (SELECT count(*) - count({c}) FROM {name}) AS missing, "
            f"(SELECT count(DISTINCT {c}) FROM {name}) AS \"unique\", v AS top, n AS top_freq, "
            f"{rnd(f'n * 100.0 / (SELECT count({c}) FROM {name})', 6)} AS top_pct "
            f"FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"
        )

    return union([one(c) for c in cols])


@query("categorical_summary", with_view("li", cat_sql("li", ["l_returnflag", "l_linestatus"])))
def categorical_summary(spark, sf):
    out = profile.categorical_summary(view(spark, sf, "li"), ["l_returnflag", "l_linestatus"]).drop("position")
    return rounded(out, 6)


@query("categorical_summary_parts", with_view("pa", cat_sql("pa", ["p_name", "p_brand", "p_type", "p_const"])))
def categorical_summary_parts(spark, sf):
    return rounded(profile.categorical_summary(view(spark, sf, "pa")).drop("position"), 6)


@query(
    "health",
    "SELECT count(*) AS \"rows\", 6::BIGINT AS \"columns\", "
    f"{rnd('sum(8 + 8 + 8 + 8 + strlen(event_type) + strlen(props)) / 1048576.0', 6)} AS size_mb, "
    "0::BIGINT AS duplicates, 0::BIGINT AS missing_cells, "
    f"(SELECT count(*) FROM ({outlier_sql('events', ['event_id', 'user_id', 'value'])})) AS outlier_columns FROM events",
)
def health(spark, sf):
    return rounded(profile.health(table(spark, sf, "events")), 6)


def pair_sql(name: str, pairs: list[tuple[str, str]], digits: int = 5) -> str:
    return union(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END', digits)} AS r FROM {name}"
            for a, b in pairs
        ]
    )


@query("pearson_matrix", with_view("li", pair_sql("li", list(combinations(LI_NUM, 2)))))
def pearson_matrix(spark, sf):
    return rounded(relate.pearson(view(spark, sf, "li")).drop("position"), 5)


PART_WIDE = "SELECT *, p_retailprice * 1.5 + p_size AS p_alt, p_partkey * -2.0 AS p_neg FROM part"
PART_WIDE_NUM = ["p_partkey", "p_size", "p_retailprice", "p_alt", "p_neg"]


def part_wide(spark, sf):
    return table(spark, sf, "part").selectExpr("*", "p_retailprice * 1.5 + p_size AS p_alt", "p_partkey * -2.0D AS p_neg")


@query(
    "correlated_pairs",
    f"WITH w AS ({PART_WIDE}), c AS ({pair_sql('w', list(combinations(PART_WIDE_NUM, 2)))}) "
    "SELECT a, b, abs(r) AS r FROM c WHERE abs(r) >= 0.85",
)
def correlated_pairs(spark, sf):
    return rounded(relate.high_pairs(part_wide(spark, sf)).drop("position"), 5)


@query(
    "target_correlation",
    "SELECT b AS feature, r FROM (" + pair_sql("lineitem", [("l_extendedprice", c) for c in
     ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]]) + ")",
)
def target_correlation(spark, sf):
    return rounded(relate.with_target(table(spark, sf, "lineitem"), "l_extendedprice"), 5)


SPEAR = ["l_partkey", "l_quantity", "l_extendedprice", "l_tax"]


def rank_sql(name: str, cols: list[str]) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in cols
    )
    return f"SELECT {ranks} FROM {name}"


@query("spearman_matrix", f"WITH r AS ({rank_sql('lineitem', SPEAR)}) {pair_sql('r', list(combinations(SPEAR, 2)))}")
def spearman_matrix(spark, sf):
    return rounded(relate.spearman(table(spark, sf, "lineitem"), SPEAR).drop("position"), 5)


@query(
    "spearman_with_gaps",
    and_with(
        "ev",
        "d AS (SELECT user_id, value FROM ev WHERE value IS NOT NULL), "
        f"r AS ({rank_sql('d', ['user_id', 'value'])}) {pair_sql('r', [('user_id', 'value')])}",
    ),
)
def spearman_with_gaps(spark, sf):
    return rounded(relate.spearman(view(spark, sf, "ev"), ["user_id", "value"]).drop("position"), 5)


@query(
    "kendall_tau",
    "WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2), "
    "s AS (SELECT sum(a.w * b.w) AS con FROM c a JOIN c b ON a.x < b.x AND a.y < b.y), "
    "d AS (SELECT sum(a.w * b.w) AS dis FROM c a JOIN c b ON a.x < b.x AND a.y > b.y), "
    "n AS (SELECT sum(w) * (sum(w) - 1) / 2 AS n0 FROM c), "
    "tx AS (SELECT sum(w * (w - 1) / 2) AS t FROM (SELECT sum(w) AS w FROM c GROUP BY x)), "
    "ty AS (SELECT sum(w * (w - 1) / 2) AS t FROM (SELECT sum(w) AS w FROM c GROUP BY y)) "
    f"SELECT 'l_quantity' AS a, 'l_discount' AS b, {rnd('(con - dis) / (sqrt(n0 - tx.t) * sqrt(n0 - ty.t))', 6)} AS r FROM s, d, n, tx, ty",
)
def kendall_tau(spark, sf):
    return rounded(relate.kendall(table(spark, sf, "lineitem"), "l_quantity", "l_discount"), 6)


@query(
    "missingness_correlation",
    and_with(
        "li",
        "f AS (SELECT CASE WHEN l_linenumber IS NULL THEN 1.0 ELSE 0.0 END AS l_linenumber, "
        "CASE WHEN l_discount IS NULL THEN 1.0 ELSE 0.0 END AS l_discount, CASE WHEN l_returnflag IS NULL THEN 1.0 ELSE 0.0 END AS l_returnflag FROM li) "
        + pair_sql("f", list(combinations(["l_linenumber", "l_discount", "l_returnflag"], 2))),
    ),
)
def missingness_correlation(spark, sf):
    return rounded(relate.missingness(view(spark, sf, "li")).drop("position"), 5)


@query(
    "class_distribution",
    with_view(
        "od",
        "SELECT o_orderpriority AS class, count(*) AS \"count\", round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent "
        "FROM od WHERE o_orderpriority IS NOT NULL GROUP BY 1",
    ),
)
def class_distribution(spark, sf):
    return profile.class_distribution(view(spark, sf, "od"), "o_orderpriority")


@query(
    "class_imbalance",
    f"SELECT count(*) AS classes, {rnd('max(n)::DOUBLE / min(n)', 6)} AS ratio, {rnd('min(n) * 100.0 / sum(n)', 6)} AS minority_pct, "
    "min(n) * 100.0 / sum(n) < 20 AND count(*) > 1 AS minority_alert, max(n)::DOUBLE / min(n) >= 3 AS ratio_alert "
    "FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)",
)
def class_imbalance(spark, sf):
    return rounded(profile.imbalance(table(spark, sf, "labels"), "quality"), 6)


def task_sql(source: str, c: str, numeric: bool) -> str:
    rule = f"count(DISTINCT {c}) <= 20 AND count(DISTINCT {c}) / count(*)::DOUBLE < 0.05" if numeric else "TRUE"
    return (
        f"SELECT '{c}' AS target, count(*) AS \"rows\", count(DISTINCT {c}) AS \"distinct\", "
        f"CASE WHEN {rule} THEN 'Classification' ELSE 'Regression' END AS task FROM {source}"
    )


@query(
    "task_detection",
    union([task_sql("labels", "quality", True), task_sql("orders", "o_totalprice", True), task_sql("orders", "o_orderstatus", False)]),
)
def task_detection(spark, sf):
    orders = table(spark, sf, "orders")
    return (
        profile.detect_task(table(spark, sf, "labels"), "quality")
        .unionByName(profile.detect_task(orders, "o_totalprice"))
        .unionByName(profile.detect_task(orders, "o_orderstatus"))
    )


@query(
    "crosstab",
    with_view(
        "li",
        "SELECT l_returnflag AS \"row\", l_linestatus AS \"column\", count(*) AS \"count\", "
        f"{rnd('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_returnflag)', 6)} AS percent "
        "FROM li WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2",
    ),
)
def crosstab(spark, sf):
    return rounded(profile.crosstab(view(spark, sf, "li"), "l_returnflag", "l_linestatus"), 6)


@query(
    "input_domain",
    "SELECT 'o_totalprice' AS \"column\", min(o_totalprice) AS \"min\", max(o_totalprice) AS \"max\", "
    "round(quantile_cont(o_totalprice, 0.5), 4) AS \"default\", NULL::VARCHAR AS \"values\" FROM orders UNION ALL "
    "SELECT 'o_orderstatus', NULL, NULL, NULL, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders UNION ALL "
    "SELECT 'o_orderpriority', NULL, NULL, NULL, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders",
)
def input_domain(spark, sf):
    out = profile.input_domain(table(spark, sf, "orders"), ["o_totalprice", "o_orderstatus", "o_orderpriority"])
    return rounded(out, 4, "default").withColumn("values", F.array_join("values", ","))


def advice_sql(name: str, cols: list[str], numeric: list[str], dup: str) -> str:
    """All rules over one profile row per column, in rule order."""
    rows = []
    for i, c in enumerate(cols):
        num = c in numeric
        skew = f"skewness({c}::DOUBLE)" if num else "NULL::DOUBLE"
        q = f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {name})" if num else "(SELECT 0.0 AS q1, 0.0 AS q3)"
        out = (
            f"sum(CASE WHEN q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) THEN 1 ELSE 0 END)" if num else "0"
        )
        named = any(c.lower().endswith(e) for e in cl.IDENTIFIER_ENDINGS)
        rows.append(
            f"SELECT {i} AS pos, '{c}' AS c, {str(num).lower()} AS num, count(*) AS n, count(*) - count({c}) AS gap, count(DISTINCT {c}) AS d, "
            f"{skew} AS sk, {out} AS outl, {str(named).lower()} AS named FROM {name}, {q} q"
        )
    profile_sql = union(rows)
    pairs = list(combinations(numeric, 2))
    pair_rows = union(
        [f"SELECT {i} AS pos, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {name}" for i, (a, b) in enumerate(pairs)]
    )
    pct = "gap * 100.0 / n"
    const = "d + CASE WHEN gap > 0 THEN 1 ELSE 0 END <= 1"
    rules = [
        f"SELECT 1 AS ru, 0.0 AS o1, 0 AS o2, 'Duplicate Rows' AS issue, 'All Rows' AS c, 'high' AS severity, 'remove_duplicates' AS act, 'All Rows' AS tgt FROM ({dup}) WHERE duplicates > 0",
        f"SELECT 2, -{pct}, pos, 'High Missing Ratio', c, 'high', 'drop_column', c FROM p WHERE {pct} > 60",
        f"SELECT 2, -{pct}, pos, 'Missing Values (Skewed)', c, 'medium', 'impute_median', c FROM p WHERE gap > 0 AND {pct} <= 60 AND num AND abs(coalesce(sk, 0)) > 1",
        f"SELECT 2, -{pct}, pos, 'Missing Values', c, 'medium', 'impute_mean', c FROM p WHERE gap > 0 AND {pct} <= 60 AND num AND abs(coalesce(sk, 0)) <= 1",
        f"SELECT 2, -{pct}, pos, 'Missing Values (Categorical)', c, 'medium', 'impute_mode', c FROM p WHERE gap > 0 AND {pct} <= 60 AND NOT num",
        f"SELECT 3, 0, pos, 'Constant Column', c, 'medium', 'drop_column', c FROM p WHERE {const}",
        "SELECT 4, 0, pos, 'Identifier Detection', c, 'info', 'drop_column', c FROM p WHERE named OR (d >= greatest(n * 0.95, 1) AND n > 10)",
        "SELECT 5, 0, pos, 'Outliers Detected', c, 'medium', 'cap_outliers_iqr', c FROM p WHERE outl > 0 AND outl * 100.0 / n >= 1",
        f"SELECT 6, 0, pos, 'High Right Skewness', c, 'info', 'apply_log1p', c FROM p WHERE sk > 1.5 AND NOT ({const})",
        "SELECT 7, 0, pos, 'High Collinearity', a || ' & ' || b, 'info', 'drop_column_col2', b FROM pr WHERE abs(r) >= 0.85 AND NOT isnan(r)",
    ]
    return (
        f"p AS ({profile_sql}), pr AS ({pair_rows}), a AS ({union(rules)}) "
        "SELECT 'rec_' || row_number() OVER (ORDER BY ru, o1, o2) AS id, issue, c AS \"column\", severity, act AS action_type, tgt AS target_col FROM a"
    )


@query(
    "quality_advice",
    and_with("pa", advice_sql("pa", PA_COLS, PA_NUM, "SELECT sum(n - 1) AS duplicates FROM (SELECT count(*) AS n FROM pa GROUP BY " + ", ".join(PA_COLS) + ")")),
)
def quality_advice(spark, sf):
    return recommend.quality(view(spark, sf, "pa")).drop("recommendation", "action_label")


EV2 = ["event_type", "value"]


@query(
    "quality_advice_events",
    and_with(
        "ev",
        "e2 AS (SELECT user_id, event_type, value FROM ev), "
        + advice_sql("e2", ["user_id", "event_type", "value"], ["user_id", "value"],
                     "SELECT sum(n - 1) AS duplicates FROM (SELECT count(*) AS n FROM e2 GROUP BY user_id, event_type, value)"),
    ),
)
def quality_advice_events(spark, sf):
    out = recommend.quality(view(spark, sf, "ev").select("user_id", "event_type", "value"))
    return out.drop("recommendation", "action_label")


@query(
    "apply_advice",
    with_view(
        "ev",
        "SELECT event_id, user_id, event_type, CASE WHEN x < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) "
        "WHEN x > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE x END AS value FROM "
        "(SELECT event_id, user_id, event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ev)) AS x FROM ev) t, "
        "(SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM "
        "(SELECT coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ev)) AS x FROM ev)) q",
    ),
)
def apply_advice(spark, sf):
    df = view(spark, sf, "ev").drop("ts")
    df = recommend.apply(df, "impute_median", "value")
    return recommend.apply(df, "cap_outliers_iqr", "value")


@query("feature_advice")
def feature_advice(spark, sf):
    out = recommend.features_advice(table(spark, sf, "orders"), "o_totalprice")
    return out.select("position", "type", F.array_join("columns", ",").alias("columns"), "priority", "action")


def feature_advice_sql() -> str:
    num = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
    rows = [f"SELECT {i} AS pos, '{c}' AS c, count(DISTINCT {c}) AS d, count({c}) AS n, skewness({c}) AS sk FROM lineitem" for i, c in enumerate(num)]
    pairs = [f"SELECT {i} AS pos, '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM lineitem" for i, (a, b) in enumerate(combinations(num, 2))]
    text = union(
        [
            f"SELECT {i} AS pos, '{c}' AS c, count(DISTINCT {c}) AS d, avg(length({c})) AS len FROM lineitem"
            for i, c in enumerate(["l_returnflag", "l_linestatus"])
        ]
    )
    groups = union(
        [
            f"SELECT {i} AS pos, '{c}' AS c, count(DISTINCT {c}) AS d, {lim} AS lim FROM lineitem"
            for i, (c, lim) in enumerate([(x, 10) for x in num] + [("l_returnflag", 30), ("l_linestatus", 30)])
        ]
        + [f"SELECT 9, 'l_shipdate', count(DISTINCT l_shipdate), 30 FROM lineitem"]
    )
    return (
        f"WITH p AS ({union(rows)}), pr AS ({union(pairs)}), t AS ({text}), g AS ({groups}), live AS (SELECT * FROM p WHERE d > 2), "
        "a AS (SELECT 1 AS ru, 0 AS o1, 0 AS o2, 'datetime' AS type, 'l_shipdate' AS cols, 'High' AS priority, 'create_datetime_features' AS act "
        "UNION ALL SELECT 2, pos, 0, 'log_transform', c, CASE WHEN sk > 2 THEN 'High' ELSE 'Medium' END, 'create_log_transform' FROM live WHERE n > 10 AND sk > 1 "
        "UNION ALL SELECT * FROM (SELECT 3, pos, 0, 'interaction', a || ',' || b, 'Medium', 'create_interaction_features' FROM pr WHERE r BETWEEN 0.3 AND 0.85 ORDER BY pos LIMIT 3) "
        "UNION ALL SELECT * FROM (SELECT 4, g.pos, live.pos, 'group_aggregate', g.c || ',' || live.c, 'Medium', 'create_group_aggregate_features' "
        "FROM g JOIN live ON g.c <> live.c WHERE g.d BETWEEN 2 AND 30 AND g.d <= g.lim ORDER BY g.pos, live.pos LIMIT 3) "
        "UNION ALL SELECT * FROM (SELECT 5, pos, 0, 'binning', c, 'Low', 'create_binned_features' FROM live WHERE d > 20 ORDER BY pos LIMIT 2) "
        "UNION ALL SELECT 6, pos, 0, 'text_stats', c, 'Medium', 'create_text_stats_features' FROM t WHERE d > 10 AND len > 15 "
        "UNION ALL SELECT 7, pos, 0, 'frequency_encode', c, 'High', 'create_frequency_encoding' FROM t WHERE d > 15) "
        "SELECT row_number() OVER (ORDER BY ru, o1, o2) - 1 AS \"position\", type, cols AS \"columns\", priority, act AS action FROM a"
    )


@query("feature_advice_lineitem", feature_advice_sql())
def feature_advice_lineitem(spark, sf):
    out = recommend.features_advice(table(spark, sf, "lineitem"), "l_tax")
    return out.select(F.col("position").cast("long").alias("position"), "type", F.array_join("columns", ",").alias("columns"), "priority", "action")


@query(
    "feature_advice_documents",
    "SELECT 'text_stats' AS type, 'text' AS \"columns\", 'Medium' AS priority FROM documents HAVING count(DISTINCT text) > 10 AND avg(length(text)) > 15 "
    "UNION ALL SELECT 'frequency_encode', 'text', 'High' FROM documents HAVING count(DISTINCT text) > 15 "
    "UNION ALL SELECT 'frequency_encode', 'source', 'High' FROM documents HAVING count(DISTINCT source) > 15",
)
def feature_advice_documents(spark, sf):
    out = recommend.features_advice(table(spark, sf, "documents").select("text", "source"))
    return out.where("type in ('text_stats', 'frequency_encode')").select("type", F.array_join("columns", ",").alias("columns"), "priority")


@query(
    "generated_features",
    "SELECT doc_id, length(text) AS text_len, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) AS text_word_count, "
    f"{rnd('count(*) OVER (PARTITION BY text)::DOUBLE / count(*) OVER ()', 8)} AS text_freq FROM documents",
)
def generated_features(spark, sf):
    df, _ = recommend.generate_features(table(spark, sf, "documents").select("doc_id", "text"), target="doc_id")
    return rounded(df.select("doc_id", F.col("text_len").cast("long"), F.col("text_word_count").cast("long"), "text_freq"), 8)
