"""Chart data, metric and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsmith.operators import chart, evaluate
from gridsmith.plans import report

from .base import and_with, query, rnd, rounded, table, union, view, with_view

MD5 = "md5(concat_ws('|', {k}::VARCHAR, '42'))"


def hist_sql(source: str, x: str, n: int, color: str | None = None, where: str = "TRUE", density: bool = False) -> str:
    key = f"{color}, " if color else ""
    dens = f", {rnd('coalesce(n, 0) / (total * r.w)', 8)} AS density" if density else ""
    groups = f"g AS (SELECT {key}count(*) AS total FROM {source} WHERE {x} IS NOT NULL {'GROUP BY ' + color if color else ''})"
    on = f"g.{color} IS NOT DISTINCT FROM c.{color} AND " if color else ""
    out = f"g.{color}, " if color else ""
    return (
        f"r AS (SELECT min({x})::DOUBLE AS lo, (max({x}) - min({x}))::DOUBLE / {n} AS w FROM {source}), {groups}, "
        f"c AS (SELECT {key}least(floor(({x} - lo) / w), {n - 1})::INTEGER AS bin, count(*) AS n FROM {source}, r WHERE {x} IS NOT NULL GROUP BY ALL) "
        f"SELECT {out}b.bin AS bin, {rnd('r.lo + b.bin * r.w', 4)} AS \"left\", {rnd('r.lo + (b.bin + 1) * r.w', 4)} AS \"right\", coalesce(n, 0) AS \"count\"{dens} "
        f"FROM g, r, (SELECT unnest(range({n}))::INTEGER AS bin) b LEFT JOIN c ON {on}b.bin = c.bin"
    )


def hist_round(df):
    return rounded(df, 4, "left", "right")


@query("chart_histogram", "WITH " + hist_sql("orders", "o_totalprice", 35))
def chart_histogram(spark, sf):
    return hist_round(chart.histogram(table(spark, sf, "orders"), "o_totalprice"))


@query("chart_histogram_color", and_with("ev", hist_sql("ev", "value", 30, "event_type")))
def chart_histogram_color(spark, sf):
    return hist_round(chart.histogram(view(spark, sf, "ev"), "value", 30, color="event_type"))


@query("chart_density", "WITH " + hist_sql("customer", "c_acctbal", 35, density=True))
def chart_density(spark, sf):
    return rounded(hist_round(chart.density(table(spark, sf, "customer"), "c_acctbal")), 8, "density")


def box_sql(source: str, y: str, x: str) -> str:
    return (
        f"q AS (SELECT {x} AS k, quantile_cont({y}::DOUBLE, 0.25) AS q1, quantile_cont({y}::DOUBLE, 0.5) AS md, quantile_cont({y}::DOUBLE, 0.75) AS q3 "
        f"FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1), "
        f"f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"
    )


BOX_OUT = (
    "count(*) AS \"count\", round(max(q1), 4) AS q1, round(max(md), 4) AS median, round(max(q3), 4) AS q3, round(max(lo), 4) AS low_fence, "
    "round(max(hi), 4) AS high_fence, min(CASE WHEN y BETWEEN lo AND hi THEN y END) AS low_whisker, max(CASE WHEN y BETWEEN lo AND hi THEN y END) AS high_whisker, "
    "sum(CASE WHEN y BETWEEN lo AND hi THEN 0 ELSE 1 END)::BIGINT AS outliers"
)


@query(
    "chart_box",
    and_with("ev", box_sql("ev", "value", "event_type") + f" SELECT k AS event_type, {BOX_OUT} FROM (SELECT f.*, ev.value AS y FROM ev JOIN f ON ev.event_type = f.k WHERE value IS NOT NULL) GROUP BY k"),
)
def chart_box(spark, sf):
    return rounded(chart.box(view(spark, sf, "ev"), "value", "event_type"), 4, "q1", "median", "q3", "low_fence", "high_fence")


@query(
    "chart_box_whole",
    "WITH " + box_sql("customer", "c_acctbal", "'all'") + f" SELECT {BOX_OUT} FROM (SELECT f.*, c_acctbal AS y FROM customer, f)",
)
def chart_box_whole(spark, sf):
    return rounded(chart.box(table(spark, sf, "customer"), "c_acctbal"), 4, "q1", "median", "q3", "low_fence", "high_fence")


@query(
    "chart_box_points",
    "WITH " + box_sql("events", "value", "event_type") + " SELECT event_type, value FROM events JOIN f ON event_type = k WHERE value < lo OR value > hi",
)
def chart_box_points(spark, sf):
    return chart.box_outliers(table(spark, sf, "events"), "value", "event_type")


@query(
    "chart_violin",
    "WITH " + box_sql("orders", "o_totalprice", "o_orderstatus") + ", " + hist_sql("orders", "o_totalprice", 20, "o_orderstatus", density=True)
    .replace("SELECT g.o_orderstatus, ", "SELECT g.o_orderstatus, round(f.q1, 4) AS q1, round(f.md, 4) AS median, round(f.q3, 4) AS q3, ")
    + " JOIN f ON f.k = g.o_orderstatus",
)
def chart_violin(spark, sf):
    out = chart.violin(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", 20)
    return rounded(rounded(out, 4, "left", "right", "q1", "median", "q3"), 8, "density")


@query(
    "chart_bar_count",
    with_view("od", "SELECT o_orderpriority, count(*) AS \"count\" FROM od GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 25"),
)
def chart_bar_count(spark, sf):
    return chart.bar(view(spark, sf, "od"), "o_orderpriority")


@query("chart_bar_count_top", "SELECT p_name, count(*) AS \"count\" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def chart_bar_count_top(spark, sf):
    return chart.bar(table(spark, sf, "part"), "p_name", top_n=10)


@query("chart_bar_pairs", with_view("li", "SELECT l_returnflag, l_linestatus, count(*) AS \"count\" FROM li GROUP BY 1, 2"))
def chart_bar_pairs(spark, sf):
    return chart.bar(view(spark, sf, "li"), "l_returnflag", color="l_linestatus")


BAR = {"mean": "avg(o_totalprice)", "sum": "sum(o_totalprice)", "count": "count(o_totalprice)", "median": "quantile_cont(o_totalprice, 0.5)",
       "max": "max(o_totalprice)", "min": "min(o_totalprice)"}


def bar_sql(agg: str) -> str:
    value = BAR[agg] if agg == "count" else rnd(BAR[agg], 2)
    return with_view("od", f"SELECT o_orderpriority, {value} AS value FROM od GROUP BY 1 ORDER BY o_orderpriority NULLS LAST LIMIT 25")


def _bar(agg: str):
    def run(spark, sf):
        return rounded(chart.bar(view(spark, sf, "od"), "o_orderpriority", "o_totalprice", agg), 2)

    return run


for _agg in BAR:
    query(f"chart_bar_{_agg}_value", bar_sql(_agg))(_bar(_agg))


@query(
    "chart_bar_by_value",
    f"SELECT o_custkey, {rnd('sum(o_totalprice)', 2)} AS value FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10",
)
def chart_bar_by_value(spark, sf):
    return rounded(chart.bar(table(spark, sf, "orders"), "o_custkey", "o_totalprice", "sum", top_n=10, by_value=True), 2)


@query(
    "chart_bar_metric_pairs",
    f"SELECT l_returnflag, l_linestatus, {rnd('quantile_cont(l_quantity, 0.5)', 4)} AS value FROM lineitem GROUP BY 1, 2",
)
def chart_bar_metric_pairs(spark, sf):
    return rounded(chart.bar(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "median", color="l_linestatus"), 4)


@query(
    "chart_pie",
    f"SELECT *, {rnd('count::DOUBLE / sum(count) OVER ()', 8)} AS share FROM (SELECT p_brand, count(*) AS \"count\" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)",
)
def chart_pie(spark, sf):
    return rounded(chart.share(table(spark, sf, "part"), "p_brand", 12), 8)


@query(
    "chart_trend",
    f"SELECT l_returnflag, count(*) AS \"count\", {rnd('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, "
    f"{rnd('regr_intercept(l_extendedprice, l_quantity)', 2)} AS intercept, {rnd('regr_r2(l_extendedprice, l_quantity)', 6)} AS r2 FROM lineitem GROUP BY 1",
)
def chart_trend(spark, sf):
    out = chart.trend(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return rounded(rounded(rounded(out, 4, "slope"), 2, "intercept"), 6, "r2")


@query(
    "chart_scatter",
    with_view("ev", "SELECT event_id, user_id, value FROM ev WHERE value IS NOT NULL"),
)
def chart_scatter(spark, sf):
    return chart.points(view(spark, sf, "ev"), ["user_id", "value"], "event_id")


@query("chart_bubble", with_view("pa", "SELECT p_partkey, p_size, p_retailprice, p_brand FROM pa WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL"))
def chart_bubble(spark, sf):
    return chart.points(view(spark, sf, "pa"), ["p_size", "p_retailprice"], "p_partkey", extra=["p_brand"])


@query("chart_scatter_3d", with_view("pa", "SELECT p_partkey, p_size, p_retailprice, p_small FROM pa"))
def chart_scatter_3d(spark, sf):
    return chart.points(view(spark, sf, "pa"), ["p_size", "p_retailprice", "p_small"], "p_partkey", complete=False)


@query("chart_line", "SELECT l_orderkey, l_quantity, l_linestatus FROM lineitem ORDER BY l_orderkey")
def chart_line(spark, sf):
    return chart.series(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "l_linestatus")


@query(
    "chart_area_buckets",
    "WITH r AS (SELECT min(user_id)::DOUBLE AS lo, (max(user_id) - min(user_id))::DOUBLE / 20 AS w FROM events) "
    "SELECT event_type, least(floor((user_id - lo) / w), 19)::INTEGER AS bucket, min(user_id)::DOUBLE AS x_from, max(user_id)::DOUBLE AS x_to, "
    f"{rnd('avg(value)', 6)} AS y, count(*) AS \"count\" FROM events, r GROUP BY 1, 2",
)
def chart_area_buckets(spark, sf):
    return rounded(chart.series(table(spark, sf, "events"), "user_id", "value", "event_type", buckets=20), 6, "y")


@query(
    "chart_heatmap_pearson",
    f"SELECT 'p_size' AS a, 'p_retailprice' AS b, {rnd('corr(p_size, p_retailprice)', 6)} AS r FROM part UNION ALL "
    f"SELECT 'p_partkey', 'p_size', {rnd('corr(p_partkey, p_size)', 6)} FROM part UNION ALL "
    f"SELECT 'p_partkey', 'p_retailprice', {rnd('corr(p_partkey, p_retailprice)', 6)} FROM part",
)
def chart_heatmap_pearson(spark, sf):
    return rounded(chart.corr(table(spark, sf, "part"), method="pearson").drop("position"), 6)


def pivot_sql(agg: str) -> str:
    return "SELECT l_returnflag AS \"row\", " + ", ".join(
        f"coalesce({rnd(agg.format(f), 4)}, 0) AS \"{f}\"" for f in ("F", "O")
    ) + " FROM lineitem GROUP BY 1"


@query("chart_pivot_mean", pivot_sql("avg(CASE WHEN l_linestatus = '{}' THEN l_quantity END)"))
def chart_pivot_mean(spark, sf):
    return rounded(chart.pivot(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity"), 4)


@query("chart_pivot_median", pivot_sql("quantile_cont(CASE WHEN l_linestatus = '{}' THEN l_extendedprice END, 0.5)"))
def chart_pivot_median(spark, sf):
    return rounded(chart.pivot(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", "median"), 4)


@query(
    "chart_pivot_long",
    "SELECT c_mktsegment AS \"row\", c_custkey::VARCHAR AS \"column\", round(sum(c_acctbal), 4) AS value FROM customer GROUP BY 1, 2",
)
def chart_pivot_long(spark, sf):
    return rounded(chart.pivot(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", "c_acctbal", "sum", form="long"), 4)


@query(
    "chart_hierarchy",
    "SELECT l_returnflag, l_linestatus, l_linenumber, (3 - bit_count(grouping(l_returnflag, l_linestatus, l_linenumber)))::INTEGER AS level, "
    "count(*) AS value FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)",
)
def chart_hierarchy(spark, sf):
    return chart.hierarchy(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "chart_hierarchy_sum",
    f"SELECT l_returnflag, l_linestatus, (2 - bit_count(grouping(l_returnflag, l_linestatus)))::INTEGER AS level, {rnd('sum(l_quantity)', 2)} AS value "
    "FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def chart_hierarchy_sum(spark, sf):
    return rounded(chart.hierarchy(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity"), 2)


@query(
    "chart_strip",
    "SELECT event_id, event_type, value FROM events",
)
def chart_strip(spark, sf):
    return chart.strip(table(spark, sf, "events"), "value", "event_id", "event_type")


@query(
    "chart_ecdf",
    "SELECT DISTINCT event_type, value, count(*) OVER (PARTITION BY event_type, value) AS n, "
    f"{rnd('count(*) OVER (PARTITION BY event_type ORDER BY value)::DOUBLE / count(*) OVER (PARTITION BY event_type)', 8)} AS share FROM events",
)
def chart_ecdf(spark, sf):
    return rounded(chart.ecdf(table(spark, sf, "events"), "value", "event_type"), 8, "share")


@query(
    "chart_ecdf_whole",
    "SELECT DISTINCT l_quantity AS value, count(*) OVER (PARTITION BY l_quantity) AS n, "
    f"{rnd('count(*) OVER (ORDER BY l_quantity)::DOUBLE / count(*) OVER ()', 8)} AS share FROM lineitem",
)
def chart_ecdf_whole(spark, sf):
    return rounded(chart.ecdf(table(spark, sf, "lineitem"), "l_quantity"), 8, "share")


@query(
    "chart_parallel",
    with_view("ev", f"SELECT event_id, user_id, value FROM ev WHERE value IS NOT NULL ORDER BY {MD5.format(k='event_id')}, event_id LIMIT 2000"),
)
def chart_parallel(spark, sf):
    return chart.parallel_coordinates(view(spark, sf, "ev"), ["user_id", "value"], "event_id", 2_000)


@query(
    "chart_scatter_matrix",
    f"SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders ORDER BY {MD5.format(k='o_orderkey')}, o_orderkey LIMIT 1500",
)
def chart_scatter_matrix(spark, sf):
    return chart.scatter_matrix(table(spark, sf, "orders"), ["o_custkey", "o_totalprice"], "o_orderkey", 1_500, color="o_orderstatus")


@query(
    "chart_missing_matrix",
    and_with(
        "od",
        "f AS (SELECT * FROM od ORDER BY o_orderkey LIMIT 1000) SELECT o_orderkey AS _key, " + ", ".join(
            f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS {c}" for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
        ) + " FROM f",
    ),
)
def chart_missing_matrix(spark, sf):
    return chart.missing_matrix(view(spark, sf, "od"), "o_orderkey", 1_000)


@query(
    "chart_top_categories",
    with_view(
        "pa",
        "SELECT * FROM (" + union(
            [
                f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS \"count\", row_number() OVER (ORDER BY count(*) DESC, {c} NULLS LAST)::INTEGER AS rank, "
                f"{rnd('count(*) * 100.0 / (SELECT count(*) FROM pa)', 6)} AS percent FROM pa GROUP BY {c}"
                for c in ("p_name", "p_brand", "p_type")
            ]
        ) + ") WHERE rank <= 15",
    ),
)
def chart_top_categories(spark, sf):
    return rounded(chart.top_categories(view(spark, sf, "pa"), ["p_name", "p_brand", "p_type"]), 6)


@query(
    "chart_missing_bar",
    with_view("li", union([
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, {rnd(f'(count(*) - count({c})) * 100.0 / count(*)', 6)} AS missing_pct FROM li"
        for c in ("l_linenumber", "l_discount", "l_returnflag")
    ])),
)
def chart_missing_bar(spark, sf):
    return rounded(chart.missing_bar(view(spark, sf, "li")), 6)


@query(
    "chart_cardinality_bar",
    union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")]),
)
def chart_cardinality_bar(spark, sf):
    return chart.cardinality_bar(table(spark, sf, "events"))


@query(
    "chart_class_balance",
    with_view("od", f"SELECT o_orderstatus AS class, count(*) AS \"count\", {rnd('count(*) * 100.0 / sum(count(*)) OVER ()', 6)} AS percent FROM od GROUP BY 1"),
)
def chart_class_balance(spark, sf):
    return rounded(chart.class_balance(view(spark, sf, "od"), "o_orderstatus"), 6)


@query(
    "chart_feature_by_class_box",
    "WITH " + box_sql("orders", "o_totalprice", "o_orderstatus")
    + f" SELECT k AS o_orderstatus, {BOX_OUT} FROM (SELECT f.*, o_totalprice AS y FROM orders JOIN f ON o_orderstatus = f.k) GROUP BY k",
)
def chart_feature_by_class_box(spark, sf):
    out = chart.feature_by_class(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")[0]
    return rounded(out, 4, "q1", "median", "q3", "low_fence", "high_fence")


@query("chart_feature_by_class_histogram", "WITH " + hist_sql("orders", "o_totalprice", 35, "o_orderstatus"))
def chart_feature_by_class_histogram(spark, sf):
    return hist_round(chart.feature_by_class(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus")[1])


@query(
    "chart_outlier_overview",
    "WITH m AS (" + union([f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value FROM part" for c in ("p_partkey", "p_size", "p_retailprice")]) + "), "
    + box_sql("m", "value", "\"column\"") + f" SELECT k AS \"column\", {BOX_OUT} FROM (SELECT f.*, m.value AS y FROM m JOIN f ON m.\"column\" = f.k) GROUP BY k",
)
def chart_outlier_overview(spark, sf):
    out = chart.outlier_overview(table(spark, sf, "part"))
    return rounded(out, 4, "q1", "median", "q3", "low_fence", "high_fence")


# ---------------------------------------------------------------- metrics on a labelled rule

GUESS = "SELECT doc_id, quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS guess, n_chars FROM labels JOIN documents USING (doc_id)"


def guesses(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return joined.select("doc_id", "quality", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("guess"), "n_chars")


PRICE = "SELECT l_orderkey, l_partkey, l_extendedprice AS y, l_quantity * 2000.0 AS yhat FROM lineitem"


def prices(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_extendedprice AS y", "l_quantity * 2000.0D AS yhat")


@query(
    "metric_confusion",
    f"WITH g AS ({GUESS}), c AS (SELECT quality::VARCHAR AS label, guess::VARCHAR AS prediction, count(*) AS n FROM g GROUP BY 1, 2) "
    "SELECT a.v AS label, b.v AS prediction, coalesce(n, 0) AS n FROM (VALUES ('0'), ('1')) a(v) CROSS JOIN (VALUES ('0'), ('1')) b(v) "
    "LEFT JOIN c ON c.label = a.v AND c.prediction = b.v",
)
def metric_confusion(spark, sf):
    return evaluate.confusion(guesses(spark, sf), "quality", "guess")


@query(
    "metric_classification",
    f"WITH g AS ({GUESS}), k AS (SELECT unnest([0, 1]) AS k), "
    "s AS (SELECT k, count(*) FILTER (quality = k)::DOUBLE AS sup, count(*) FILTER (guess = k)::DOUBLE AS pr, count(*) FILTER (quality = k AND guess = k)::DOUBLE AS tp FROM g, k GROUP BY k), "
    "m AS (SELECT sup, tp, coalesce(tp / nullif(pr, 0), 0) AS p, coalesce(tp / nullif(sup, 0), 0) AS r FROM s) "
    f"SELECT {rnd('sum(tp) / sum(sup)', 8)} AS accuracy, {rnd('sum(sup * coalesce(2 * p * r / nullif(p + r, 0), 0)) / sum(sup)', 8)} AS f1, "
    f"{rnd('sum(sup * p) / sum(sup)', 8)} AS \"precision\", {rnd('sum(sup * r) / sum(sup)', 8)} AS recall FROM m",
)
def metric_classification(spark, sf):
    return rounded(evaluate.classification(guesses(spark, sf), "quality", "guess"), 8)


@query(
    "metric_regression",
    f"WITH p AS ({PRICE}) SELECT {rnd('1 - avg((y - yhat) * (y - yhat)) / var_pop(y)', 6)} AS r2, {rnd('avg(abs(y - yhat))', 4)} AS mae, "
    f"{rnd('avg((y - yhat) * (y - yhat))', 1)} AS mse, {rnd('sqrt(avg((y - yhat) * (y - yhat)))', 4)} AS rmse FROM p",
)
def metric_regression(spark, sf):
    out = evaluate.regression(prices(spark, sf), "y", "yhat")
    return rounded(rounded(rounded(out, 6, "r2"), 4, "mae", "rmse"), 1, "mse")


ROC = (
    f"WITH g AS ({GUESS}), c AS (SELECT n_chars::DOUBLE AS threshold, sum(quality)::BIGINT AS pos, sum(1 - quality)::BIGINT AS neg FROM g GROUP BY 1), "
    "t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM c), "
    "r AS (SELECT threshold, pos, neg, sum(neg) OVER (ORDER BY threshold DESC)::DOUBLE / n AS fpr, sum(pos) OVER (ORDER BY threshold DESC)::DOUBLE / p AS tpr FROM c, t)"
)


@query("metric_roc", ROC + f" SELECT threshold, pos, neg, {rnd('fpr', 8)} AS fpr, {rnd('tpr', 8)} AS tpr FROM r")
def metric_roc(spark, sf):
    return rounded(evaluate.roc(guesses(spark, sf), "quality", "n_chars"), 8, "fpr", "tpr")


@query(
    "metric_auc",
    ROC + ", s AS (SELECT fpr, tpr, lag(fpr, 1, 0.0) OVER (ORDER BY threshold DESC) AS f0, lag(tpr, 1, 0.0) OVER (ORDER BY threshold DESC) AS t0 FROM r) "
    f"SELECT {rnd('sum((fpr - f0) * (tpr + t0) / 2)', 8)} AS auc FROM s",
)
def metric_auc(spark, sf):
    return rounded(evaluate.auc(guesses(spark, sf), "quality", "n_chars"), 8)


@query("metric_residuals", f"SELECT l_orderkey, l_partkey, y AS actual, yhat AS predicted, {rnd('y - yhat', 4)} AS residual FROM ({PRICE})")
def metric_residuals(spark, sf):
    return rounded(evaluate.residuals(prices(spark, sf), "y", "yhat", ["l_orderkey", "l_partkey"]), 4, "residual")


# ---------------------------------------------------------------- report


@query(
    "report_metrics",
    with_view(
        "od",
        "SELECT 'dataset' AS section, \"position\", metric, value FROM (VALUES "
        "(0, 'rows', (SELECT count(*)::VARCHAR FROM od)), (1, 'columns', '5'), (2, 'active_features', '2'), "
        "(3, 'missing_cells', (SELECT (2 * count(*) - count(o_orderstatus) - count(o_orderpriority))::VARCHAR FROM od)), (4, 'duplicate_rows', '0')) v(\"position\", metric, value) "
        "UNION ALL SELECT 'actions', 0, 'step_1', 'dropped o_orderdate'",
    ),
)
def report_metrics(spark, sf):
    out = report.metrics(view(spark, sf, "od").drop("o_orderdate"), ["o_totalprice", "o_orderstatus", "gone"], ["dropped o_orderdate"])
    return out.where("metric <> 'size_mb'")
