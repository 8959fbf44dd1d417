"""Source, projection, cleaning, encoding, scaling and feature queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridsmith.operators import clean, encode, features, scale, select
from gridsmith.plans.recipe import Recipe, Step
from gridsmith.session import checkpoint_dir
from gridsmith.sources import tables

from .base import and_with, query, rnd, rounded, table, union, view, with_view


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/gridsmith/{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources


@query("csv_round_trip", with_view("od", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM od"))
def csv_round_trip(spark, sf):
    df = view(spark, sf, "od").drop("o_orderdate")
    path = scratch(spark)
    tables.write_csv(df, path)
    return tables.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")


@query("csv_inferred", with_view("li", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_discount, l_returnflag FROM li"))
def csv_inferred(spark, sf):
    path = scratch(spark)
    tables.write_csv(view(spark, sf, "li").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"), path)
    return tables.read_csv(spark, path)


@query("parquet_round_trip", "SELECT event_id, user_id, event_type, value, props FROM events")
def parquet_round_trip(spark, sf):
    path = scratch(spark)
    tables.write_parquet(table(spark, sf, "events").drop("ts"), path, partition_by=["event_type"])
    return tables.read_parquet(spark, path)


@query(
    "missing_normalized",
    "SELECT p_partkey, CASE WHEN p_size = 25 THEN NULL WHEN p_size = 10 THEN NULL ELSE p_retailprice END AS price FROM part",
)
def missing_normalized(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "p_partkey",
        "CASE WHEN p_size = 25 THEN double('NaN') WHEN p_size = 10 THEN double('Infinity') ELSE p_retailprice END AS price",
    )
    return tables.normalize_missing(df)


@query("preview", "SELECT * EXCLUDE (o_orderdate) FROM orders ORDER BY o_orderkey LIMIT 20")
def preview(spark, sf):
    return tables.preview(table(spark, sf, "orders").drop("o_orderdate"), "o_orderkey", 20)


# ---------------------------------------------------------------- projection, filter, cast


@query("drop_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop_columns(spark, sf):
    return clean.drop_columns(table(spark, sf, "customer"), ["c_name", "c_mktsegment", "no_such_column"])


@query("active_features", "SELECT p_size, p_brand FROM part")
def active_features(spark, sf):
    return clean.select_active(table(spark, sf, "part"), ["p_size", "gone", "p_brand"])


@query("range_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000")
def range_filter(spark, sf):
    return clean.between(table(spark, sf, "orders"), "o_totalprice", 100_000, 200_000).select("o_orderkey", "o_totalprice")


@query("category_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def category_filter(spark, sf):
    return clean.member(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query(
    "category_filter_default",
    "SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source LIMIT 10)",
)
def category_filter_default(spark, sf):
    df = table(spark, sf, "documents")
    return clean.member(df, "source", clean.first_values(df, "source")).select("doc_id", "source")


@query("drop_missing_rows", with_view("li", "SELECT l_orderkey, l_linenumber, l_discount FROM li WHERE l_linenumber IS NOT NULL AND l_discount IS NOT NULL"))
def drop_missing_rows(spark, sf):
    return clean.drop_missing(view(spark, sf, "li"), ["l_linenumber", "l_discount"]).select("l_orderkey", "l_linenumber", "l_discount")


PARTS = "SELECT p_partkey, CASE WHEN p_size > 30 THEN p_brand ELSE p_size::VARCHAR END AS txt FROM part"


def part_text(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_size > 30 THEN p_brand ELSE string(p_size) END AS txt")


@query("cast_numeric", f"SELECT p_partkey, TRY_CAST(txt AS DOUBLE) AS txt FROM ({PARTS})")
def cast_numeric(spark, sf):
    return clean.cast_column(part_text(spark, sf), "txt", "numeric")


@query(
    "cast_datetime",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS d FROM orders",
)
def cast_datetime(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE o_orderstatus WHEN 'P' THEN 'not a date' WHEN 'F' THEN date_format(o_orderdate, 'yyyy/MM/dd') "
        "ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END AS d",
    )
    return clean.cast_column(df, "d", "datetime").select("o_orderkey", F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("d"))


@query("cast_category", "SELECT c_custkey, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def cast_category(spark, sf):
    return clean.cast_column(table(spark, sf, "customer"), "c_nationkey", "category").select("c_custkey", "c_nationkey")


@query("cast_string", with_view("pa", "SELECT p_partkey, p_size::VARCHAR AS p_size FROM pa"))
def cast_string(spark, sf):
    return clean.cast_column(view(spark, sf, "pa"), "p_size", "string").select("p_partkey", "p_size")


@query(
    "cast_loss",
    f"SELECT 'txt' AS \"column\", count(txt) - count(TRY_CAST(txt AS DOUBLE)) AS lost FROM ({PARTS}) "
    f"UNION ALL SELECT 'p_partkey', 0::BIGINT FROM ({PARTS}) HAVING count(*) > 0",
)
def cast_loss(spark, sf):
    return clean.cast_loss(part_text(spark, sf), {"txt": "numeric", "p_partkey": "string"}).drop("position")


# ---------------------------------------------------------------- imputing and cleaning


@query(
    "impute_median",
    with_view("ev", "SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ev)) AS value FROM ev"),
)
def impute_median(spark, sf):
    df = view(spark, sf, "ev").select("event_id", "value")
    return clean.Imputer("median", ["value"]).fit(df).transform(df)


@query(
    "impute_mean",
    with_view("ev", f"SELECT event_id, {rnd('coalesce(value, (SELECT avg(value) FROM ev))', 6)} AS value FROM ev"),
)
def impute_mean(spark, sf):
    df = view(spark, sf, "ev").select("event_id", "value")
    return rounded(clean.Imputer("mean", ["value"]).fit(df).transform(df), 6)


def mode_sql(name: str, c: str) -> str:
    return f"(SELECT {c} FROM {name} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "impute_mode",
    with_view(
        "pa",
        f"SELECT p_partkey, coalesce(p_brand, {mode_sql('pa', 'p_brand')}) AS p_brand, coalesce(p_size, {mode_sql('pa', 'p_size')}) AS p_size FROM pa",
    ),
)
def impute_mode(spark, sf):
    df = view(spark, sf, "pa").select("p_partkey", "p_brand", "p_size")
    return clean.Imputer("mode", ["p_brand", "p_size"]).fit(df).transform(df)


@query("impute_constant", with_view("pa", "SELECT p_partkey, coalesce(p_brand, 'Missing') AS p_brand FROM pa"))
def impute_constant(spark, sf):
    df = view(spark, sf, "pa").select("p_partkey", "p_brand")
    return clean.Imputer("constant", ["p_brand"]).fit(df).transform(df)


@query("impute_constant_number", with_view("pa", "SELECT p_partkey, coalesce(p_size, 0) AS p_size FROM pa"))
def impute_constant_number(spark, sf):
    df = view(spark, sf, "pa").select("p_partkey", "p_size")
    return clean.Imputer("constant", ["p_size"], "0").fit(df).transform(df)


@query("impute_drop_rows", with_view("pa", "SELECT p_partkey, p_size FROM pa WHERE p_size IS NOT NULL"))
def impute_drop_rows(spark, sf):
    df = view(spark, sf, "pa").select("p_partkey", "p_size")
    return clean.Imputer("drop_rows", ["p_size"]).fit(df).transform(df)


AUTO = (
    f"SELECT o_orderkey, coalesce(o_orderstatus, {mode_sql('od', 'o_orderstatus')}) AS o_orderstatus, "
    f"coalesce(o_orderpriority, {mode_sql('od', 'o_orderpriority')}) AS o_orderpriority, "
    "coalesce(o_totalprice, 0) AS o_totalprice FROM od"
)


@query("impute_auto", with_view("od", AUTO))
def impute_auto(spark, sf):
    df = view(spark, sf, "od").drop("o_orderdate", "o_custkey")
    return clean.Imputer("auto").fit(df).transform(df)


@query("remove_duplicates", "SELECT DISTINCT user_id, event_type FROM events")
def remove_duplicates(spark, sf):
    return clean.remove_duplicates(table(spark, sf, "events").select("user_id", "event_type"))


@query("remove_duplicate_texts", "SELECT DISTINCT text, lang FROM documents")
def remove_duplicate_texts(spark, sf):
    return clean.remove_duplicates(table(spark, sf, "documents").select("text", "lang"))


@query("drop_constant_columns", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def drop_constant_columns(spark, sf):
    df = table(spark, sf, "part").withColumns({"one": F.lit(1), "none": F.lit(None).cast("string")})
    return clean.drop_constant_columns(df)[0]


CAP_IQR = (
    "SELECT event_id, CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) "
    "WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE value END AS value "
    "FROM ev, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ev) q"
)


@query("cap_outliers_iqr", with_view("ev", CAP_IQR))
def cap_outliers_iqr(spark, sf):
    df = view(spark, sf, "ev").select("event_id", "value")
    return clean.OutlierCap(["value"]).fit(df).transform(df)


@query(
    "cap_outliers_zscore",
    with_view(
        "ev",
        f"SELECT event_id, {rnd('CASE WHEN value < m - 3 * s THEN m - 3 * s WHEN value > m + 3 * s THEN m + 3 * s ELSE value END', 6)} AS value "
        "FROM ev, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM ev) q",
    ),
)
def cap_outliers_zscore(spark, sf):
    df = view(spark, sf, "ev").select("event_id", "value")
    return rounded(clean.OutlierCap(["value"], "zscore").fit(df).transform(df), 6)


@query(
    "outlier_report",
    with_view(
        "ev",
        union(
            [
                f"SELECT '{c}' AS \"column\", n AS changed, CASE WHEN n > 0 THEN 'applied' ELSE 'skipped' END AS status FROM (SELECT "
                f"sum(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END)::BIGINT AS n "
                f"FROM ev, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM ev) q)"
                for c in ("user_id", "value")
            ]
        ),
    ),
)
def outlier_report(spark, sf):
    df = view(spark, sf, "ev")
    return clean.OutlierCap(["user_id", "value"]).fit(df).changed(df, ["user_id", "value"]).drop("position")


@query("log1p_in_place", f"SELECT c_custkey, {rnd('ln(1 + greatest(c_acctbal, 0))', 8)} AS c_acctbal FROM customer")
def log1p_in_place(spark, sf):
    return rounded(clean.apply_log1p(table(spark, sf, "customer"), "c_acctbal").select("c_custkey", "c_acctbal"), 8)


@query(
    "auto_clean",
    and_with(
        "ev",
        "f AS (SELECT user_id, coalesce(event_type, "
        + mode_sql("ev", "event_type")
        + ") AS event_type FROM ev) SELECT DISTINCT user_id, event_type FROM f",
    ),
)
def auto_clean(spark, sf):
    return clean.auto_clean(view(spark, sf, "ev").select("user_id", "event_type", F.lit("k").alias("fixed")))


# ---------------------------------------------------------------- encoding and scaling


@query(
    "encode_onehot",
    with_view(
        "od",
        "SELECT o_orderkey, " + ", ".join(
            f"CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS \"o_orderpriority_{p}\"" for p in ("2-HIGH", "3-MEDIUM", "5-LOW")
        ) + " FROM od",
    ),
)
def encode_onehot(spark, sf):
    df = view(spark, sf, "od").select("o_orderkey", "o_orderpriority")
    return encode.onehot(df, ["o_orderkey", "o_orderpriority"]).transform(df)


@query(
    "encode_label",
    with_view(
        "li",
        "SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE -1 END AS l_returnflag, "
        "CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS l_linestatus FROM li",
    ),
)
def encode_label(spark, sf):
    df = view(spark, sf, "li").select("l_orderkey", "l_returnflag", "l_linestatus")
    return encode.label(df, ["l_returnflag", "l_linestatus"]).transform(df)


@query("encode_label_many", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer")
def encode_label_many(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    return encode.label(df, ["c_name"]).transform(df).withColumn("c_name", F.col("c_name").cast("long"))


@query(
    "encode_frequency",
    with_view(
        "od",
        f"SELECT o_orderkey, {rnd('coalesce(count(o_orderpriority) OVER (PARTITION BY o_orderpriority)::DOUBLE / count(o_orderpriority) OVER (), 0)', 8)} AS o_orderpriority FROM od",
    ),
)
def encode_frequency(spark, sf):
    df = view(spark, sf, "od").select("o_orderkey", "o_orderpriority")
    return rounded(encode.frequency(df, ["o_orderpriority"]).transform(df), 8)


@query(
    "encodable_columns",
    "SELECT c AS \"column\" FROM (" + union(
        [f"SELECT '{c}' AS c, count(DISTINCT {c}) AS d FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")]
    ) + ") WHERE d <= 50",
)
def encodable_columns(spark, sf):
    return spark.createDataFrame([(c,) for c in encode.encodable(table(spark, sf, "part"))], "column string")


SCALED = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
}


def scale_sql(method: str) -> str:
    a, w = (e.format(c="o_totalprice") for e in SCALED[method])
    return (
        f"SELECT o_orderkey, {rnd('(o_totalprice - a) / w', 6)} AS o_totalprice FROM orders, (SELECT {a} AS a, {w} AS w FROM orders) s"
    )


def _scaled(method: str):
    def run(spark, sf):
        df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
        return rounded(scale.fit(df, ["o_totalprice"], method).transform(df), 6)

    return run


for _method in SCALED:
    query(f"scale_{_method}", scale_sql(_method))(_scaled(_method))


# ---------------------------------------------------------------- features

PARTS_SQL = {
    "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "dayofweek": "isodow(ts) - 1",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END", "quarter": "quarter(ts)", "hour": "hour(ts)",
}


@query("datetime_parts", "SELECT event_id, " + ", ".join(f"({e})::BIGINT AS ts_{p}" for p, e in PARTS_SQL.items()) + " FROM events")
def datetime_parts(spark, sf):
    df = features.datetime_features(table(spark, sf, "events").select("event_id", "ts"), "ts", list(PARTS_SQL)).drop("ts")
    return df.select("event_id", *[F.col(f"ts_{p}").cast("long").alias(f"ts_{p}") for p in PARTS_SQL])


@query(
    "datetime_parts_text",
    "SELECT o_orderkey, year(o_orderdate)::BIGINT AS d_year, month(o_orderdate)::BIGINT AS d_month FROM orders",
)
def datetime_parts_text(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    out = features.datetime_features(df, "d", ["year", "month"])
    return out.select("o_orderkey", F.col("d_year").cast("long").alias("d_year"), F.col("d_month").cast("long").alias("d_month"))


@query(
    "interactions",
    f"SELECT l_orderkey, l_partkey, {rnd('l_quantity * l_discount', 6)} AS l_quantity_x_l_discount, "
    f"{rnd('l_quantity / nullif(l_discount, 0)', 4)} AS l_quantity_div_l_discount, "
    f"{rnd('l_quantity + l_discount', 6)} AS l_quantity_plus_l_discount, {rnd('l_quantity - l_discount', 6)} AS l_quantity_minus_l_discount, "
    f"{rnd('l_quantity / (l_discount + 1e-5)', 3)} AS l_quantity_d_l_discount FROM lineitem",
)
def interactions(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    for op in ("multiply", "divide", "add", "subtract"):
        df = features.interaction(df, "l_quantity", "l_discount", op)
    df = features.named_interaction(df, "l_quantity", "l_discount", "divide").drop("l_quantity", "l_discount")
    df = rounded(df, 6, "l_quantity_x_l_discount", "l_quantity_plus_l_discount", "l_quantity_minus_l_discount")
    return rounded(rounded(df, 4, "l_quantity_div_l_discount"), 3, "l_quantity_d_l_discount")


@query(
    "bins_quantile",
    "SELECT l_orderkey, l_quantity, (CASE WHEN l_quantity <= a THEN 0 WHEN l_quantity <= b THEN 1 WHEN l_quantity <= c THEN 2 ELSE 3 END)::BIGINT AS l_quantity_binned "
    "FROM lineitem, (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem) q",
)
def bins_quantile(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    out = features.bins(df, "l_quantity", 4).transform(df)
    return out.withColumn("l_quantity_binned", F.col("l_quantity_binned").cast("long"))


@query(
    "bins_uniform",
    "SELECT o_orderkey, (CASE WHEN o_totalprice <= lo + w THEN 0 WHEN o_totalprice <= lo + 2 * w THEN 1 WHEN o_totalprice <= lo + 3 * w THEN 2 "
    "WHEN o_totalprice <= lo + 4 * w THEN 3 ELSE 4 END)::BIGINT AS price_bin "
    "FROM orders, (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 5 AS w FROM orders) q",
)
def bins_uniform(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = features.bins(df, "o_totalprice", 5, "uniform", output="price_bin").transform(df)
    return out.select("o_orderkey", F.col("price_bin").cast("long").alias("price_bin"))


@query(
    "bin_labels",
    "WITH q AS (SELECT min(p_retailprice) AS e0, quantile_cont(p_retailprice, 0.5) AS e1, max(p_retailprice) AS e2 FROM part) "
    "SELECT p_partkey, CASE WHEN p_retailprice <= e1 THEN 'low' ELSE 'high' END AS half FROM part, q",
)
def bin_labels(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    model = features.bins(df, "p_retailprice", 2, labels=True, output="half")
    first = f"({model.edges[0]:.6g}, {model.edges[1]:.6g}]"
    out = model.transform(df)
    return out.select("p_partkey", F.when(F.col("half") == first, "low").otherwise("high").alias("half"))


@query(
    "log_shifted",
    f"SELECT c_custkey, {rnd('ln(1 + c_acctbal - m)', 8)} AS c_acctbal_log1p, {rnd('sqrt(c_acctbal - m)', 8)} AS c_acctbal_sqrt "
    "FROM customer, (SELECT least(min(c_acctbal), 0) AS m FROM customer) q",
)
def log_shifted(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = features.log_transform(df, "c_acctbal", "log1p").transform(df)
    out = features.log_transform(df, "c_acctbal", "sqrt").transform(out)
    return rounded(out.drop("c_acctbal"), 8)


@query(
    "column_transforms",
    f"SELECT c_custkey, {rnd('ln(1 + greatest(c_acctbal, 0))', 8)} AS lg, {rnd('sqrt(greatest(c_acctbal, 0))', 8)} AS sq, "
    f"{rnd('c_acctbal * c_acctbal', 3)} AS pw, {rnd('1.0 / (c_acctbal + 1e-5)', 8)} AS rc, {rnd('(c_acctbal - m) / s', 8)} AS zs "
    "FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) q",
)
def column_transforms(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    for kind, name in (("log1p", "lg"), ("sqrt", "sq"), ("square", "pw"), ("reciprocal", "rc"), ("zscore", "zs")):
        df = features.transform_column(df, "c_acctbal", kind, name)
    return rounded(rounded(df.drop("c_acctbal"), 8, "lg", "sq", "rc", "zs"), 3, "pw")


@query(
    "group_aggregates",
    with_view(
        "ev",
        "SELECT event_id, " + ", ".join(
            f"{rnd(f'CASE WHEN event_type IS NULL THEN NULL ELSE {e} OVER (PARTITION BY event_type) END', 6)} AS value_by_event_type_{n}"
            for n, e in (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("median", "quantile_cont(value, 0.5)"), ("max", "max(value)"))
        ) + " FROM ev",
    ),
)
def group_aggregates(spark, sf):
    df = view(spark, sf, "ev").select("event_id", "event_type", "value")
    out = features.group_features(df, "event_type", "value", ["mean", "std", "median", "max"]).transform(df)
    return rounded(out.drop("event_type", "value"), 6)


WORD = "'[^ \\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, {WORD}))"


@query("text_stats", f"SELECT doc_id, length(text) AS text_len, {words("text")}::BIGINT AS text_word_count FROM documents")
def text_stats(spark, sf):
    out = features.text_stats(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.col("text_len").cast("long").alias("text_len"), F.col("text_word_count").cast("long").alias("text_word_count"))


@query("text_stats_pages", f"SELECT page_id, length(html) AS html_len, {words("html")}::BIGINT AS html_word_count FROM pages")
def text_stats_pages(spark, sf):
    out = features.text_stats(table(spark, sf, "pages").select("page_id", "html"), "html")
    return out.select("page_id", F.col("html_len").cast("long").alias("html_len"), F.col("html_word_count").cast("long").alias("html_word_count"))


@query(
    "frequency_feature",
    f"SELECT conv_id, turn, role, {rnd('count(*) OVER (PARTITION BY role)::DOUBLE / count(*) OVER ()', 8)} AS role_freq FROM conversations",
)
def frequency_feature(spark, sf):
    df = table(spark, sf, "conversations").drop("text")
    return rounded(encode.frequency_feature(df, "role").transform(df), 8)


# ---------------------------------------------------------------- selection and recipe


@query("drop_collinear", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def drop_collinear(spark, sf):
    df = table(spark, sf, "orders").drop("o_orderdate")
    df = df.withColumns({"o_twice": F.col("o_totalprice") * 2.0, "o_minus": -F.col("o_custkey")})
    return select.drop_collinear(df)


@query("drop_zero_variance", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def drop_zero_variance(spark, sf):
    return select.drop_constant(table(spark, sf, "supplier").withColumn("zero", F.lit(0)))


def cleaning_recipe() -> Recipe:
    return (
        Recipe()
        .add(Step("fill value with its median", clean.Imputer("median", ["value"]).fit))
        .add(Step("cap value at the fences", clean.OutlierCap(["value"]).fit))
        .add(Step("codes of event_type", lambda df: encode.label(df, ["event_type"])))
        .add(Step.plain("drop user_id", lambda df: clean.drop_columns(df, ["user_id"])))
    )


@query(
    "recipe_replay",
    and_with(
        "ev",
        "f AS (SELECT event_id, event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ev)) AS v FROM ev), "
        "q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM f) "
        "SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END AS event_type, "
        "CASE WHEN v < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) WHEN v > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE v END AS value FROM f, q",
    ),
)
def recipe_replay(spark, sf):
    return cleaning_recipe().apply(view(spark, sf, "ev").drop("ts"))


@query(
    "recipe_step_back",
    with_view("ev", "SELECT event_id, user_id, event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM ev)) AS value FROM ev"),
)
def recipe_step_back(spark, sf):
    return cleaning_recipe().back(3).apply(view(spark, sf, "ev").drop("ts"))
