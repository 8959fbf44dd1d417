"""Split, balance, preparation, model, feature-search and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsmith.operators import autofe, balance, chart, evaluate, mlprep, neighbors, score, select, split, train
from gridsmith.plans import experiments

from .base import and_with, query, rnd, rounded, table, union, view, with_view
from .charts import MD5
from .cleaning import scratch

H = MD5.format(k="o_orderkey")


def labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return table(spark, sf, "labels").select("doc_id", "quality").join(docs, "doc_id")


def parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


# ---------------------------------------------------------------- schema and splits


@query(
    "screened_features",
    "SELECT c AS \"column\" FROM (SELECT 'text' AS c, count(DISTINCT text) AS d, count(*) AS n FROM documents "
    "UNION ALL SELECT 'lang', count(DISTINCT lang), count(*) FROM documents UNION ALL SELECT 'source', count(DISTINCT source), count(*) FROM documents) "
    "WHERE d <= 0.8 * n",
)
def screened_features(spark, sf):
    names = mlprep.screen_features(table(spark, sf, "documents"), "n_chars")
    return spark.createDataFrame([(n,) for n in names], "column string")


@query(
    "aligned_rows",
    "SELECT p_partkey, TRY_CAST(CASE WHEN p_size > 30 THEN p_brand ELSE p_size::VARCHAR END AS DOUBLE) AS p_size, '00' || p_partkey AS code FROM part",
)
def aligned_rows(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size > 30 THEN p_brand ELSE string(p_size) END AS p_size", "concat('00', p_partkey) AS code"
    )
    return mlprep.align(df, ["p_size"], ["code"])


@query("drop_missing_target", with_view("od", "SELECT o_orderkey, o_orderstatus FROM od WHERE o_orderstatus IS NOT NULL"))
def drop_missing_target(spark, sf):
    return split.drop_missing_target(view(spark, sf, "od"), "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query(
    "split_plain",
    f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {H}, o_orderkey) <= ceil((SELECT count(*) FROM orders) * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders",
)
def split_plain(spark, sf):
    return split.assign(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


QUOTA = (
    "q0 AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT ceil(sum(n) * 0.2) AS want, sum(n) AS total FROM q0), "
    "q1 AS (SELECT o_orderstatus, n, floor(n * want / total) AS whole, n * want / total - floor(n * want / total) AS part, want FROM q0, t), "
    "q AS (SELECT o_orderstatus, n, whole + CASE WHEN row_number() OVER (ORDER BY part DESC, o_orderstatus) <= want - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM q1)"
)


@query(
    "split_stratified",
    f"WITH {QUOTA}, r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H}, o_orderkey) AS rn FROM orders) "
    "SELECT o_orderkey, r.o_orderstatus, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q ON r.o_orderstatus = q.o_orderstatus",
)
def split_stratified(spark, sf):
    return split.assign(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", stratify="o_orderstatus")


@query("folds_plain", f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {H}, o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders")
def folds_plain(spark, sf):
    return split.folds(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5)


@query(
    "folds_stratified",
    f"SELECT o_orderkey, o_orderstatus, ((row_number() OVER (ORDER BY o_orderstatus, {H}, o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders",
)
def folds_stratified(spark, sf):
    return split.folds(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, stratify="o_orderstatus")


@query(
    "evaluation_sample",
    with_view("od", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM od WHERE o_orderstatus IS NOT NULL ORDER BY {H}, o_orderkey LIMIT 10000"),
)
def evaluation_sample(spark, sf):
    df = view(spark, sf, "od").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return split.evaluation_sample(df, "o_orderstatus", "o_orderkey")


# ---------------------------------------------------------------- balancing

HQ = MD5.format(k="doc_id")
RANKED = f"r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {HQ}, doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)"


@query(
    "balance_oversample",
    f"WITH {RANKED}, m AS (SELECT max(n) AS most FROM r) SELECT doc_id, quality, unnest(range(1, 1 + (most // n) + CASE WHEN rn <= most % n THEN 1 ELSE 0 END))::BIGINT AS copy FROM r, m",
)
def balance_oversample(spark, sf):
    return balance.oversample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("balance_undersample", f"WITH {RANKED} SELECT doc_id, quality FROM r WHERE rn <= (SELECT min(n) FROM r)")
def balance_undersample(spark, sf):
    return balance.undersample(table(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(
    "balance_smote_counts",
    "SELECT quality, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n, "
    "(SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) - count(*) AS made FROM labels GROUP BY quality",
)
def balance_smote_counts(spark, sf):
    df = labelled(spark, sf)
    rows = mlprep.build(df, ["n_chars", "lang"]).transform(df)
    done = balance.smote(rows, "quality", "doc_id")
    return done.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("synthetic").cast("long")).alias("made"))


@query(
    "balance_report",
    "SELECT quality, count(*) AS n, max(count(*)) OVER () AS n_after FROM labels GROUP BY quality",
)
def balance_report(spark, sf):
    return balance.report_frame(table(spark, sf, "labels"), "quality", "oversample")


# ---------------------------------------------------------------- preparation

SCALE = "(coalesce(p_size, md) - m) / s"


@query(
    "prep_numeric",
    and_with(
        "pa",
        "f AS (SELECT quantile_cont(p_size, 0.5) AS md FROM pa), g AS (SELECT avg(coalesce(p_size, md)) AS m, stddev_pop(coalesce(p_size, md)) AS s FROM pa, f) "
        f"SELECT p_partkey, {rnd(SCALE, 6)} AS p_size FROM pa, f, g",
    ),
)
def prep_numeric(spark, sf):
    df = view(spark, sf, "pa").select("p_partkey", "p_size")
    prep = mlprep.build(df, ["p_size"])
    return rounded(prep.prepare(df), 6, "p_size")


@query(
    "prep_onehot",
    with_view("od", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS \"o_orderstatus_F\", CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS \"o_orderstatus_O\" FROM orders"),
)
def prep_onehot(spark, sf):
    # fitted without the value P, which is then unseen
    prep = mlprep.build(view(spark, sf, "od").select("o_orderstatus"), ["o_orderstatus"])
    return prep.prepare(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"))


@query(
    "prep_ordinal",
    and_with(
        "pa",
        "k AS (SELECT p_brand AS b, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM pa WHERE p_brand IS NOT NULL)) "
        "SELECT p.p_partkey, coalesce(k.code, -1)::INTEGER AS p_brand FROM part p LEFT JOIN k ON p.p_brand = k.b",
    ),
)
def prep_ordinal(spark, sf):
    prep = mlprep.build(view(spark, sf, "pa").select("p_brand"), ["p_brand"])
    return prep.prepare(table(spark, sf, "part").select("p_partkey", "p_brand"))


@query("prep_routing")
def prep_routing(spark, sf):
    prep = mlprep.build(parts(spark, sf), ["p_brand", "p_type", "p_size", "p_retailprice"])
    rows = [(c, b) for b, cs in (("numeric", prep.numeric), ("onehot", prep.low), ("ordinal", prep.high)) for c in cs]
    return spark.createDataFrame(rows, "column string, branch string")


# ---------------------------------------------------------------- models


def _classify(name: str):
    def run(spark, sf):
        return train.benchmark(labelled(spark, sf), "quality", "doc_id", [name], cv_folds=0, task=train.CLASSIFICATION).leaderboard

    return run


def _regress(name: str):
    def run(spark, sf):
        return train.benchmark(parts(spark, sf), "p_retailprice", "p_partkey", [name], cv_folds=0, task=train.REGRESSION).leaderboard

    return run


def _slug(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


for _name in train.model_names(train.CLASSIFICATION):
    query(f"classify_{_slug(_name)}")(_classify(_name))
for _name in train.model_names(train.REGRESSION):
    query(f"regress_{_slug(_name)}")(_regress(_name))


@query(
    "linear_regression_fit",
    f"SELECT l_orderkey, l_partkey, {rnd('regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity + regr_intercept(l_extendedprice, l_quantity) OVER ()', 2)} AS predicted FROM lineitem",
)
def linear_regression_fit(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.col("l_extendedprice").alias("label"))
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(df)
    model = train.catalogue(train.REGRESSION)["Linear Regression"]().fit(rows.select("features", "label"))
    return rounded(model.transform(rows).select("l_orderkey", "l_partkey", F.col("prediction").alias("predicted")), 2)


KNN_DIST = "sqrt((a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice))"


def part_points(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("x"), "p_type"
    )


@query(
    "nearest_parts",
    f"SELECT key, neighbor, {rnd('dist', 6)} AS dist, rank FROM (SELECT a.p_partkey AS key, b.p_partkey AS neighbor, {KNN_DIST} AS dist, "
    f"row_number() OVER (PARTITION BY a.p_partkey ORDER BY {KNN_DIST}, b.p_partkey)::INTEGER AS rank FROM part a JOIN part b ON a.p_partkey <> b.p_partkey) WHERE rank <= 3",
)
def nearest_parts(spark, sf):
    p = part_points(spark, sf).drop("p_type")
    return rounded(neighbors.knn(p, p, 3, exclude_same_key=True), 6)


EMB = "SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings"
KNN_VOTE = (
    f"e AS ({EMB}), s AS (SELECT *, row_number() OVER (ORDER BY {MD5.format(k='vec_id')}, vec_id) <= ceil((SELECT count(*) FROM e) * 0.2) AS test FROM e), "
    "d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rn FROM s a JOIN s b ON a.test AND NOT b.test), "
    "n AS (SELECT vec_id, label, count(*) AS n FROM d WHERE rn <= 5 GROUP BY 1, 2), "
    "v AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS rn FROM n)"
)


@query("knn_classification", f"WITH {KNN_VOTE} SELECT vec_id, label::DOUBLE AS prediction FROM v WHERE rn = 1")
def knn_classification(spark, sf):
    from pyspark.ml.functions import array_to_vector

    df = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    fit_rows, test = split.train_test(df, "vec_id")
    model = neighbors.Knn(5, True, "vec_id").fit(fit_rows)
    return model.transform(test).select("vec_id", "prediction")


@query("cross_validated_models")
def cross_validated_models(spark, sf):
    names = ["Logistic Regression", "Decision Tree"]
    return train.benchmark(labelled(spark, sf), "quality", "doc_id", names, cv_folds=3, task=train.CLASSIFICATION).leaderboard


@query("balanced_models")
def balanced_models(spark, sf):
    names = ["Logistic Regression", "Decision Tree"]
    return train.benchmark(labelled(spark, sf), "quality", "doc_id", names, cv_folds=0, task=train.CLASSIFICATION, strategy="smote").leaderboard


def rule_board(spark, sf):
    """Leaderboard of two fixed length rules, ranked as trained models are."""
    df = labelled(spark, sf)
    out = None
    for name, limit in (("Rule A", 1000), ("Rule B", 200)):
        pred = df.withColumn("guess", (F.col("n_chars") > limit).cast("int"))
        one = evaluate.classification(pred, "quality", "guess").select(F.lit(name).alias("Model"), F.col("accuracy").alias("Accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


RULES = union(
    [
        f"SELECT '{n}' AS \"Model\", avg(CASE WHEN (n_chars > {lim}) = (quality = 1) THEN 1.0 ELSE 0.0 END) AS \"Accuracy\" FROM labels JOIN documents USING (doc_id)"
        for n, lim in (("Rule A", 1000), ("Rule B", 200))
    ]
)


@query("leaderboard_best", f"SELECT \"Model\", {rnd('\"Accuracy\"', 8)} AS \"Accuracy\" FROM ({RULES}) ORDER BY \"Accuracy\" DESC, \"Model\" LIMIT 1")
def leaderboard_best(spark, sf):
    return rounded(rule_board(spark, sf).orderBy(F.desc("Accuracy"), "Model").limit(1), 8)


@query(
    "experiment_ranking",
    f"SELECT 'e1' AS experiment, 'quality' AS target, 'Classification' AS task, \"Model\" AS model, 'Accuracy' AS metric, {rnd('\"Accuracy\"', 8)} AS value, "
    f"row_number() OVER (ORDER BY \"Accuracy\" DESC)::INTEGER AS rank FROM ({RULES})",
)
def experiment_ranking(spark, sf):
    path = scratch(spark)
    experiments.record(rule_board(spark, sf), path, "e1", "quality", "Classification")
    return rounded(experiments.compare(experiments.read(spark, path), "Accuracy"), 8)


@query("batch_scoring")
def batch_scoring(spark, sf):
    df = labelled(spark, sf)
    done = train.benchmark(df, "quality", "doc_id", ["Decision Tree"], cv_folds=0, task=train.CLASSIFICATION)
    path = scratch(spark)
    done.bundles["Decision Tree"].save(spark, path)
    return score.supervised(train.ModelBundle.load(spark, path), df.drop("quality"))


@query("prediction_distribution")
def prediction_distribution(spark, sf):
    df = parts(spark, sf)
    done = train.benchmark(df, "p_retailprice", "p_partkey", ["Ridge Regression"], cv_folds=0, task=train.REGRESSION)
    return chart.prediction_distribution(score.supervised(done.bundles["Ridge Regression"], df.drop("p_retailprice")))


@query(
    "class_prediction_counts",
    "SELECT CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS \"Prediction\", count(*) AS \"count\" FROM documents GROUP BY 1",
)
def class_prediction_counts(spark, sf):
    scored = table(spark, sf, "documents").select(F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("Prediction"))
    return chart.prediction_distribution(scored)


# ---------------------------------------------------------------- feature search


def candidate_sql(nums: list[str], source: str, date: str | None) -> str:
    from itertools import combinations, permutations

    actions = autofe.ACTIONS
    blocks = [
        union([f"SELECT '{c}_log' AS f, '{autofe.LOG}' AS t, '{c}' AS s, min({c}) >= 0 AND abs(skewness({c})) > 0.75 AS ok FROM {source}" for c in nums]),
        union([f"SELECT '{c}_squared', '{autofe.SQUARE}', '{c}', min({c} * {c}) < max({c} * {c}) FROM {source}" for c in nums]),
        "SELECT * FROM (" + union([f"SELECT {i} AS o, '{a}_x_{b}' AS f, '{autofe.PRODUCT}' AS t, '{a},{b}' AS s, min({a} * {b}) < max({a} * {b}) AS ok FROM {source}" for i, (a, b) in enumerate(combinations(nums, 2))]) + ") WHERE ok ORDER BY o LIMIT 20",
        "SELECT * FROM (" + union([f"SELECT {i} AS o, '{a}_per_{b}' AS f, '{autofe.RATIO}' AS t, '{a},{b}' AS s, count({a} / nullif({b}, 0)) > 0.5 * count(*) AND min({a} / nullif({b}, 0)) < max({a} / nullif({b}, 0)) AS ok FROM {source}" for i, (a, b) in enumerate(permutations(nums, 2))]) + ") WHERE ok ORDER BY o LIMIT 20",
        union([f"SELECT '{c}_Binned', '{autofe.BINS}', '{c}', count(DISTINCT {c}) > 4 FROM {source}" for c in nums]),
    ]
    if date:
        p = {"Year": "year({d})", "Month": "month({d})", "DayOfWeek": "isodow({d})", "Quarter": "quarter({d})", "IsWeekend": "(isodow({d}) >= 6)::INT"}
        blocks.append(union([f"SELECT '{date}_{n}', '{autofe.DATE}', '{date}', min({e.format(d=date)}) < max({e.format(d=date)}) FROM {source}" for n, e in p.items()]))
    fixed = [f"SELECT f, t, s, ok FROM ({b})" if "AS o," in b else f"SELECT * FROM ({b}) x(f, t, s, ok)" for b in blocks]
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in actions.items())
    return f"SELECT f AS feature_name, t AS feature_type, s AS source_columns, CASE t {cases} END AS action_type FROM ({union(fixed)}) WHERE ok"


CAND = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


@query("feature_candidates", candidate_sql(CAND, "lineitem", "l_shipdate"))
def feature_candidates(spark, sf):
    found = autofe.candidates(table(spark, sf, "lineitem"), CAND)
    return autofe.candidate_frame(spark, found).select("feature_name", "feature_type", F.array_join("source_columns", ",").alias("source_columns"), "action_type")


@query("feature_candidates_events", candidate_sql(["value", "user_id"], "events", "ts"))
def feature_candidates_events(spark, sf):
    found = autofe.candidates(table(spark, sf, "events"), ["value", "user_id"])
    return autofe.candidate_frame(spark, found).select("feature_name", "feature_type", F.array_join("source_columns", ",").alias("source_columns"), "action_type")


def filled(e: str, digits: int) -> str:
    return rnd(f"coalesce({e}, (SELECT quantile_cont({e}, 0.5) FROM lineitem))", digits)


@query(
    "apply_candidates",
    f"SELECT l_orderkey, l_partkey, {filled('ln(1 + l_extendedprice)', 6)} AS l_extendedprice_log, {filled('l_quantity * l_quantity', 4)} AS l_quantity_squared, "
    f"{filled('l_quantity * l_tax', 6)} AS l_quantity_x_l_tax, {filled('l_quantity / nullif(l_discount, 0)', 4)} AS l_quantity_per_l_discount, "
    "year(l_shipdate)::DOUBLE AS l_shipdate_Year FROM lineitem",
)
def apply_candidates(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_shipdate")
    c = autofe.Candidate
    chosen = [
        c("l_extendedprice_log", autofe.LOG, ("l_extendedprice",)), c("l_quantity_squared", autofe.SQUARE, ("l_quantity",)),
        c("l_quantity_x_l_tax", autofe.PRODUCT, ("l_quantity", "l_tax")), c("l_quantity_per_l_discount", autofe.RATIO, ("l_quantity", "l_discount")),
        c("l_shipdate_Year", autofe.DATE, ("l_shipdate",), "year"),
    ]
    out = autofe.fit_features(df, chosen).transform(df)
    out = out.drop("l_extendedprice", "l_quantity", "l_tax", "l_discount", "l_shipdate")
    return rounded(rounded(out, 6, "l_extendedprice_log", "l_quantity_x_l_tax"), 4, "l_quantity_squared", "l_quantity_per_l_discount")


@query("baseline_score")
def baseline_score(spark, sf):
    found = autofe.prepare(parts(spark, sf), "p_retailprice", "p_partkey").score()
    return spark.createDataFrame(sorted(found.items()), "metric string, value double")


@query("feature_importance")
def feature_importance(spark, sf):
    return autofe.importance(parts(spark, sf), "p_retailprice", "p_partkey")


@query("forest_importance")
def forest_importance(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return select.tree_importance(df, "l_returnflag")


@query("feature_impact")
def feature_impact(spark, sf):
    return autofe.recommend(parts(spark, sf), "p_retailprice", "p_partkey").tested
