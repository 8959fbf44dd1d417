"""Row-level operators against pandas, and edge tables."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions import columns as cl
from gridsmith.operators import chart, clean, encode, evaluate, features, mlprep, profile, recommend, relate, scale, select, split
from gridsmith.plans import experiments, report
from gridsmith.plans.recipe import Recipe, Step
from gridsmith.sources import tables
from gridsmith.streaming import score as stream

QUICK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
NUMBERS = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e3, 1e3)), min_size=6, max_size=40).filter(lambda v: len(set(v)) > 4)


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, 1.0, None, "x", "a", True), (2, float("nan"), None, "x", None, False),
        (3, float("inf"), None, None, "b", None), (4, -4.0, None, "x", "b", True),
    ]
    return spark.createDataFrame(rows, "id int, v double, nothing double, same string, s string, flag boolean")


# ------------------------------------------------------------------ sources


def test_missing_values_are_unified(edge):
    assert column(tables.normalize_missing(edge)) == [1.0, None, None, -4.0]


def test_csv_reads_missing_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t,z\n1,NA,007\n,x,008\nnan,null,009\n2.5,,010\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.schema["n"].dataType == T.DoubleType()
    assert [r["n"] for r in df.collect()] == [1.0, None, None, 2.5]
    assert [r["t"] for r in df.collect()] == [None, "x", None, None]
    typed = tables.read_csv(spark, str(tmp_path / "a.csv"), "n double, t string, z string")
    assert [r["z"] for r in typed.collect()] == ["007", "008", "009", "010"]


def test_sample_tables(spark):
    house, churn = tables.sample_housing(spark), tables.sample_churn(spark)
    assert profile.health(house).first()[:2] == (304, 7)
    assert profile.duplicate_rows(house).first()[0] == 4 and profile.missing_cells(house).first()[0] == 10
    assert profile.shape(churn).first()["rows"] == 303
    assert profile.duplicate_rows(churn).first()[0] == 3 and profile.missing_cells(churn).first()[0] == 5
    assert profile.detect_task(churn, "Churn").first()["task"] == "Classification"
    assert profile.detect_task(house, "Price").first()["task"] == "Regression"
    flags = {r["column"]: r["is_identifier"] for r in profile.column_flags(house).collect()}
    assert flags["House_ID"] and not flags["Bedrooms"]


# ------------------------------------------------------------------ profile


def test_edge_profile(edge):
    df = tables.normalize_missing(edge)
    assert set(profile.constant_columns(df)) == {"nothing"}  # a value and a gap are two values
    got = {r["column"]: r for r in profile.column_flags(df).collect()}
    assert got["nothing"]["is_constant"] and not got["same"]["is_constant"] and got["flag"]["kind"] == "categorical"
    row = {r["column"]: r for r in profile.numeric_summary(df).collect()}
    assert row["nothing"]["count"] == 0 and row["nothing"]["mean"] is None
    assert row["v"]["mean"] == -1.5 and row["v"]["outliers"] == 0
    cats = {r["column"]: r for r in profile.categorical_summary(df).collect()}
    assert cats["s"]["top"] == "b" and cats["s"]["missing"] == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert profile.shape(df).first()[0] == 0
    assert profile.duplicate_rows(df).first()[0] == 0
    assert {r["distinct"] for r in profile.cardinality(df).collect()} == {0}
    assert profile.outliers(df).count() == 0
    assert clean.Imputer("auto").fit(df).transform(df).count() == 0
    assert recommend.features_advice(df).count() == 0


def test_summary_of_one_row(spark):
    r = profile.numeric_summary(frame(spark, [3.0])).where("column = 'v'").first()
    assert (r["std"], r["skew"], r["median"]) == (0.0, 0.0, 3.0)


def test_skewness_is_pandas(spark):
    v = [1.0, 2.0, 2.0, 9.0, 30.0]
    got = {r["column"]: r["skew"] for r in profile.skewness(frame(spark, v)).collect()}
    assert got["v"] == pytest.approx(pd.Series(v).skew())
    assert profile.skewness(frame(spark, [2.0] * 4), ["v"]).first()["skew"] == 0


def test_correlation_of_a_constant_is_missing(spark):
    df = frame(spark, [1.0, 2.0, 3.0]).withColumns({"c": F.lit(2.0), "g": F.when(F.col("id") > 0, F.lit(1.0))})
    got = {(r["a"], r["b"]): r["r"] for r in relate.pearson(df).collect()}
    assert got[("v", "c")] is None and got[("v", "g")] is None and got[("id", "v")] == pytest.approx(1.0)


def test_date_rules(spark):
    df = spark.createDataFrame([("2024-01-05", "x", "later"), ("2024-02-30", "y", "soon")], "created string, update_note string, mood string")
    assert cl.datetime_columns(df) == []  # half of the values parse
    good = spark.createDataFrame([("2024-01-05", "x")], "created string, mood string")
    assert cl.datetime_columns(good) == ["created"]
    late = spark.createDataFrame([("2024-01-05" if i >= 30 else "unknown",) for i in range(200)], "created string")
    assert cl.datetime_columns(late) == ["created"]  # all rows count, not the first ones
    assert cl.date_candidates(spark.createDataFrame([(1, 2)], "a int, start_date int")) == ["start_date"]
    with pytest.raises(ValueError):
        features.datetime_features(good, "mood")
    parts = features.datetime_features(good, "created", ["dayofweek", "is_weekend", "quarter"]).first()
    assert (parts["created_dayofweek"], parts["created_is_weekend"], parts["created_quarter"]) == (4, 0, 1)


# ------------------------------------------------------------------ cleaning


def test_imputer_errors_and_ties(spark):
    df = spark.createDataFrame([(1, "b", 2), (2, "a", 1), (3, None, None)], "id int, s string, n int")
    for strategy in ("median", "mean"):
        with pytest.raises(ValueError):
            clean.Imputer(strategy, ["s"]).fit(df)
    with pytest.raises(ValueError):
        clean.Imputer("constant", ["n"], "many").fit(df)
    with pytest.raises(ValueError):
        clean.Imputer("guess", ["n"]).fit(df)
    flag = spark.createDataFrame([(1, True), (2, None)], "id int, f boolean")
    assert column(clean.Imputer("constant", ["f"]).fit(flag).transform(flag), "f") == ["true", "Missing"]
    out = clean.Imputer("mode", ["s", "n"]).fit(df).transform(df)
    assert column(out, "s")[2] == "a" and column(out, "n")[2] == 1
    assert column(clean.Imputer("median", ["n"]).fit(df).transform(df), "n")[2] == 1.5


@QUICK
@given(v=NUMBERS)
def test_capping_is_pandas(spark, v):
    s = pd.Series(v)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    df = frame(spark, v)
    got = column(clean.OutlierCap(["v"]).fit(df).transform(df))
    assert got == pytest.approx(list(s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))))
    got = column(clean.OutlierCap(["v"], "zscore", 1.0).fit(df).transform(df))
    assert got == pytest.approx(list(s.clip(s.mean() - s.std(), s.mean() + s.std())))


@QUICK
@given(v=NUMBERS, k=st.integers(2, 6), q=st.sampled_from([2, 4]))
def test_bins_are_pandas(spark, v, k, q):
    df, s = frame(spark, v), pd.Series(v)
    flat = lambda codes: [-1 if c is None or c != c else int(c) for c in codes]
    got = column(features.bins(df, "v", q).transform(df), "v_binned")
    assert flat(got) == flat(pd.qcut(s, q, labels=False, duplicates="drop"))
    got = column(features.bins(df, "v", k, "uniform").transform(df), "v_binned")
    assert flat(got) == flat(pd.cut(s, k, labels=False))


def test_cap_keeps_missing_and_small_tables(spark):
    df = frame(spark, [1.0, None, 3.0, 100.0])
    assert column(clean.OutlierCap(["v"]).fit(df).transform(df)) == [1.0, None, 3.0, 100.0]  # under four values
    wide = frame(spark, [1.0, 2.0, 3.0, 4.0, None, 500.0])
    out = column(clean.OutlierCap(["v"]).fit(wide).transform(wide))
    assert out[4] is None and out[5] < 500


def test_casts(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("2.5",)], "t string")
    assert [r[0] for r in clean.cast_column(df, "t", "numeric").collect()] == [1.0, None, None, 2.5]
    assert clean.cast_loss(df, {"t": "numeric"}).first()["lost"] == 1
    with pytest.raises(ValueError):
        clean.cast_column(df, "t", "colour")
    assert clean.cast_column(df, "absent", "numeric").columns == ["t"]


# ------------------------------------------------------------------ encoding and scaling


def test_encodings_of_unseen_and_missing(spark):
    fit = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "id int, s string")
    new = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None), (4, "b")], "id int, s string")
    assert column(encode.label(fit, ["s"]).transform(new), "s") == [0, -1, -1, 1]
    assert column(encode.frequency(fit, ["s"]).transform(new), "s") == pytest.approx([1 / 3, 0, 0, 2 / 3])
    hot = encode.onehot(fit, ["s"]).transform(new)
    assert hot.columns == ["id", "s_b"] and column(hot, "s_b") == [0, 0, 0, 1]
    with pytest.raises(ValueError):
        encode.encode(fit, ["s"], "hash")


def test_onehot_skips_wide_columns(spark):
    df = spark.range(40).select(F.col("id").cast("int").alias("id"), F.col("id").cast("string").alias("s"))
    assert encode.onehot(df, ["s"]).transform(df).columns == ["id", "s"]


def test_scaling_rules(spark):
    df = frame(spark, [1.0, 2.0, 4.0]).withColumn("c", F.lit(5.0))
    v = np.array([1.0, 2.0, 4.0])
    out = scale.fit(df, ["v", "c"], "standard").transform(df)
    assert column(out) == pytest.approx(list((v - v.mean()) / v.std())) and column(out, "c") == [0, 0, 0]
    assert column(scale.fit(df, ["v", "c"], "minmax").transform(df), "c") == [0, 0, 0]
    with pytest.raises(ValueError):
        scale.fit(frame(spark, [1.0, None]), ["v"])
    with pytest.raises(ValueError):
        scale.fit(df, ["v"], "other")


# ------------------------------------------------------------------ features


def test_ratio_and_text(spark):
    df = spark.createDataFrame([(1, 4.0, 0.0), (2, 4.0, 2.0)], "id int, a double, b double")
    assert column(features.interaction(df, "a", "b", "divide"), "a_div_b") == [None, 2.0]
    assert column(features.named_interaction(df, "a", "b", "divide"), "a_d_b")[0] == pytest.approx(4e5)
    with pytest.raises(ValueError):
        features.interaction(df, "a", "gone")
    words = spark.createDataFrame([(1, " a b\tc \n"), (2, ""), (3, None)], "id int, t string")
    out = features.text_stats(words, "t")
    assert column(out, "t_word_count") == [3, 0, 0] and column(out, "t_len") == [8, 0, 0]


def test_group_features_of_single_rows_and_missing_groups(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0), (4, None, 7.0)], "id int, g string, v double")
    out = features.group_features(df, "g", "v").transform(df)
    assert column(out, "v_by_g_mean") == [2.0, 2.0, 5.0, None]
    assert column(out, "v_by_g_std")[2:] == [None, None]


def test_collinear_columns(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.pmod("id", F.lit(3)).cast("double").alias("c"))
    assert select.drop_collinear(df).columns == ["a", "c"]


def test_advice_and_generated_features(spark):
    df = tables.sample_housing(spark)
    found = [(r["issue"], r["column"]) for r in recommend.quality(df).collect()]
    assert found[0] == ("Duplicate Rows", "All Rows") and ("Identifier Detection", "House_ID") in found
    out, applied = recommend.generate_features(df, "Price", 3)
    assert len(applied) == 3 and out.count() == 304 and len(out.columns) > 7
    for action in ("remove_duplicates", "drop_column_col2", "impute_mode", "cap_outliers_iqr", "apply_log1p", "none"):
        assert recommend.apply(df, action, "Square_Feet").count() in (300, 304)
    with pytest.raises(ValueError):
        recommend.apply_feature(df, "dance", {})


# ------------------------------------------------------------------ charts and metrics


def test_histogram_counts_every_row(spark):
    v = np.random.default_rng(0).normal(size=200)
    got = chart.histogram(frame(spark, [float(x) for x in v]), "v", 12, density=True).orderBy("bin").collect()
    want, edges = np.histogram(v, 12)
    assert [r["count"] for r in got] == list(want)
    assert sum(r["density"] for r in got) * (edges[1] - edges[0]) == pytest.approx(1.0)
    assert chart.histogram(frame(spark, [2.0, 2.0]), "v", 4).agg(F.sum("count")).first()[0] == 2


def test_metrics(spark):
    y, p = [0, 0, 1, 1, 2], [0, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    r = evaluate.classification(df, "y", "p").first()
    assert (r["accuracy"], r["recall"]) == (pytest.approx(0.6), pytest.approx(0.6))
    assert r["precision"] == pytest.approx((2 * 0.5 + 2 * 2 / 3 + 0) / 5)
    assert evaluate.confusion(df, "y", "p").count() == 9 and evaluate.confusion(df, "y", "p", filled_only=True).count() == 4
    mixed = df.withColumn("p", F.col("p").cast("double"))
    assert evaluate.classification(mixed, "y", "p").first() == r
    assert {tuple(x) for x in evaluate.confusion(mixed, "y", "p").collect()} == {tuple(x) for x in evaluate.confusion(df, "y", "p").collect()}
    many = spark.range(1_200).selectExpr("id AS y", "id AS p")
    assert evaluate.confusion(many, "y", "p", filled_only=True).count() == 1_200
    with pytest.raises(ValueError):
        evaluate.confusion(many, "y", "p")
    q = evaluate.regression(df, "y", "p").first()
    assert q["mae"] == pytest.approx(0.6) and q["rmse"] == pytest.approx(math.sqrt(1.0))


def test_pivot_and_hierarchy(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 5.0), ("b", "x", 7.0)], "r string, c string, v double")
    got = {r["row"]: (r["x"], r["y"]) for r in chart.pivot(df, "r", "c", "v").collect()}
    assert got == {"a": (1.0, 2.0), "b": (6.0, 0.0)}
    assert chart.pivot(df, "r", "c", "v", form="long").count() == 3
    wide = spark.range(300).selectExpr("1 AS r", "id AS c", "1.0D AS v")
    assert chart.pivot(wide, "r", "c", "v", form="long").count() == 300
    with pytest.raises(ValueError):
        chart.pivot(wide, "r", "c", "v")


def test_points_are_drawn_in_full_unless_limited(spark):
    df = spark.range(6_000).selectExpr("id", "id % 3 AS g", "CAST(id AS DOUBLE) AS v", "CAST(id % 7 AS DOUBLE) AS w", "id % 2 AS c")
    assert chart.strip(df, "v", "id", "g").count() == chart.points(df, ["v", "w"], "id").count() == 6_000
    assert chart.strip(df, "v", "id", "g", per_group=10, color="c").count() == 30 and "c" in chart.strip(df, "v", "id", "g", color="c").columns
    for made in (chart.parallel_coordinates(df, ["v", "w"], "id"), chart.scatter_matrix(df, ["v", "w"], "id"), chart.missing_matrix(df, "id")):
        assert made.count() == 6_000
    assert chart.parallel_coordinates(df, ["v", "w"], "id", 100).count() == chart.missing_matrix(df, "id", 100).count() == 100


def test_violin_forms(spark):
    df = spark.range(400).selectExpr("id", "id % 2 AS g", "id % 4 AS f", "CAST(id AS DOUBLE) AS v")
    whole, per, both = chart.violin(df, "v", bins=5), chart.violin(df, "v", "g", 5), chart.violin(df, "v", "g", 5, facet="f")
    assert whole.count() == 5 and whole.first()["median"] == 199.5
    assert {(r["g"], r["median"]) for r in per.collect()} == {(0, 199.0), (1, 200.0)}
    assert {(r["g"], r["f"]) for r in both.collect()} == {(0, 0), (0, 2), (1, 1), (1, 3)}
    for made in (per, both):
        width = F.col("right") - F.col("left")
        assert all(abs(r["s"] - 1) < 1e-9 for r in made.groupBy(*[c for c in ("g", "f") if c in made.columns]).agg(F.sum(F.col("density") * width).alias("s")).collect())


def test_pivot_totals(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 5.0), ("b", "x", 7.0)], "r string, c string, v double")
    top = chart.hierarchy(df, ["r", "c"], "v").where("level = 0").first()
    assert top["value"] == 15.0


# ------------------------------------------------------------------ recipe, report, experiments, stream


def test_recipe_is_fitted_once_and_stepped_back(spark):
    raw, new = frame(spark, [1.0, None, 5.0]), frame(spark, [None, 100.0])
    recipe = Recipe().add(Step("median", clean.Imputer("median", ["v"]).fit)).add(Step.plain("double", lambda d: d.withColumn("v", F.col("v") * 2)))
    fitted = recipe.fit(raw)
    assert column(fitted.transform(new)) == [6.0, 200.0]
    assert column(recipe.back().apply(raw)) == [1.0, 3.0, 5.0]
    assert [r["action"] for r in recipe.log(spark).collect()] == ["median", "double"]
    assert recipe.back(9).steps == ()


def test_report_and_experiments(spark, tmp_path):
    board = spark.createDataFrame([("m1", 0.5), ("m2", 0.75)], "Model string, Accuracy double")
    text = report.markdown(report.metrics(frame(spark, [1.0, None]), actions=["a"], model={"best": "m2"}, leaderboard=board))
    assert "missing_cells**: 1" in text and "m2 / Accuracy**: 0.75" in text
    path = str(tmp_path / "log")
    for e in ("e1", "e2"):
        experiments.record(board, path, e, "y", "Classification")
    best = experiments.compare(experiments.read(spark, path), "Accuracy").orderBy("rank").first()
    assert (best["experiment"], best["model"], best["rank"]) == ("e1", "m2", 1)


def test_fitted_steps_run_on_a_stream(spark, tmp_path):
    raw = frame(spark, [1.0, None, 5.0])
    fitted = Recipe().add(Step("median", clean.Imputer("median", ["v"]).fit)).fit(raw)
    raw.write.parquet(str(tmp_path / "in"))
    query = stream.replay(fitted, stream.read_files(spark, str(tmp_path / "in"), raw.schema), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert column(spark.read.parquet(str(tmp_path / "out"))) == [1.0, 3.0, 5.0]


# ------------------------------------------------------------------ schema checks of scoring


def test_alignment(spark):
    df = spark.createDataFrame([("007", "3"), ("x", "bad")], "code string, n string")
    out = mlprep.align(df, ["n"], ["code"]).collect()
    assert [tuple(r) for r in out] == [("007", 3.0), ("x", None)]
    with pytest.raises(ValueError):
        mlprep.align(df, ["weight"], [])
    assert mlprep.missing_features(df, ["n", "weight"]) == ["weight"]
    assert mlprep.screen_features(spark.createDataFrame([(1, 2, "a")], "id int, user_id int, t string"), "y") == []
    with pytest.raises(ValueError):
        split.folds(frame(spark, [1.0]), "id", 1)


def test_csv_types_and_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,flag,size,note,truth,big\n1,Yes,1d,"two\nlines",True,1e3\n2,No,2f,"say ""hi""",false,.5\n3,Yes,NA,plain,TRUE,inf\n')
    df = tables.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "flag": "string", "size": "string", "note": "string", "truth": "boolean", "big": "double"}
    rows = df.orderBy("id").collect()
    assert [r["note"] for r in rows] == ["two\nlines", 'say "hi"', "plain"] and rows[2]["size"] is None
    assert [r["truth"] for r in rows] == [True, False, True] and [r["big"] for r in rows][:2] == [1000.0, 0.5]


def test_folds_of_many_small_classes(spark):
    df = spark.range(300).selectExpr("id", "CAST(id DIV 3 AS STRING) AS c").union(spark.range(300, 310).selectExpr("id", "NULL"))
    dealt = split.folds(df, "id", 5, stratify="c")
    assert sorted(r["count"] for r in dealt.groupBy("fold").count().collect()) == [62] * 5
    assert dealt.groupBy("c", "fold").count().where("c is not null and count > 1").count() == 0


def test_lookup_spreads_rows_without_a_key(spark, tiny_limits):
    from gridsmith.functions.distributed import lookup_join

    rows = spark.range(20_000).selectExpr("CASE WHEN id % 100 = 0 THEN CAST(id AS STRING) END AS k")
    labels = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.lit(1))
    joined = lookup_join(rows, labels, ["k"], "n")
    assert joined.where("v = 1").count() == 200 and joined.count() == 20_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in lookup_join(rows, labels, ["k"], "n").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_duplicates_by_digest(spark):
    rows = [(1, "a", None), (1, "a", None), (1, None, "a"), (2, "b", "x" * 1_000), (2, "b", "x" * 1_000), (2, "b", "x" * 1_000), (None, None, None), (None, None, None), (3, "c", "")]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(3)
    assert profile.duplicate_rows(df).first()[0] == 4
    kept = clean.remove_duplicates(df)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted({str(r) for r in df.collect()})
    assert profile.duplicate_rows(df.where("k = 3")).first()[0] == 0 and clean.remove_duplicates(df.where("k > 9")).count() == 0
