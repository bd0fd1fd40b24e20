import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.operators import features, problem


def test_identifier_rules(spark):
    df = spark.range(100).select(
        F.col("id").alias("width"),
        (F.col("id") * 1.0).alias("unique"),
        F.floor(F.col("id") * 0.9).alias("rising"),
        ((F.col("id") * 37) % 90).alias("mixed"),
        (F.col("id") % 7).alias("few"),
        F.lit(None).cast("double").alias("gone"),
        F.col("id").alias("row"),
    )
    got = {r["column"]: r["identifier_like"] for r in problem.identifier_table(df, ["row"]).collect()}
    assert got == {"width": True, "unique": True, "rising": True, "mixed": False, "few": False, "gone": False, "row": True}
    assert not problem.identifier_like(df, "rising")


def test_targets(spark):
    df = spark.range(100).select(
        (F.col("id") % 3).cast("string").alias("label"),
        (F.col("id") % 5).cast("double").alias("grade"),
        F.when(F.col("id") == 0, "rare").otherwise("usual").alias("sparse"),
        (F.col("id") % 40 / 3.0).alias("amount"),
        F.lit(None).cast("double").alias("gone"),
    )
    kinds = {t: problem.classify_target(df, t).problem_type for t in df.columns}
    assert kinds == {
        "label": "classification",
        "grade": "classification",
        "sparse": "clustering",
        "amount": "regression",
        "gone": "clustering",
    }
    assert problem.guess_target(df.drop("gone")) == "amount"


def test_detect(spark):
    df = spark.range(40).selectExpr("timestamp_micros(id) as t", "id % 9 as discount", "id % 8 as other", "'a' as s")
    found = problem.detect_problem(df)
    assert (found.problem_type, found.target, found.time_column) == ("time_series", "discount", "t")
    assert problem.detect_problem(df.limit(29)).problem_type == "clustering"
    assert problem.detect_problem(df, target_hint="other").problem_type == "classification"


def test_whole_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.5, None), (2.0, 1.0, None)], "a double, b double, c double")
    assert {r["column"]: r["integer_like"] for r in problem.integer_like(df).collect()} == {"a": True, "b": False, "c": False}


@pytest.mark.parametrize("block", [9, 1000])
def test_history_matches_pandas(spark, block):
    values = pd.Series(np.random.default_rng(4).normal(size=200))
    values[::11] = np.nan
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(values)], "pos bigint, y double").repartition(5)
    lagged = features.lag_features(df, "y", block_rows=block).toPandas().sort_values("pos").reset_index(drop=True)
    for k in (1, 3, 7):
        pd.testing.assert_series_equal(lagged[f"y_lag{k}"], values.shift(k), check_names=False)
    rolled = features.rolling_mean(df, "y", block_rows=block).toPandas().sort_values("pos").reset_index(drop=True)
    for w in (3, 7):
        pd.testing.assert_series_equal(rolled[f"y_roll{w}"], values.rolling(w, min_periods=1).mean(), check_names=False)
    past = features.rolling_mean(df, "y", exclude_current=True).toPandas().sort_values("pos").reset_index(drop=True)
    pd.testing.assert_series_equal(past["y_roll3"], values.shift(1).rolling(3, min_periods=1).mean(), check_names=False)


def test_fill_encode_scale(spark):
    df = spark.createDataFrame([(0, 1.0, "b", None), (1, None, "a", None), (2, 4.0, None, None), (3, 2.0, "a", None)], "pos bigint, n double, c string, none string")
    filled = features.fill_mode(features.fill_median(df, ["n"]), ["c", "none"]).orderBy("pos").collect()
    assert [r["n"] for r in filled] == [1.0, 2.0, 4.0, 2.0] and [r["c"] for r in filled] == ["b", "a", "a", "a"]
    assert {r["none"] for r in filled} == {"MISSING"}
    coded = features.factorize(df, "c").orderBy("pos").collect()
    assert [r["c"] for r in coded] == [0.0, 1.0, -1.0, 1.0]
    wide, names = features.one_hot(df, ["c"])
    assert names == ["c_b"] and [r["c_b"] for r in wide.orderBy("pos").collect()] == [1.0, 0.0, 0.0, 0.0]
    scaled = features.standard_scale(df.withColumn("same", F.lit(3.0)), ["n", "same"]).agg(F.avg("n"), F.stddev_samp("n"), F.avg("same")).first()
    assert tuple(scaled) == pytest.approx((0.0, 1.0, 3.0))


@pytest.mark.parametrize("distinct", [15, 16])
def test_one_hot_gate(spark, distinct):
    df = spark.range(200).select(F.col("id").alias("pos"), (F.col("id") % distinct).cast("string").alias("c"), F.col("id").cast("double").alias("y"))
    spec = problem.Problem("regression", "y", ["c"])
    made = features.engineer_features(df, spec, ["pos"])
    assert len(made.names) == (14 if distinct == 15 else 1)
    assert made.matrix.count() == 200


def test_time_series_features(spark):
    df = spark.range(60).selectExpr("timestamp_micros((60 - id) * 3600000000) as t", "id", "if(id % 9 = 0, null, id * 1.0D) as value", "cast(id % 2 as string) as s")
    spec = problem.detect_problem(df)
    made = features.engineer_features(df, spec, ["t", "id"])
    assert spec.target == "value" and {"value_lag7", "value_roll3", "month", "s_1"} <= set(made.names)
    assert made.matrix.count() == 60
    assert made.transformations.where("action = 'sort_by_time'").count() == 1
