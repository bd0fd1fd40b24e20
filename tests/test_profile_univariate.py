import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions.counts import small_domains, top_ranked, value_counts
from tabsight.operators import profile, univariate


def one(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 40])
def test_moments_match_pandas(spark, n):
    values = [float(v) for v in np.random.default_rng(n).exponential(3, n)]
    row = univariate.numeric_univariate(one(spark, values), ndigits=None).first()
    s = pd.Series(values)
    for name, want in (("mean", s.mean()), ("std", s.std()), ("skewness", s.skew()), ("kurtosis", s.kurtosis())):
        got = row[name]
        assert (got is None and math.isnan(want)) or got == pytest.approx(want)
    assert row["iqr"] == pytest.approx(s.quantile(0.75) - s.quantile(0.25))


def test_constant_null_nan_inf(spark):
    df = spark.createDataFrame(
        [(5.0, None, float("nan")), (5.0, None, 1.0), (5.0, None, float("inf")), (5.0, None, 2.0)],
        "same double, gone double, odd double",
    )
    rows = {r["column"]: r for r in univariate.numeric_univariate(df).collect()}
    assert (rows["same"]["skewness"], rows["same"]["kurtosis"], rows["same"]["std"], rows["same"]["cv"]) == (0, 0, 0, 0)
    assert rows["gone"]["error"] and rows["gone"]["count"] is None
    assert rows["odd"]["count"] == 3 and rows["odd"]["max"] == float("inf")
    missing = {r["column"]: r["missing"] for r in profile.missing_values(df).collect()}
    assert missing == {"gone": 4, "odd": 1}


def test_mean_zero_has_no_cv(spark):
    assert univariate.numeric_univariate(one(spark, [-1.0, 1.0])).first()["cv"] is None


def test_mode_ties_and_booleans(spark):
    df = spark.createDataFrame([("b", True), ("a", True), ("b", False), ("a", None)], "s string, f boolean")
    rows = {r["column"]: r for r in univariate.categorical_univariate(df).collect()}
    assert rows["s"]["mode"] == "a" and rows["s"]["mode_pct"] == 50.0
    assert rows["f"]["mode"] == "true" and rows["f"]["count"] == 3


def test_long_texts_are_told_apart(spark):
    head = "x" * 70
    values = [head + "b"] * 2 + [head + "a"] * 2 + ["y" * 64] * 2 + ["x" * 64] * 1 + ["z"]
    df = one(spark, values, "string")
    assert univariate.categorical_univariate(df).first()["mode"] == head + "a"
    top = [(r["value"], r["count"]) for r in univariate.top_values(df, top_n=4).orderBy("rank").collect()]
    assert top == [(head + "a", 2), (head + "b", 2), ("y" * 64, 2), ("x" * 64, 1)]
    assert top_ranked(df, value_counts(df, ["v"]), 2).count() == 2


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a"), (None, "a"), (None, "a"), (2, "b")], "a int, b string")
    row = profile.dataset_metadata(df).first()
    assert (row["row_count"], row["duplicate_row_count"], row["total_missing_cells"]) == (6, 3, 5)


def test_empty_text_is_not_missing(spark):
    row = profile.dataset_metadata(spark.createDataFrame([("",), (None,)], "a string")).first()
    assert (row["duplicate_row_count"], row["total_missing_cells"]) == (0, 1)


def test_summary_of_mixed_columns(spark):
    df = spark.sql(
        "select 1 as n, 'a' as s, timestamp_ntz'2024-01-02 03:04:05' as t, true as f "
        "union all select null, null, null, null"
    )
    rows = {r["column"]: r for r in profile.column_summary(df).collect()}
    assert rows["n"]["mean"] == 1.0 and rows["n"]["null_pct"] == 50.0 and rows["n"]["top_value"] is None
    assert rows["t"]["min"] == "2024-01-02 03:04:05" and rows["f"]["top_value"] == "true"


def test_details_without_numbers(spark):
    row = profile.column_details(spark.createDataFrame([("a",)], "s string")).first()
    assert row["unique"] == 1 and row["std"] is None


@pytest.mark.parametrize("distinct", [15, 16, 50, 51])
def test_gate(spark, distinct):
    df = spark.range(400).select((F.col("id") % distinct).cast("string").alias("c"))
    assert bool(small_domains(df, ["c"], 15)) == (distinct <= 15)
    assert bool(small_domains(df, ["c"], 50)) == (distinct <= 50)


def test_single_time_and_gaps(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' as a, explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-05', interval 1 day)) as b")
    rows = {r["column"]: r for r in univariate.datetime_univariate(df.limit(1)).collect()}
    assert rows["a"]["inferred_frequency"] == "single value"
    rows = {r["column"]: r for r in univariate.datetime_univariate(df).collect()}
    assert rows["b"]["inferred_frequency"] == "1 days 00:00:00" and rows["b"]["range_days"] == 4
    assert rows["a"]["inferred_frequency"] == "0 days 00:00:00"


def test_dates_and_nulls(spark):
    df = spark.sql("select date'2024-03-01' as d union all select date'2024-03-03' union all select null")
    row = univariate.datetime_univariate(df).first()
    assert (row["count"], row["null_count"], row["inferred_frequency"]) == (2, 1, "2 days 00:00:00")
