from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions import contingency, counts
from tabsight.operators import bivariate, charts, segments


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    pdf["d"] = pdf["a"] * 2 + rng.normal(size=300) * 0.1
    pdf.loc[::7, "a"] = np.nan
    pdf["same"] = 1.0
    df = spark.createDataFrame(pdf)
    got = {(r["a"], r["b"]): r["r"] for r in bivariate.correlation_matrix(df).collect()}
    want = pdf.corr()
    for (a, b), value in got.items():
        assert value is None if "same" in (a, b) else value == pytest.approx(want.loc[a, b])
    ranks = {(r["a"], r["b"]): r["r"] for r in bivariate.correlation_matrix(df, ["a", "d", "same"], "spearman").collect()}
    want = pdf[["a", "d"]].dropna().rank().corr().loc["a", "d"]
    assert ranks["a", "d"] == pytest.approx(want) and ranks["a", "same"] is None
    strong = bivariate.strong_correlations(bivariate.correlation_matrix(df))
    assert [(r["a"], r["b"], r["direction"]) for r in strong.collect()] == [("a", "d", "positive")]


def test_many_columns_match_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(500, 9)) + 1e6, columns=list("abcdefghi"))
    pdf["b"] = pdf["a"] * 3 + rng.normal(size=500)
    for k, c in enumerate("abcdef"):
        pdf.loc[k :: 5 + k, c] = np.nan
    pdf["same"] = 0.1
    # Varies, but not where c is present; and is nowhere present where d is.
    pdf["held"] = np.where(pdf["c"].isna(), rng.normal(size=500), 0.3)
    pdf["apart"] = np.where(pdf["d"].isna(), rng.normal(size=500), np.nan)
    pdf["endless"] = np.where(np.arange(500) == 7, np.inf, rng.normal(size=500))
    df = spark.createDataFrame(pdf).repartition(6)
    got = {(r["a"], r["b"]): r["r"] for r in bivariate.correlation_matrix(df).collect()}
    assert len(got) == 13 * 12 // 2
    want = pdf.corr()
    for (a, b), value in got.items():
        if "endless" in (a, b) and (np.isinf(pdf["endless"]) & pdf[a].notna() & pdf[b].notna()).any():
            assert np.isnan(value), (a, b)
        elif "same" in (a, b) or {a, b} in ({"c", "held"}, {"d", "apart"}):
            assert value is None, (a, b)
        elif "endless" in (a, b):
            assert abs(value) < 0.3
        else:
            assert value == pytest.approx(want.loc[a, b], abs=1e-9), (a, b)
    # The aggregates of a narrow table say the same.
    few = bivariate.correlation_matrix(df, ["a", "b", "c", "held", "endless"]).collect()
    for r in few:
        assert got[r["a"], r["b"]] == pytest.approx(r["r"], nan_ok=True) if r["r"] is not None else got[r["a"], r["b"]] is None


def test_a_hundred_columns_take_one_scan_after_their_means(spark, tmp_path):
    names = [f"c{i}" for i in range(100)]
    spark.range(300).select(*[F.rand(i).alias(c) for i, c in enumerate(names)]).write.parquet(f"{tmp_path}/wide")
    found = bivariate.correlation_matrix(spark.read.parquet(f"{tmp_path}/wide"), names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert found.count() == 4950 and found.where("abs(r) < 0.3").count() > 4900
    assert bivariate.correlation_matrix(spark.read.parquet(f"{tmp_path}/wide").limit(0), names).where("r IS NOT NULL").count() == 0


def test_wide_tables_with_dots_in_names(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) * 1.0).alias(f"a.{i}") for i in range(12)])
    assert bivariate.correlation_matrix(df).where("r > 0.999").count() == 66


def test_one_column_has_no_pairs(spark):
    assert bivariate.correlation_matrix(spark.range(3)).count() == 0


def test_single_value_groups_vanish(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0), (None, 5.0)], "g string, v double")
    rows = bivariate.grouped_statistics(df).collect()
    assert [(r["group"], r["median"], r["count"], r["mean_variance"]) for r in rows] == [("a", 2.0, 2, None)]


@pytest.mark.parametrize("distinct", [50, 51])
def test_grouped_gate(spark, distinct):
    df = spark.range(200).select((F.col("id") % distinct).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    assert (bivariate.grouped_statistics(df).count() > 0) == (distinct == 50)


def chi2_v(table, yates):
    o = np.array(table, dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    gap = np.abs(o - e)
    gap = gap - np.minimum(0.5, gap) if yates else gap
    return np.sqrt((gap**2 / e).sum() / (o.sum() * (min(o.shape) - 1)))


@pytest.mark.parametrize("table", [[[10, 0], [3, 8]], [[5, 5], [5, 5]], [[7, 1, 2], [2, 9, 4]]])
def test_cramers_v(spark, table):
    rows = [(f"a{i}", f"b{j}") for i, r in enumerate(table) for j, n in enumerate(r) for _ in range(n)]
    got = bivariate.cramers_v(spark.createDataFrame(rows, "a string, b string"), "a", "b", None).first()
    assert got["cramers_v"] == pytest.approx(chi2_v(table, len(table) == len(table[0]) == 2), abs=1e-9)


def test_cramers_v_of_one_row_table(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), (None, "q")], "a string, b string")
    got = bivariate.cramers_v(df, "a", "b").first()
    assert (got["cramers_v"], got["n"], got["n_rows"], got["n_cols"]) == (0.0, 2, 1, 2)


@pytest.mark.parametrize("distinct", [30, 31])
def test_association_gate(spark, distinct):
    df = spark.range(300).select((F.col("id") % distinct).cast("string").alias("a"), (F.col("id") % 2).cast("string").alias("b"))
    assert bivariate.categorical_associations(df).count() == (1 if distinct == 30 else 0)


def test_all_pairs_are_counted_in_one_scan(spark, tmp_path):
    """Cells of ten columns equal plain counts; a task sends no more rows than there are cells."""
    rng = np.random.default_rng(3)
    data = {f"c{i}": rng.integers(0, 2 + i, 3000).astype(str) for i in range(10)}
    plain = pd.DataFrame(data).mask(rng.random((3000, 10)) < 0.1)
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in plain.itertuples(index=False)]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in data)).repartition(5).write.parquet(f"{tmp_path}/t")
    df, pairs = spark.read.parquet(f"{tmp_path}/t"), list(combinations(data, 2))
    cells = contingency.pair_counts(df, pairs)
    physical = cells._jdf.queryExecution().executedPlan().toString()
    assert physical.count("FileScan") == 1 and "Generate" not in physical
    got = {(r["p"], r["a"], r["b"]): r["count"] for r in cells.collect()}
    want = {(p, a, b): int(n) for p, (x, y) in enumerate(pairs) for (a, b), n in plain.groupby([x, y]).size().items()}
    assert got == want


def test_blocks_of_pairs_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(contingency, "PAIRS_AT_ONCE", 2)
    df = spark.createDataFrame([("x", "p", "1"), ("y", "q", None), ("x", None, "1")], "a string, b string, d string").toDF("a", "b.c", "d")
    pairs = [("a", "b.c"), ("a", "d"), ("b.c", "d")]
    got = sorted(tuple(r) for r in contingency.pair_counts(df, pairs).collect())
    assert got == [(0, "x", "p", 1), (0, "y", "q", 1), (1, "x", "1", 2), (2, "p", "1", 1)]
    assert contingency.pair_counts(df.limit(0), pairs).count() == 0


def test_segments(spark):
    df = spark.range(100).select(
        F.when(F.col("id") < 50, "lo").otherwise("hi").alias("g"),
        F.when(F.col("id") < 50, 1.0).otherwise(9.0).alias("v"),
        F.when(F.col("id") == 0, 1000.0).otherwise(F.col("id") / 100).alias("spike"),
    )
    kinds = {(r["type"], r["column"]): r for r in segments.detect_segments(df).collect()}
    assert ("categorical_split", "v") in kinds and kinds["outlier_segment", "spike"]["outlier_count"] == 1
    assert kinds["numeric_threshold", "spike"]["below_median_count"] == 50


def test_few_values_make_no_segments(spark):
    df = spark.createDataFrame([(float(i == 8) * 100,) for i in range(9)], "v double")
    assert segments.detect_segments(df).count() == 0


def test_grouped_box_and_pie(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("b", 4.0)], "g string, v double")
    rows = {r["group"]: r for r in charts.grouped_box(df, [("g", "v")]).collect()}
    assert rows["a"]["median"] == 1.5 and rows["b"]["count"] == 1
    assert {r["value"]: r["share_pct"] for r in charts.pie(df).collect()} == {"a": 50.0, "b": 50.0}


def test_narrower_gates_follow_from_a_wider_one(spark):
    df = spark.createDataFrame([(f"a{i % 7}", f"b{i % 40}", f"c{i}", None) for i in range(400)], "a string, b string, c string, d string")
    names = ["a", "b", "c", "d"]
    wide = counts.small_domains(df, names, 50)
    for most in (50, 30, 6):
        assert counts.gate(df, names, most, wide) == counts.small_domains(df, names, most) == counts.gate(df, names, most)
