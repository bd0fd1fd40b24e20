import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions import order
from tabsight.functions.normal import normal_quantile, normal_quantiles
from tabsight.operators import charts, features, problem, series, shape, univariate
from tabsight.session import materialise


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double")


def k_squared(x):
    """The published formulas, term by term."""
    x = np.asarray(x, float)
    n = len(x)
    d = x - x.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    b2 = (d**4).mean() / (d**2).mean() ** 2
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    alpha = math.sqrt(2 / (w2 - 1))
    z1 = math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1)) / math.sqrt(math.log(math.sqrt(w2)))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    t = 1 + (b2 - e) / math.sqrt(v) * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs((1 - 2 / a) / t) ** (1 / 3), t)) / math.sqrt(2 / (9 * a))
    return z1**2 + z2**2


@pytest.mark.parametrize("n", [8, 11, 30, 5001])
def test_k_squared_equals_the_formulas(spark, n):
    x = np.random.default_rng(n).gamma(3, size=n)
    row = shape.normality_test(frame(spark, x)).first()
    assert row["n"] == n and row["k2"] == pytest.approx(k_squared(x), abs=1e-3)
    assert row["p_value"] == pytest.approx(math.exp(-k_squared(x) / 2), abs=1e-6)


def test_normal_and_exponential(spark):
    rng = np.random.default_rng(8)
    assert shape.normality_test(frame(spark, rng.normal(size=2000))).first()["is_normal"]
    assert not shape.normality_test(frame(spark, rng.exponential(size=2000))).first()["is_normal"]
    for values in (range(7), [3.0] * 20):
        assert shape.normality_test(frame(spark, values)).first()["p_value"] is None


def test_all_values_count_on_any_partitioning(spark):
    df = spark.range(40_000).select(F.sin("id").alias("v"))
    got = {tuple(shape.normality_test(df.repartition(k)).first()) for k in (1, 4, 7)}
    assert len(got) == 1 and got.pop()[1] == 40_000


PUBLISHED = [
    ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.7888, 0.006704),
    ([0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66], 0.90047, 0.04209),
    ([1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49], 0.95903, 0.52460),
]


@pytest.mark.parametrize("values, w, p", PUBLISHED)
def test_shapiro_wilk_of_published_values(spark, values, w, p):
    row = shape.shapiro_wilk(frame(spark, values)).first()
    assert row["w"] == pytest.approx(w, abs=1e-4) and row["p_value"] == pytest.approx(p, abs=5e-5)
    assert (row["n"], row["is_normal"], row["fitted"]) == (len(values), p > 0.05, True)


def test_shapiro_wilk_on_any_partitioning(spark):
    """Half of a column is one value; gaps, infinities and a large mean change nothing."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.sin("id")).alias("hot"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") == 1, float("inf")).otherwise(F.cos("id") + 1e6).alias("far"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") == 1, float("inf")).otherwise(F.cos("id")).alias("near"),
    )
    got = {tuple(tuple(r) for r in shape.shapiro_wilk(df.repartition(k), ndigits=5).collect()) for k in (1, 4, 7)}
    hot, far, near = got.pop()
    assert not got and hot[1] == 9000 and not hot[-1]
    assert far[2:4] == pytest.approx(near[2:4], abs=1e-4) and far[1] == near[1] == 7199


def test_shapiro_wilk_sorts_different_values_once(spark, monkeypatch):
    """Equal values are one sorted row, whose places are scored in runs of any length."""
    saved = []

    def spy(df, label):
        out = materialise(df, label)
        saved.append((label, out.count()))
        return out

    monkeypatch.setattr(order, "materialise", spy)
    df = spark.range(9000).select((F.col("id") % 10).cast("double").alias("few"), F.floor(F.col("id") / 7).cast("double").alias("many"))
    whole = shape.shapiro_wilk(df, ndigits=7).collect()
    assert saved == [("sorted", 10 + 1286)]
    monkeypatch.setattr(shape, "RUN_RANKS", 8)
    assert shape.shapiro_wilk(df, ndigits=7).collect() == whole
    n, x = 9000, np.sort(np.arange(9000) % 10).astype(float)
    m = np.array([statistics.NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)])
    assert whole[0]["w"] == pytest.approx((m @ (x - x.mean())) ** 2 / (m @ m) / ((x - x.mean()) ** 2).sum(), abs=2e-3)


def test_normal_quantiles_equal_the_library():
    p = np.array([1e-300, 1e-12, 1e-5, 0.07, 0.0750001, 0.3, 0.5, 0.9, 0.93, 1 - 1e-9])
    assert normal_quantiles(p) == pytest.approx([statistics.NormalDist().inv_cdf(v) for v in p], rel=1e-12)


def test_shapiro_wilk_without_an_answer(spark):
    df = spark.range(20).select(F.lit(3.0).alias("same"), F.when(F.col("id") < 7, F.col("id") * 1.0).alias("few"), F.lit(None).cast("double").alias("gone"))
    assert [(r["n"], r["w"], r["p_value"]) for r in shape.shapiro_wilk(df).collect()] == [(20, None, None), (7, None, None), (0, None, None)]
    assert [r["n"] for r in shape.shapiro_wilk(df.limit(0)).collect()] == [0, 0, 0]


def test_normal_quantiles_equal_the_standard_library(spark):
    shares = [1e-15, 1e-12, 1e-7, 0.001, 0.07, 0.0751, 0.3, 0.5, 0.9, 0.99999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in shares], "p double").select(normal_quantile(F.col("p")).alias("z"))
    want = [statistics.NormalDist().inv_cdf(p) for p in shares]
    assert [r["z"] for r in df.collect()] == pytest.approx(want, rel=1e-12, abs=1e-15)


def test_infinities_are_counted_apart(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0, 2.5, 3.5, 2.2, 3.1, float("inf"), float("-inf"), float("nan")])
    rows = shape.auto_histogram(df).collect()
    assert sum(r["count"] for r in rows if r["bin"] is not None) == 8
    assert [r["count"] for r in rows if r["bin"] is None] == [2]
    label = shape.classify_distribution(df).first()
    assert label["skewness"] is not None and label["distribution_type"] != "insufficient_data"
    assert charts.histogram(df, ["v"]).where("bin IS NOT NULL").agg(F.sum("count")).first()[0] == 8
    stats = univariate.numeric_univariate(df).first()
    assert stats["std"] is None and stats["skewness"] is None and stats["max"] == float("inf")


def test_scatter_spans_drawn_points(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (float("nan"), 900.0), (3.0, float("inf"))], "x double, y double")
    rows = charts.scatter(df, "x", "y").collect()
    assert sorted((r["x_bin"], r["y_bin"]) for r in rows) == [(0, 0), (39, 39)]


@pytest.mark.parametrize("kind", ["normal", "bimodal", "whole", "constant"])
def test_histogram_matches_numpy(spark, kind):
    rng = np.random.default_rng(9)
    values = {
        "normal": rng.normal(size=900),
        "bimodal": np.concatenate([rng.normal(-8, 1, 500), rng.normal(8, 1, 500)]),
        "whole": rng.integers(0, 12, 800),
        "constant": np.full(20, 5.0),
    }[kind]
    if kind == "whole":
        df = spark.createDataFrame([(int(v),) for v in values], "v bigint")
    else:
        df = frame(spark, values)
    got = [r["count"] for r in shape.auto_histogram(df).orderBy("bin").collect()]
    want, _ = np.histogram(values, bins="auto")
    assert sum(got) == len(values) and len(got) == len(want)
    if kind != "whole":
        assert got == list(want)
    if kind == "bimodal":
        assert shape.histogram_peaks(shape.auto_histogram(df)).first()["is_multimodal"]


def test_nulls_stay_out_of_bins(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, None)], "x double, y double")
    assert charts.histogram(df, ["x"]).agg(F.sum("count")).first()[0] == 2
    assert charts.scatter(df, "x", "y").agg(F.sum("count")).first()[0] == 1


def test_labels(spark):
    rng = np.random.default_rng(11)
    assert shape.classify_distribution(frame(spark, range(7))).first()["distribution_type"] == "insufficient_data"
    assert shape.classify_distribution(frame(spark, [0.0] * 30 + [9.0])).first()["distribution_type"] == "right_skewed"
    assert shape.classify_distribution(frame(spark, rng.normal(size=12))).first()["normality_p_value"] is not None


def timed(spark, values):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, v double").selectExpr(
        "timestamp_micros(id * 86400000000) as t", "id", "v"
    )


def test_weekly_wave(spark):
    rng = np.random.default_rng(12)
    values = np.sin(np.arange(400) * 2 * np.pi / 7) + rng.normal(size=400) * 0.05
    row = series.time_series_analysis(timed(spark, values), ["t", "id"], ["v"]).first()
    assert row["seasonality"] == "detected" and row["dominant_period_lag"] % 7 == 0


@pytest.mark.parametrize("block", [70, 1000])
def test_autocorrelation_matches_pandas(spark, block):
    values = list(np.random.default_rng(13).normal(size=333).cumsum())
    values[5] = values[200] = None
    placed = series.positioned_series(timed(spark, values).repartition(4), ["t", "id"], ["v"])
    got = {r["lag"]: r["r"] for r in series.autocorrelation(placed, block_rows=block).collect()}
    s = pd.Series([v for v in values if v is not None])
    assert sorted(got) == list(range(1, 61))
    for k in (1, 2, 30, 60):
        assert got[k] == pytest.approx(s.autocorr(k), abs=1e-9)


def test_short_and_constant_series(spark):
    row = series.time_series_analysis(timed(spark, [1, 2, 3, 4]), ["t", "id"], ["v"]).first()
    assert row["status"] == "insufficient_data" and row["trend"] is None
    row = series.time_series_analysis(timed(spark, [5.0] * 20), ["t", "id"], ["v"]).first()
    assert (row["trend"], row["slope"], row["r_squared"], row["seasonality"]) == ("flat", 0.0, 0.0, "not_detected")
    placed = series.positioned_series(timed(spark, range(20)), ["t", "id"], ["v"])
    assert series.autocorrelation(placed).agg(F.max("lag")).first()[0] == 10
    line = series.detect_trend(placed).first()
    assert (line["trend"], line["slope"], line["r_squared"]) == ("upward", 1.0, 1.0)


def ten_a_day(spark, parts):
    rng = np.random.default_rng(14)
    rows = [(i // 10, float(v) if i % 9 else None, int(k), f"x{k % 3}") for i, (v, k) in enumerate(zip(rng.normal(size=200).cumsum(), rng.permutation(200)))]
    df = spark.createDataFrame(rows, "day bigint, v double, k bigint, g string").selectExpr("timestamp_micros(day * 86400000000) as t", "v", "k", "g")
    return df.repartition(parts)


def test_equal_times_give_one_answer_however_rows_are_stored(spark):
    answers = [sorted(map(str, series.time_series_analysis(ten_a_day(spark, n), ndigits=None).drop("r_squared").collect())) for n in (1, 4, 7)]
    digits = [series.time_series_analysis(ten_a_day(spark, n), ndigits=6).orderBy("position").collect() for n in (1, 4, 7)]
    assert digits[0] == digits[1] == digits[2] and len(answers[0]) == 2
    pdf = ten_a_day(spark, 1).toPandas().sort_values(["t", "v", "k"], na_position="last")
    v = pdf["v"].dropna().to_numpy()
    assert digits[0][0]["column"] == "v" and digits[0][0]["slope"] == pytest.approx(np.polyfit(np.arange(len(v)), v, 1)[0], abs=1e-6)


def test_equal_times_give_one_model_matrix(spark):
    got = []
    for n in (1, 4, 7):
        df = ten_a_day(spark, n)
        made = features.engineer_features(df, problem.Problem("time_series", "v", ["k", "g"], time_column="t"), scale=False).matrix
        got.append(sorted(map(str, made.collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == 200


def test_positions_count_values_only(spark):
    df = ten_a_day(spark, 5)
    placed = series.positioned_series(df, ["t", "k"], ["v", "k"]).collect()
    pdf = df.toPandas().sort_values(["t", "k"])
    for name in ("v", "k"):
        want = pdf[name].dropna().tolist()
        assert [r["value"] for r in sorted((r for r in placed if r["column"] == name), key=lambda r: r["pos"])] == want
        assert sorted(r["pos"] for r in placed if r["column"] == name) == list(range(len(want)))


def test_autocorrelation_sends_a_row_a_block(spark):
    """No window with a function a lag: a block gives its products in one row, also one that only borrows."""
    placed = series.positioned_series(timed(spark, [math.sin(i / 3) for i in range(400)]), ["t", "id"], ["v"])
    found = series.autocorrelation(placed, 20, block_rows=100)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    s = pd.Series([math.sin(i / 3) for i in range(400)])
    for r in found.collect():
        assert r["r"] == pytest.approx(s.autocorr(r["lag"]), abs=1e-9)
