import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions import quantiles as Q

PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def check(spark, values, **tuning):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double").repartition(5)
    n, got = Q.column_quantiles(df, ["v"], PROBS, **tuning)["v"]
    s = pd.Series([v for v in values if v is not None], dtype=float).dropna()
    assert n == len(s)
    assert got == pytest.approx([s.quantile(p) for p in PROBS], abs=1e-9)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 9, 10])
def test_tiny(spark, n):
    check(spark, list(np.random.default_rng(n).normal(size=n)) + [None, float("nan")])


def test_ties_and_narrowing(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 5, 3000), rng.exponential(10, 6000)])
    check(spark, list(values))
    check(spark, list(values), rankable_rows=20, unbracketed_rows=0)


def test_missed_brackets_are_moved(spark, monkeypatch):
    monkeypatch.setattr(Q, "SLACK", 1e-9)
    monkeypatch.setattr(Q, "SKETCH_K", 8)
    check(spark, list(np.random.default_rng(2).normal(size=20_000)), unbracketed_rows=0)


def test_hot_group(spark):
    rng = np.random.default_rng(3)
    g = np.where(rng.random(9000) < 0.4, "hot", rng.integers(0, 6, 9000).astype(str))
    pdf = pd.DataFrame({"g": g, "a": rng.normal(size=9000), "b": rng.integers(0, 9, 9000).astype(float)})
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("g") != "3", F.col("b")))
    got = Q.exact_quantiles(df, ["a", "b"], (0.25, 0.5), keys=["g"], rankable_rows=30, unbracketed_rows=100)
    for key, part in pdf.groupby("g"):
        counts, (a, b) = got[(key,)]
        assert a == pytest.approx(list(part["a"].quantile([0.25, 0.5])))
        if key == "3":
            assert counts[1] == 0 and b == [None, None]
        else:
            assert b == list(part["b"].quantile([0.25, 0.5]))


def test_all_null_and_infinite(spark):
    df = spark.createDataFrame([(None, float("inf")), (None, 1.0), (None, float("-inf"))], "a double, b double")
    got = Q.column_quantiles(df, ["a", "b"], (0.5,))
    assert got["a"] == (0, [None]) and got["b"] == (3, [1.0])


def test_long_ranks(spark):
    df = spark.range(10_000).select(F.xxhash64("id").alias("h"))
    values = sorted(r[0] for r in df.collect())
    got = Q.ranked_values(df, ["h"], [0.2], lambda p, n: (1999, 1999), unbracketed_rows=0, rankable_rows=5)
    assert got[()][1][0][0] == (values[1999], values[1999])
