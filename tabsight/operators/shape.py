"""Distribution shape: histogram, normality and a label."""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    classify_columns,
    col,
    per_column,
    rounded,
    sample_kurtosis,
    sample_skewness,
)
from ..functions.normal import normal_quantiles
from ..functions.order import totals_before
from ..session import materialise, ship_functions_of, spread
from .univariate import numeric_frame, quartiles

ship_functions_of(__name__)

NORMAL_P = 0.05
MIN_VALUES = 8
# Royston's AS R94 (1995), the highest power first: corrections of the last weight and of the
# one before it, mean and log spread of W's transform up to 11 values and above, the most values fitted.
ROYSTON_LAST = [-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0]
ROYSTON_LAST_BUT_ONE = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
ROYSTON_FEW_MEAN = [-0.0006714, 0.025054, -0.39978, 0.544]
ROYSTON_FEW_SPREAD = [-0.0020322, 0.062767, -0.77857, 1.3822]
ROYSTON_MEAN = [0.0038915, -0.083751, -0.31082, -1.5861]
ROYSTON_SPREAD = [0.0030302, -0.082676, -0.4803]
ROYSTON_LARGEST = 5000
# Places of one value that are scored from one row, at most, and about the places scored at once.
RUN_RANKS, BLOCK_RANKS = 4096, 1 << 18
# Stands for the bin of infinite values while they are counted.
ENDLESS = -1


def auto_bins(
    df: DataFrame, columns: Sequence[str], known_quartiles: dict | None = None
) -> dict[str, tuple[float, float, int]]:
    """Lowest value, highest value and number of equal bins per (non-empty) column.

    Infinite values are left out. The bin width is the smaller of Freedman-Diaconis and Sturges, where the former is
    at least half the square-root rule; whole-number columns have no bin below one.
    """
    q = known_quartiles or quartiles(df, columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    rows = per_column(
        finite_frame(df, columns),
        columns,
        lambda c: {"n": F.count(col(c)), "lo": F.min(col(c)), "hi": F.max(col(c))},
    ).collect()
    out = {}
    for r in rows:
        c, n = r["column"], r["n"]
        if not n:
            continue
        q1, _, q3 = q[c][1]
        reach = r["hi"] - r["lo"]
        sturges = reach / (math.log2(n) + 1.0)
        freedman = max(2.0 * (q3 - q1) * n ** (-1.0 / 3.0), reach / math.sqrt(n) / 2)
        # Infinite quartiles say nothing of the finite values' spread.
        width = min(freedman, sturges) if math.isfinite(freedman) else sturges
        if isinstance(types[c], (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and 0 < width < 1:
            width = 1.0
        # Bins and their counts are at most 2 sqrt(n) rows per column.
        out[c] = (r["lo"], r["hi"], math.ceil(reach / width) if width > 0 else 1)
    return out


def binned_counts(
    df: DataFrame, edges: dict[str, tuple[float, float, int]]
) -> DataFrame:
    """``(column, bin, count)`` with empty bins, for given ``(low, high, bins)``.

    A value on an inner edge belongs to the bin it opens; the top value to the last bin.
    Infinite values are counted in a row of their own, without bin, if there are any.
    """
    spark = df.sparkSession
    columns = list(edges)
    if not columns:
        return spark.createDataFrame([], "column string, bin bigint, low double, high double, count bigint")
    values = numeric_frame(df, columns)
    endless = float("inf")
    shown = []
    for c in columns:
        lo, hi, bins = edges[c]
        reach = hi - lo
        finite = F.when(F.abs(col(c)) < endless, col(c))
        at = F.floor((finite - F.lit(lo)) * F.lit(float(bins)) / F.lit(reach if reach else 1.0))
        # ``least`` passes over nulls, so a missing value is kept out explicitly.
        inside = F.when(at.isNotNull(), F.least(at, F.lit(bins - 1).cast("bigint")))
        shown.append(F.when(F.abs(col(c)) == endless, F.lit(ENDLESS).cast("bigint")).otherwise(inside).alias(c))
    counted = (
        values.select(*shown)
        .unpivot([], [col(c) for c in columns], "column", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count("*").alias("count"))
    )
    frame = spark.createDataFrame(
        [(c, float(lo), float(hi), int(bins)) for c, (lo, hi, bins) in edges.items()],
        "column string, _lo double, _hi double, _bins bigint",
    )
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    every = frame.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_bins") - 1)).alias("bin")
    ).select(
        "column",
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"),
    )
    nothing = F.lit(None).cast("double")
    apart = counted.where(F.col("bin") == ENDLESS).select(
        "column", F.lit(None).cast("bigint").alias("bin"), nothing.alias("low"), nothing.alias("high"), "count"
    )
    return (
        every.join(counted, ["column", "bin"], "left")
        .select("column", "bin", "low", "high", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))
        .unionByName(apart)
    )


def auto_histogram(
    df: DataFrame, columns: Sequence[str] | None = None, known_quartiles: dict | None = None
) -> DataFrame:
    """Histogram with automatic bins, for every numeric column."""
    columns = list(classify_columns(df).numeric if columns is None else columns)
    return binned_counts(df, auto_bins(df, columns, known_quartiles))


def histogram_peaks(histogram: DataFrame) -> DataFrame:
    """Bins and strict interior local maxima per column; two peaks make it multimodal."""
    order = Window.partitionBy("column").orderBy("bin")
    c = F.col("count")
    peak = (c > F.lag("count").over(order)) & (c > F.lead("count").over(order))
    return (
        histogram.where(F.col("bin").isNotNull()).withColumn("_peak", F.coalesce(peak, F.lit(False)))
        .groupBy("column")
        .agg(F.count("*").alias("bins"), F.count_if("_peak").alias("peaks"))
        .withColumn("is_multimodal", F.col("peaks") >= 2)
    )


def finite_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The numeric columns as doubles; NaN and infinities turned into null."""
    return numeric_frame(df, columns).select(*[F.when(F.abs(col(c)) < float("inf"), col(c)).alias(c) for c in columns])


def normality_test(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """K-squared test of all finite values of each column, from one scan: the sum of
    the squared normal scores of skewness (D'Agostino) and kurtosis (Anscombe and Glynn),
    whose upper tail is exp(-K2 / 2). Null for fewer than eight values or without variance.
    """
    columns = list(classify_columns(df).numeric if columns is None else columns)
    moments = per_column(
        finite_frame(df, columns),
        columns,
        lambda c: {"n": F.count(col(c)), "g1": F.skewness(col(c)), "g2": F.kurtosis(col(c)), "lo": F.min(col(c)), "hi": F.max(col(c))},
    )
    n = F.col("n").cast("double")
    # Skewness: a Johnson curve of the symmetric kind.
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    # Kurtosis: a cube root of its standardised value.
    centre = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("g2") + 3 - centre) / F.sqrt(spread)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    below = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(below) * F.cbrt(F.try_divide(1 - 2 / a, F.abs(below)))) / F.sqrt(2 / (9 * a))
    fits = (F.col("n") >= MIN_VALUES) & (F.col("lo") < F.col("hi"))
    tested = moments.withColumn("k2", F.when(fits, z1 * z1 + z2 * z2))
    p = F.exp(-F.col("k2") / 2)
    return tested.select(
        "column", "n", F.round("k2", 3).alias("k2"), F.round(p, 6).alias("p_value"), (p > NORMAL_P).alias("is_normal")
    )


def shapiro_wilk(df: DataFrame, columns: Sequence[str] | None = None, ndigits: int | None = 6) -> DataFrame:
    """``(column, n, w, z, p_value, is_normal, fitted)``: the Shapiro-Wilk test over all finite values
    of each column, with Royston's (1995) weights and distribution of W.

    Equal values are counted first and each different one is sorted once: the rows before it are
    the first of its places. Every place's expected normal score is an expression of place and size,
    so W follows from a few sums by column; the places of a value are
    dealt over all cores in runs. W is right for any
    size; Royston fitted its distribution to 5,000 values, so above that ``fitted`` is false and
    z and p go by his curve drawn on. Null for fewer than eight values or without variance.
    """
    columns = list(classify_columns(df).numeric if columns is None else columns)
    spark = df.sparkSession
    schema = "column string, n bigint, w double, z double, p_value double, is_normal boolean, fitted boolean"
    if not columns:
        return spark.createDataFrame([], schema)
    names = [f"v{i}" for i in range(len(columns))]
    long = finite_frame(df, columns).toDF(*names).unpivot([], names, "_column", "_x").where("_x IS NOT NULL")
    # Saved, as the sort reads its rows twice.
    counted = materialise(long.groupBy("_column", "_x").agg(F.count("*").alias("_c")), "counted")
    placed = totals_before(counted, ["_column", "_x"], "_c", "_at")
    sizes = placed.groupBy("_column").agg(
        F.sum("_c").alias("n"), (F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("_mean"),
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.min("_at").alias("_start"),
    )
    # One row a column.
    ranked = placed.join(F.broadcast(sizes), "_column").withColumn("_at", F.col("_at") - F.col("_start"))
    run = F.lit(RUN_RANKS).cast("bigint")
    cut = ranked.withColumn("_end", F.col("_at") + F.col("_c")).withColumn("_first", F.explode(F.sequence("_at", F.col("_end") - 1, run)))
    runs = cut.select(
        "_column", "n", "_lo", "_hi", (F.col("_x") - F.col("_mean")).alias("_d"), "_x", "_first", F.least(run, F.col("_end") - F.col("_first")).alias("_c")
    )
    total = counted.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    dealt = spread(runs, total)
    scored = dealt.mapInArrow(_with_scores, T.StructType([*dealt.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("_m", "_mm")]]))

    def at(place):
        return F.max(F.when((F.col("_first") <= place) & (place < F.col("_first") + F.col("_c")), F.col("_x")))

    sums = scored.groupBy("_column", "n", "_lo", "_hi").agg(
        F.sum("_mm").alias("mm"),
        F.sum(F.col("_m") * F.col("_d")).alias("mx"),
        F.sum(F.col("_d") * F.col("_d") * F.col("_c")).alias("ss"),
        at(F.lit(1)).alias("second"),
        at(F.col("n") - 2).alias("last_but_one"),
    )
    # One row a column.
    found = {r["_column"]: r for r in sums.collect()}

    def shown(v: float | None) -> float | None:
        return v if v is None or ndigits is None else round(v, ndigits)

    rows = []
    for name, c in zip(names, columns):
        n = found[name]["n"] if name in found else 0
        w, z = _royston(found[name]) if n >= MIN_VALUES and found[name]["_lo"] < found[name]["_hi"] else (None, None)
        p = None if z is None else math.erfc(z / math.sqrt(2)) / 2
        rows.append((c, n, shown(w), shown(z), shown(p), None if p is None else p > NORMAL_P, n <= ROYSTON_LARGEST))
    return spark.createDataFrame(rows, schema)


def _with_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of places with the sum of their expected normal scores and of the squares of these."""
    for batch in batches:
        n, first, each = (batch.column(c).to_numpy() for c in ("n", "_first", "_c"))
        until = np.cumsum(each)
        held = [0, *(np.flatnonzero(np.diff(until // BLOCK_RANKS)) + 1).tolist(), len(each)]
        sums = np.zeros((2, len(each)))
        for lo, hi in zip(held, held[1:]):
            if lo == hi:
                continue
            starts = until[lo:hi] - each[lo:hi] - (until[lo] - each[lo])
            place = np.arange(until[hi - 1] - until[lo] + each[lo]) + np.repeat(first[lo:hi] - starts, each[lo:hi])
            m = normal_quantiles((place + 0.625) / (np.repeat(n[lo:hi], each[lo:hi]) + 0.25))
            sums[0, lo:hi], sums[1, lo:hi] = np.add.reduceat(m, starts), np.add.reduceat(m * m, starts)
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums)], [*batch.schema.names, "_m", "_mm"])


def _royston(sums: Row) -> tuple[float, float]:
    """W and its normal score from the sums of one column."""
    n, mm = sums["n"], sums["mm"]

    def value(x: float, coefficients: Sequence[float]) -> float:
        return reduce(lambda so_far, c: so_far * x + c, coefficients)

    outer, inner = (statistics.NormalDist().inv_cdf((n - back) / (n + 0.25)) for back in (0.375, 1.375))
    a = outer / math.sqrt(mm) + value(1 / math.sqrt(n), ROYSTON_LAST)
    b = inner / math.sqrt(mm) + value(1 / math.sqrt(n), ROYSTON_LAST_BUT_ONE)
    wing, arm = sums["_hi"] - sums["_lo"], sums["last_but_one"] - sums["second"]
    phi = (mm - 2 * outer**2 - 2 * inner**2) / (1 - 2 * a**2 - 2 * b**2)
    line = a * wing + b * arm + (sums["mx"] - outer * wing - inner * arm) / math.sqrt(phi)
    w = min(line * line / sums["ss"], 1.0)
    if w == 1.0:
        return w, -math.inf
    beyond = math.log(1 - w)
    if n <= 11:
        few = -math.log(0.459 * n - 2.273 - beyond)
        return w, (few - value(n, ROYSTON_FEW_MEAN)) / math.exp(value(n, ROYSTON_FEW_SPREAD))
    return w, (beyond - value(math.log(n), ROYSTON_MEAN)) / math.exp(value(math.log(n), ROYSTON_SPREAD))


def classify_distribution(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    ndigits: int | None = 4,
    known_quartiles: dict | None = None,
) -> DataFrame:
    """Shape label per numeric column from normality, peaks, skewness and kurtosis."""
    columns = list(classify_columns(df).numeric if columns is None else columns)
    q = known_quartiles or quartiles(df, columns)
    moments = per_column(
        finite_frame(df, columns),
        columns,
        lambda c: {
            "count": F.count(col(c)),
            "skew": sample_skewness(col(c)),
            "kurt": sample_kurtosis(col(c)),
        },
    )
    peaks = histogram_peaks(auto_histogram(df, columns, q)).select("column", "is_multimodal")
    normal = normality_test(df, columns).select("column", "p_value", "is_normal")
    multimodal = F.coalesce("is_multimodal", F.lit(False))
    label = (
        F.when(F.col("count") < MIN_VALUES, "insufficient_data")
        .when(F.coalesce("is_normal", F.lit(False)) & ~multimodal, "normal")
        .when(multimodal, "multimodal")
        .when(
            F.abs("skew") < 0.5,
            F.when(F.col("kurt") > 2, "heavy_tailed")
            .when(F.col("kurt") < -1, "light_tailed")
            .otherwise("approximately_normal"),
        )
        .when(F.col("skew") >= 0.5, "right_skewed")
        .otherwise("left_skewed")
    )
    enough = F.col("count") >= MIN_VALUES
    return (
        moments.join(F.broadcast(peaks), "column", "left")
        .join(F.broadcast(normal), "column", "left")
        .select(
            "position",
            "column",
            label.alias("distribution_type"),
            rounded(F.when(enough, F.col("skew")), ndigits).alias("skewness"),
            rounded(F.when(enough, F.col("kurt")), ndigits).alias("kurtosis"),
            F.when(enough, F.col("p_value")).alias("normality_p_value"),
            F.when(enough, multimodal).alias("is_multimodal"),
        )
    )
