"""Segments: categories that separate a number, skewed splits and outlier groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import classify_columns, col, per_column, rounded, sample_skewness, union_all
from ..functions.counts import gate
from ..session import materialise
from .bivariate import group_table
from .univariate import numeric_frame, quartiles, whiskers

MAX_DISTINCT = 15
MIN_GROUP = 5
MIN_EFFECT = 0.3
MIN_SKEW = 1.0
MIN_VALUES = 10
SEGMENT_SCHEMA = (
    "type string, split_column string, column string, effect_size double, groups bigint, "
    "threshold double, skewness double, below_median_count bigint, above_median_count bigint, "
    "outlier_count bigint, outlier_pct double, lower_bound double, upper_bound double"
)


def categorical_segments(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    numbers: Sequence[str] | None = None,
    max_distinct: int = MAX_DISTINCT,
    min_group: int = MIN_GROUP,
    min_effect: float = MIN_EFFECT,
    ndigits: int | None = 4,
    groups: DataFrame | None = None,
    domains: dict[str, dict[str, int]] | None = None,
) -> DataFrame:
    """Splits whose group means spread over at least ``min_effect`` overall deviations.

    One row per split and group, strongest split first; ``effect_size`` repeats. ``groups``
    and ``domains`` may pass a ready ``group_table`` and a ``small_domains`` of a wider gate.
    """
    classes = classify_columns(df)
    categories = list(classes.categorical if categories is None else categories)
    numbers = list(classes.numeric if numbers is None else numbers)
    gated = [c for c, v in gate(df, categories, max_distinct, domains).items() if len(v) >= 2]
    schema = (
        "split_column string, target_column string, effect_size double, "
        "group string, group_mean double, group_count bigint"
    )
    if not gated or not numbers:
        return df.sparkSession.createDataFrame([], schema)
    if groups is None:
        groups = group_table(df, gated, numbers, with_median=False)
    groups = groups.where(F.col("category").isin(gated)).select(
        "category", "number", "group", "mean", "count"
    )
    overall = per_column(
        numeric_frame(df, numbers), numbers, lambda n: {"std": F.stddev_samp(col(n))}
    ).select(F.col("column").alias("number"), "std")
    effects = (
        groups.groupBy("category", "number")
        .agg(
            F.max("count").alias("largest"),
            (F.max("mean") - F.min("mean")).alias("spread"),
        )
        .join(F.broadcast(overall), "number")
        .where((F.col("largest") >= min_group) & (F.col("std") > 0))
        .withColumn("effect", F.try_divide("spread", "std"))
        .where(F.col("effect") >= min_effect)
        .select("category", "number", rounded(F.col("effect"), ndigits).alias("effect_size"))
    )
    return (
        groups.join(F.broadcast(effects), ["category", "number"])
        .select(
            F.col("category").alias("split_column"),
            F.col("number").alias("target_column"),
            "effect_size",
            "group",
            rounded(F.col("mean"), ndigits).alias("group_mean"),
            F.col("count").alias("group_count"),
        )
        .orderBy(F.desc("effect_size"), "split_column", "target_column", "group")
    )


def _numeric_segments(df: DataFrame, numbers: Sequence[str], known_quartiles=None) -> DataFrame:
    """Count, skewness, halves around the median and outliers per column, in one scan."""
    q = known_quartiles or quartiles(df, numbers)

    def lit(v) -> Column:
        return F.lit(v).cast("double")

    def stats(c: str) -> dict[str, Column]:
        x = col(c)
        low, high = whiskers(q[c][1])
        return {
            "count": F.count(x),
            "skew": sample_skewness(x),
            "below": F.count(F.when(x <= lit(q[c][1][1]), 1)),
            "above": F.count(F.when(x > lit(q[c][1][1]), 1)),
            "outliers": F.count(F.when((x < lit(low)) | (x > lit(high)), 1)),
        }

    def carry(c: str) -> dict[str, Column]:
        low, high = whiskers(q[c][1])
        return {"median": lit(q[c][1][1]), "lower": lit(low), "upper": lit(high)}

    return per_column(numeric_frame(df, numbers), numbers, stats, carry).where(
        F.col("count") >= MIN_VALUES
    )


def _skewed(stats: DataFrame, min_skew: float, ndigits: int | None) -> DataFrame:
    return (
        stats.where(F.abs("skew") >= min_skew)
        .select(
            "column",
            F.col("median").alias("threshold"),
            rounded(F.col("skew"), ndigits).alias("skewness"),
            F.col("below").alias("below_median_count"),
            F.col("above").alias("above_median_count"),
        )
    )


def _outlying(stats: DataFrame, ndigits: int | None) -> DataFrame:
    return (
        stats.where("outliers > 0")
        .select(
            "column",
            F.col("outliers").alias("outlier_count"),
            F.round(F.col("outliers") / F.col("count") * 100, 2).alias("outlier_pct"),
            rounded(F.col("lower"), ndigits).alias("lower_bound"),
            rounded(F.col("upper"), ndigits).alias("upper_bound"),
        )
    )


def skew_split(
    df: DataFrame,
    numbers: Sequence[str] | None = None,
    min_skew: float = MIN_SKEW,
    ndigits: int | None = 4,
    known_quartiles=None,
) -> DataFrame:
    """Strongly skewed columns split at their median."""
    numbers = list(classify_columns(df).numeric if numbers is None else numbers)
    return _skewed(_numeric_segments(df, numbers, known_quartiles), min_skew, ndigits)


def outlier_segments(
    df: DataFrame,
    numbers: Sequence[str] | None = None,
    ndigits: int | None = 4,
    known_quartiles=None,
) -> DataFrame:
    """Columns with values outside the IQR bounds, with their count and share."""
    numbers = list(classify_columns(df).numeric if numbers is None else numbers)
    return _outlying(_numeric_segments(df, numbers, known_quartiles), ndigits)


def detect_segments(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    numbers: Sequence[str] | None = None,
    ndigits: int | None = 4,
    groups: DataFrame | None = None,
    known_quartiles=None,
    domains: dict[str, dict[str, int]] | None = None,
) -> DataFrame:
    """All segment kinds in one table, one row per segment; one scan serves both numeric kinds."""
    numbers = list(classify_columns(df).numeric if numbers is None else numbers)
    splits = (
        categorical_segments(df, categories, numbers, ndigits=ndigits, groups=groups, domains=domains)
        .groupBy("split_column", "target_column", "effect_size")
        .agg(F.count("*").alias("groups"))
        .select(
            F.lit("categorical_split").alias("type"),
            "split_column",
            F.col("target_column").alias("column"),
            "effect_size",
            "groups",
        )
    )
    if not numbers:
        return df.sparkSession.createDataFrame([], SEGMENT_SCHEMA)
    # A row a column.
    stats = materialise(_numeric_segments(df, numbers, known_quartiles).repartition(1), "numeric_segments")
    skew, outliers = _skewed(stats, MIN_SKEW, ndigits), _outlying(stats, ndigits)
    return union_all(
        [
            splits,
            skew.select(F.lit("numeric_threshold").alias("type"), "*"),
            outliers.select(F.lit("outlier_segment").alias("type"), "*"),
        ]
    )
