"""Per-column statistics for numeric, categorical and datetime columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    as_double,
    classify_columns,
    col,
    epoch_micros,
    missing_as_null,
    per_column,
    rounded,
    sample_kurtosis,
    sample_skewness,
    union_all,
)
from ..functions.counts import column_modes, top_ranked, value_counts
from ..functions.order import dense_position, neighbours, with_halo
from ..functions.quantiles import column_quantiles

QUARTILES = (0.25, 0.5, 0.75)
WHISKER = 1.5
ALL_NULL = "all values are null"


def numeric_frame(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The numeric columns as doubles, NaN turned into null."""
    return missing_as_null(df.select(*[as_double(c).alias(c) for c in columns]))


def quartiles(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, list[float | None]]]:
    """Exact q1, median, q3 per column, with the non-null count."""
    return column_quantiles(df, columns, QUARTILES)


def whiskers(q: Sequence[float | None]) -> tuple[float | None, float | None]:
    if q[0] is None:
        return None, None
    iqr = q[2] - q[0]
    return q[0] - WHISKER * iqr, q[2] + WHISKER * iqr


def _literal(v: float | None) -> Column:
    return F.lit(v).cast("double")


def _number(name: str) -> Column:
    """Null instead of NaN: what infinite values leave undefined."""
    return F.nanvl(F.col(name), F.lit(None).cast("double"))


def numeric_univariate(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    ndigits: int | None = 4,
    known_quartiles: dict | None = None,
) -> DataFrame:
    """One row per numeric column: moments, quartiles, IQR bounds and outlier count.

    The quartiles are found first; the remaining statistics and the outlier count, whose
    bounds are then literals, come from one scan.
    """
    columns = list(classify_columns(df).numeric if columns is None else columns)
    values = numeric_frame(df, columns)
    q = known_quartiles or quartiles(df, columns)

    def stats(c: str) -> dict[str, Column]:
        x = col(c)
        low, high = whiskers(q[c][1])
        return {
            "count": F.count(x),
            "mean": F.avg(x),
            "std": F.stddev_samp(x),
            "skewness": sample_skewness(x),
            "kurtosis": sample_kurtosis(x),
            "min": F.min(x),
            "max": F.max(x),
            "outlier_count": F.count(F.when((x < _literal(low)) | (x > _literal(high)), 1)),
        }

    def carry(c: str) -> dict[str, Column]:
        q1, median, q3 = q[c][1]
        low, high = whiskers(q[c][1])
        return {
            "median": _literal(median),
            "q1": _literal(q1),
            "q3": _literal(q3),
            "lower": _literal(low),
            "upper": _literal(high),
        }

    s = per_column(values, columns, stats, carry)
    known = F.col("count") > 0
    return s.select(
        "position",
        "column",
        F.when(known, F.col("count")).alias("count"),
        rounded(_number("mean"), ndigits).alias("mean"),
        rounded(F.col("median"), ndigits).alias("median"),
        rounded(_number("std"), ndigits).alias("std"),
        rounded(_number("skewness"), ndigits).alias("skewness"),
        rounded(_number("kurtosis"), ndigits).alias("kurtosis"),
        "min",
        "max",
        rounded(F.col("q1"), ndigits).alias("q1"),
        rounded(F.col("q3"), ndigits).alias("q3"),
        rounded(F.col("q3") - F.col("q1"), ndigits).alias("iqr"),
        rounded(F.col("lower"), ndigits).alias("outlier_lower_bound"),
        rounded(F.col("upper"), ndigits).alias("outlier_upper_bound"),
        F.when(known, F.col("outlier_count")).alias("outlier_count"),
        rounded(
            F.when(F.col("mean") != 0, F.try_divide(_number("std"), _number("mean"))), ndigits
        ).alias("cv"),
        F.when(~known, F.lit(ALL_NULL)).alias("error"),
    )


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, ndigits: int | None = 4
) -> DataFrame:
    """Values strictly outside q1 - 1.5 iqr and q3 + 1.5 iqr, per column."""
    columns = list(classify_columns(df).numeric if columns is None else columns)
    q = quartiles(df, columns)

    def stats(c: str) -> dict[str, Column]:
        low, high = whiskers(q[c][1])
        x = col(c)
        return {
            "count": F.count(x),
            "outlier_count": F.count(F.when((x < _literal(low)) | (x > _literal(high)), 1)),
        }

    def carry(c: str) -> dict[str, Column]:
        low, high = whiskers(q[c][1])
        return {
            "lower_bound": rounded(_literal(low), ndigits),
            "upper_bound": rounded(_literal(high), ndigits),
        }

    out = per_column(numeric_frame(df, columns), columns, stats, carry)
    return out.where("count > 0").select(
        "column", "count", "lower_bound", "upper_bound", "outlier_count"
    )


def categorical_univariate(
    df: DataFrame, columns: Sequence[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """One row per categorical column: count, cardinality, mode and its share."""
    columns = list(classify_columns(df).categorical if columns is None else columns)
    if counts is None:
        counts = value_counts(df, columns)
    names = df.sparkSession.createDataFrame(
        list(enumerate(columns)), "position int, column string"
    )
    modes = column_modes(df, counts.where(F.col("column").isin(columns)))
    return (
        names.join(F.broadcast(modes), "column", "left")
        .select(
            "position",
            "column",
            F.col("non_null").alias("count"),
            "cardinality",
            "mode",
            "mode_frequency",
            F.round(F.col("mode_frequency") / F.col("non_null") * 100, 2).alias("mode_pct"),
            F.when(F.col("non_null").isNull(), F.lit(ALL_NULL)).alias("error"),
        )
    )


def top_values(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    top_n: int = 10,
    counts: DataFrame | None = None,
) -> DataFrame:
    """The most frequent values of each column, ties by value."""
    columns = list(classify_columns(df).categorical if columns is None else columns)
    if counts is None:
        counts = value_counts(df, columns)
    return top_ranked(df, counts.where(F.col("column").isin(columns)), top_n)


def gap_text(micros: Column) -> Column:
    """Microseconds as ``D days HH:MM:SS`` with a six-digit fraction when there is one."""
    seconds = F.floor(micros / 1_000_000)
    fraction = F.pmod(micros, F.lit(1_000_000))
    clock = F.format_string(
        "%d days %02d:%02d:%02d",
        F.floor(seconds / 86400),
        F.floor(F.pmod(seconds, F.lit(86400)) / 3600),
        F.floor(F.pmod(seconds, F.lit(3600)) / 60),
        F.pmod(seconds, F.lit(60)),
    )
    return F.when(fraction == 0, clock).when(
        fraction > 0, F.concat(clock, F.format_string(".%06d", fraction))
    )


def datetime_univariate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per datetime column: range, gaps and the dominant gap between values.

    Equal times are combined first, so a hot timestamp is one row; gaps are then taken
    between consecutive distinct times, and repeats count as gaps of zero.
    """
    columns = list(classify_columns(df).datetime if columns is None else columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    long = df.select(*[epoch_micros(c, types[c]).alias(c) for c in columns]).unpivot(
        [], [col(c) for c in columns], "column", "value"
    )
    distinct = (
        long.where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("repeats"))
    )
    placed = dense_position(distinct, ["value"], within=["column"])
    blocks = with_halo(placed, 1)
    stepped = blocks.withColumn(
        "gap", F.col("value") - F.lag("value").over(neighbours(["column"]))
    ).where(~F.col("_halo"))
    between = stepped.where(F.col("gap").isNotNull()).groupBy("column", "gap").agg(
        F.count("*").alias("times")
    )
    zero = (
        placed.groupBy("column")
        .agg(F.sum(F.col("repeats") - 1).alias("times"))
        .where("times > 0")
        .select("column", F.lit(0).cast("bigint").alias("gap"), "times")
    )
    gaps = union_all([between, zero])
    dominant = gaps.groupBy("column").agg(
        F.min_by("gap", F.struct(-F.col("times"), F.col("gap"))).alias("gap")
    )

    def stats(c: str) -> dict[str, Column]:
        return {
            "rows": F.count(F.lit(1)),
            "count": F.count(col(c)),
            "min": F.min(col(c)).cast("string"),
            "max": F.max(col(c)).cast("string"),
            "range_days": F.floor(
                (F.max(epoch_micros(c, types[c])) - F.min(epoch_micros(c, types[c]))) / 86_400_000_000
            ),
        }

    base = per_column(df, columns, stats)
    known = F.col("count") > 0
    return base.join(F.broadcast(dominant), "column", "left").select(
        "column",
        F.when(known, F.col("count")).alias("count"),
        "min",
        "max",
        "range_days",
        (F.col("rows") - F.col("count")).alias("null_count"),
        F.when(known, F.coalesce(gap_text(F.col("gap")), F.lit("single value"))).alias(
            "inferred_frequency"
        ),
        F.when(~known, F.lit(ALL_NULL)).alias("error"),
    )
