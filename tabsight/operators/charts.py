"""Chart data, aggregated before it leaves the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import classify_columns, col, per_column, rounded, union_all
from ..functions.quantiles import exact_quantiles
from .bivariate import correlation_matrix, grouped_values
from .shape import binned_counts, finite_frame
from .univariate import QUARTILES, categorical_univariate, numeric_frame, quartiles, top_values, whiskers

HISTOGRAM_BINS = 30
SCATTER_BINS = 40
BAR_VALUES = 15
PIE_MAX = 8
TOP_FEATURES = 15


def _lit(v) -> Column:
    return F.lit(v).cast("double")


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    rows = per_column(
        finite_frame(df, columns), columns, lambda c: {"lo": F.min(col(c)), "hi": F.max(col(c))}
    ).collect()
    return {r["column"]: (r["lo"], r["hi"]) for r in rows if r["lo"] is not None}


def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Equal-width bins of each numeric column (one bin if it does not vary)."""
    columns = list(classify_columns(df).numeric if columns is None else columns)
    edges = {c: (lo, hi, bins if hi > lo else 1) for c, (lo, hi) in _ranges(df, columns).items()}
    return binned_counts(df, edges)


def box_plot(
    df: DataFrame, columns: Sequence[str] | None = None, ndigits: int | None = 4, known_quartiles=None
) -> DataFrame:
    """Quartiles, whisker ends (extremes inside the IQR bounds) and outliers per column."""
    columns = list(classify_columns(df).numeric if columns is None else columns)
    q = known_quartiles or quartiles(df, columns)

    def stats(c: str) -> dict[str, Column]:
        low, high = whiskers(q[c][1])
        inside = (col(c) >= _lit(low)) & (col(c) <= _lit(high))
        return {
            "count": F.count(col(c)),
            "whisker_low": F.min(F.when(inside, col(c))),
            "whisker_high": F.max(F.when(inside, col(c))),
            "outlier_count": F.count(F.when(~inside, 1)),
        }

    def carry(c: str) -> dict[str, Column]:
        return {n: rounded(_lit(v), ndigits) for n, v in zip(("q1", "median", "q3"), q[c][1])}

    out = per_column(numeric_frame(df, columns), columns, stats, carry)
    return out.where("count > 0").select(
        "column", "count", "q1", "median", "q3", "whisker_low", "whisker_high", "outlier_count"
    )


def box_outliers(df: DataFrame, columns: Sequence[str] | None = None, known_quartiles=None) -> DataFrame:
    """Outlier points of the box plots, equal values combined: ``(column, value, count)``."""
    columns = list(classify_columns(df).numeric if columns is None else columns)
    q = known_quartiles or quartiles(df, columns)
    shown = []
    for c in columns:
        low, high = whiskers(q[c][1])
        shown.append(F.when((col(c) < _lit(low)) | (col(c) > _lit(high)), col(c)).alias(c))
    return (
        numeric_frame(df, columns)
        .select(*shown)
        .unpivot([], [col(c) for c in columns], "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("count"))
    )


def heatmap(
    df: DataFrame, columns: Sequence[str] | None = None, ndigits: int = 3, correlations: DataFrame | None = None
) -> DataFrame:
    """Full symmetric correlation matrix as ``(x, y, r)``; ``correlations`` may pass a saved
    ``correlation_matrix`` of the columns."""
    columns = list(classify_columns(df).numeric if columns is None else columns)
    upper = (correlation_matrix(df, columns) if correlations is None else correlations).select("a", "b", F.round("r", ndigits).alias("r"))
    varies = per_column(
        numeric_frame(df, columns), columns, lambda c: {"lo": F.min(col(c)), "hi": F.max(col(c))}
    )
    diagonal = varies.select(
        F.col("column").alias("x"),
        F.col("column").alias("y"),
        F.when(F.col("hi") > F.col("lo"), F.lit(1.0)).alias("r"),
    )
    return union_all(
        [
            upper.select(F.col("a").alias("x"), F.col("b").alias("y"), "r"),
            upper.select(F.col("b").alias("x"), F.col("a").alias("y"), "r"),
            diagonal,
        ]
    )


def bar(
    df: DataFrame, columns: Sequence[str] | None = None, n: int = BAR_VALUES, counts: DataFrame | None = None
) -> DataFrame:
    """Most frequent values of each categorical column."""
    return top_values(df, columns, n, counts)


def scatter(df: DataFrame, x: str, y: str, bins: int = SCATTER_BINS) -> DataFrame:
    """All complete points of a pair, counted on a two-dimensional grid."""
    # A point is drawn if both values are present and finite; only those span the grid.
    points = finite_frame(df, [x, y]).where(col(x).isNotNull() & col(y).isNotNull())
    ranges = _ranges(points, [x, y])
    schema = "x_bin bigint, y_bin bigint, x_low double, y_low double, count bigint"
    if len(ranges) < 2:
        return df.sparkSession.createDataFrame([], schema)

    def at(c: str) -> Column:
        lo, hi = ranges[c]
        reach = hi - lo if hi > lo else 1.0
        cell = F.floor((col(c) - _lit(lo)) * bins / _lit(reach))
        return F.when(cell.isNotNull(), F.least(cell, F.lit(bins - 1).cast("bigint")))

    def low(name: str, c: str) -> Column:
        lo, hi = ranges[c]
        return _lit(lo) + F.col(name) * _lit((hi - lo) / bins)

    grid = (
        points.select(at(x).alias("x_bin"), at(y).alias("y_bin"))
        .where("x_bin IS NOT NULL AND y_bin IS NOT NULL")
        .groupBy("x_bin", "y_bin")
        .agg(F.count("*").alias("count"))
    )
    return grid.select("x_bin", "y_bin", low("x_bin", x).alias("x_low"), low("y_bin", y).alias("y_low"), "count")


def grouped_box(
    df: DataFrame, splits: Sequence[tuple[str, str]], ndigits: int | None = 4
) -> DataFrame:
    """Quartiles and extremes per group for each (category, number) split."""
    schema = (
        "category string, number string, group string, count bigint, "
        "low double, q1 double, median double, q3 double, high double"
    )
    rows = []
    for category in dict.fromkeys(c for c, _ in splits):
        numbers = [n for c, n in splits if c == category]
        long = grouped_values(df, [category], numbers)
        probs = (0.0, *QUARTILES, 1.0)
        for (_, group), (counts, table) in exact_quantiles(
            long, numbers, probs, keys=["category", "group"]
        ).items():
            for i, number in enumerate(numbers):
                rows.append((category, number, group, counts[i], *table[i]))
    out = df.sparkSession.createDataFrame(rows, schema).where("count > 0")
    return out.select(
        "category",
        "number",
        "group",
        "count",
        "low",
        *[rounded(F.col(c), ndigits).alias(c) for c in ("q1", "median", "q3")],
        "high",
    )


def pie(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_slices: int = PIE_MAX,
    counts: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Shares of each value for columns with 2 to 8 distinct values. ``counts`` and ``sizes`` may
    pass saved ``value_counts`` and their ``categorical_univariate``."""
    columns = list(classify_columns(df).categorical if columns is None else columns)
    sizes = categorical_univariate(df, columns, counts) if sizes is None else sizes
    sizes = sizes.where(F.col("cardinality").between(2, max_slices))
    values = top_values(df, columns, max_slices, counts)
    return values.join(F.broadcast(sizes.select("column", F.col("count").alias("_n"))), "column").select(
        "column", "value", "count", F.round(F.col("count") / F.col("_n") * 100, 2).alias("share_pct")
    )


def model_bars(scores: DataFrame, problem_type: str) -> DataFrame:
    """``(metric, model, value, is_best)`` for the comparison bars."""
    metrics = {
        "regression": ["r2", "rmse", "mae"],
        "time_series": ["r2", "rmse", "mae"],
        "classification": ["f1"],
        "clustering": ["silhouette"],
    }[problem_type]
    return scores.unpivot(["model", "is_best"], metrics, "metric", "value").select(
        "metric", "model", "value", "is_best"
    )


def importance_bars(importance: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """The most important features of the best model."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def actual_vs_predicted(predictions: DataFrame, bins: int = SCATTER_BINS) -> DataFrame:
    """Predicted against actual values, counted on a grid."""
    return scatter(predictions, "actual", "predicted", bins)


def residual_histogram(predictions: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Histogram of predicted minus actual."""
    residual = predictions.select((F.col("predicted") - F.col("actual")).alias("residual"))
    return histogram(residual, ["residual"], bins)


def cluster_distribution(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows per cluster."""
    return clustered.groupBy(col(cluster).alias("cluster")).agg(F.count("*").alias("count"))
