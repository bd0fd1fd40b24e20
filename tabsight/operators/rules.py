"""Rule tables derived from the results of the other operators (all small)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import union_all

HIGH_CV = 1.0
DOMINANT_PCT = 60.0
DRIVER_EFFECT = 0.5


def insights(
    numeric: DataFrame,
    categorical: DataFrame,
    strong: DataFrame,
    shapes: DataFrame,
    segments: DataFrame,
) -> DataFrame:
    """``(category, subject, value)`` of everything worth pointing out.

    Inputs: numeric and categorical univariate tables, strong correlations, shape labels
    and segments.
    """
    pair = F.concat_ws(" & ", "a", "b")
    split = F.concat_ws(" -> ", "split_column", "column")
    return union_all(
        [
            numeric.where(F.col("cv") > HIGH_CV).select(
                F.lit("high_variability").alias("category"),
                F.col("column").alias("subject"),
                F.col("cv").alias("value"),
            ),
            categorical.where(F.col("mode_pct") >= DOMINANT_PCT).select(
                F.lit("dominant_category").alias("category"),
                F.concat_ws("=", "column", "mode").alias("subject"),
                F.col("mode_pct").alias("value"),
            ),
            strong.select(
                F.lit("strong_correlation").alias("category"),
                pair.alias("subject"),
                F.col("correlation").alias("value"),
            ),
            shapes.where(F.col("distribution_type").endswith("skewed")).select(
                F.lit("skewed_distribution").alias("category"),
                F.col("column").alias("subject"),
                F.col("skewness").alias("value"),
            ),
            segments.where((F.col("type") == "categorical_split") & (F.col("effect_size") >= DRIVER_EFFECT)).select(
                F.lit("potential_driver").alias("category"),
                split.alias("subject"),
                F.col("effect_size").alias("value"),
            ),
        ]
    )


def _names(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(columns)), "n int, x string")


def chart_recommendations(
    spark: SparkSession,
    numeric_columns: Sequence[str],
    categorical_columns: Sequence[str],
    strong: DataFrame,
    segments: DataFrame,
    time_series: DataFrame | None = None,
    time_column: str | None = None,
) -> DataFrame:
    """``(ordinal, priority, chart_type, x, y)``, most important first: by priority, then
    in the order of the rules, and inside a rule in that of the columns or of the input's rank."""
    none = F.lit(None).cast("string")

    def rec(df, chart, priority, x, y=none, place=F.lit(0)):
        return df.select(
            F.lit(priority).alias("priority"), F.lit(len(frames)).alias("rule"), place.cast("double").alias("place"),
            F.lit(chart).alias("chart_type"), x.alias("x"), y.alias("y"),
        )

    def rank_of(names: Sequence[str], c: str):
        return F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)), F.lit(0))

    frames: list[DataFrame] = []
    frames.append(rec(_names(spark, numeric_columns), "histogram", 1, F.col("x"), place=F.col("n")))
    outliers = segments.where("type = 'outlier_segment'")
    frames.append(rec(outliers, "boxplot", 2, F.col("column"), place=rank_of(numeric_columns, "column")))
    frames.append(rec(strong, "scatter", 3, F.col("a"), F.col("b"), place=-F.abs("correlation")))
    frames.append(rec(_names(spark, categorical_columns), "bar", 4, F.col("x"), place=F.col("n")))
    splits = segments.where("type = 'categorical_split'")
    frames.append(rec(splits, "grouped_boxplot", 3, F.col("split_column"), F.col("column"), place=-F.col("effect_size")))
    if len(numeric_columns) >= 2:
        every = spark.range(1).select(F.lit(",".join(numeric_columns)).alias("x"))
        frames.append(rec(every, "correlation_heatmap", 2, F.col("x")))
    if time_series is not None:
        lines = time_series.where("status = 'ok'")
        frames.append(rec(lines, "line", 2, F.lit(time_column), F.col("column"), place=rank_of(numeric_columns, "column")))
    # A row per chart: few.
    order = Window.partitionBy(F.lit(0)).orderBy("priority", "rule", "place", "x", "y")
    numbered = union_all(frames).withColumn("ordinal", F.row_number().over(order))
    return numbered.select("ordinal", "priority", "chart_type", "x", "y").orderBy("ordinal")


def findings(
    metadata: DataFrame,
    shapes: DataFrame,
    strong: DataFrame,
    segments: DataFrame,
    time_series: DataFrame | None = None,
) -> DataFrame:
    """``(fact, subject, value)``: the facts a summary would state."""
    none = F.lit(None).cast("string")

    def fact(df, name, subject, value):
        return df.select(
            F.lit(name).alias("fact"), subject.alias("subject"), value.cast("double").alias("value")
        )

    splits = segments.where("type = 'categorical_split'")
    frames = [
        fact(metadata, "rows", none, F.col("row_count")),
        fact(metadata, "columns", none, F.col("column_count")),
        fact(metadata, "missing_cells", none, F.col("total_missing_cells")),
        fact(shapes.where(F.col("distribution_type").endswith("skewed")), "skewed", F.col("column"), F.col("skewness")),
        fact(shapes.where("is_multimodal"), "multimodal", F.col("column"), F.lit(None)),
        fact(strong, "strong_correlation", F.concat_ws(" & ", "a", "b"), F.col("correlation")),
        fact(
            splits.orderBy(F.desc("effect_size"), "split_column", "column").limit(1),
            "top_split",
            F.concat_ws(" -> ", "split_column", "column"),
            F.col("effect_size"),
        ),
        fact(segments.where("type = 'outlier_segment'"), "outliers", F.col("column"), F.col("outlier_count")),
    ]
    if time_series is not None:
        subject = F.concat_ws(":", "column", "trend")
        frames.append(fact(time_series.where("status = 'ok'"), "trend", subject, F.col("r_squared")))
    return union_all(frames)
