"""Scoring predictions and clusterings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, per_column, rounded

PREVIEW_ROWS = 200
TOP_DRIVERS = 5


def regression_metrics(predictions: DataFrame, ndigits: int | None = 4) -> DataFrame:
    """MAE, RMSE, R2 and MAPE per model from ``(model, actual, predicted)``.

    MAPE leaves out zero actuals. Without variance in the actuals, R2 is 1 for perfect
    predictions and 0 otherwise.
    """
    y, p = F.col("actual").cast("double"), F.col("predicted").cast("double")
    error = y - p
    total = F.var_pop(y) * F.count(y)
    squares = F.sum(error * error)
    r2 = (
        F.when(F.min(y) < F.max(y), 1 - F.try_divide(squares, total))
        .when(squares == 0, F.lit(1.0))
        .otherwise(0.0)
    )
    return predictions.groupBy("model").agg(
        rounded(F.avg(F.abs(error)), ndigits).alias("mae"),
        rounded(F.sqrt(F.avg(error * error)), ndigits).alias("rmse"),
        rounded(r2, ndigits).alias("r2"),
        F.round(F.avg(F.when(y != 0, F.abs(F.try_divide(error, y)))) * 100, 2).alias("mape"),
        F.count("*").alias("test_rows"),
    )


def classification_metrics(
    predictions: DataFrame, positive: str = "1", ndigits: int | None = 4
) -> DataFrame:
    """Accuracy, precision, recall and F1 per model from ``(model, actual, predicted)``.

    Up to two labels among the actuals: scores of the ``positive`` label. More: the mean
    over all labels that were seen or predicted. A score without cases is 0.
    """
    types = {f.name: f.dataType for f in predictions.schema.fields}

    def label(c: str):
        # 1.0 and 1 are the same label only where labels are numbers.
        shown = F.col(c).cast("string")
        return F.regexp_replace(shown, r"\.0$", "") if isinstance(types[c], T.NumericType) else shown

    cells = (
        predictions.select("model", label("actual").alias("a"), label("predicted").alias("p"))
        .groupBy("model", "a", "p")
        .agg(F.count("*").alias("n"))
    )
    # From here on: one row per model and pair of labels.
    per_label = (
        cells.select(
            "model",
            "n",
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("label"), F.lit(1).alias("is_actual")),
                    F.struct(F.col("p").alias("label"), F.lit(0).alias("is_actual")),
                )
            ).alias("side"),
            (F.col("a") == F.col("p")).alias("hit"),
        )
        .groupBy("model", "side.label")
        .agg(
            F.sum(F.when((F.col("side.is_actual") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("side.is_actual") == 1, F.col("n")).otherwise(0)).alias("actual_n"),
            F.sum(F.when(F.col("side.is_actual") == 0, F.col("n")).otherwise(0)).alias("predicted_n"),
        )
    )
    zero = F.lit(0.0)
    scored = per_label.select(
        "*",
        F.coalesce(F.try_divide("tp", "predicted_n"), zero).alias("precision"),
        F.coalesce(F.try_divide("tp", "actual_n"), zero).alias("recall"),
    ).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("actual_n") + F.col("predicted_n")), zero)
    )
    binary = F.count_if(F.col("actual_n") > 0) <= 2

    def overall(name: str):
        one = F.coalesce(F.max(F.when(F.col("label") == positive, F.col(name))), zero)
        return rounded(F.when(binary, one).otherwise(F.avg(name)), ndigits).alias(name)

    return scored.groupBy("model").agg(
        rounded(F.sum("tp") / F.sum("actual_n"), ndigits).alias("accuracy"),
        overall("precision"),
        overall("recall"),
        overall("f1"),
        F.sum("actual_n").alias("test_rows"),
    )


def silhouette(
    df: DataFrame, features: Sequence[str], cluster: str, ndigits: int | None = 4
) -> DataFrame:
    """Mean silhouette by squared Euclidean distance: ``(silhouette, rows)``.

    The mean squared distance of a row to a cluster follows from the cluster's count, sum
    and sum of squares, so every row is scored exactly in linear time; clusters, one entry
    each, are taken to be few. Rows without cluster are left out; null for fewer than two.
    """
    placed = df.where(col(cluster).isNotNull())
    safe = [f"f{i}" for i in range(len(features))]
    rows = placed.select(
        *[col(f).cast("double").alias(s) for f, s in zip(features, safe)], col(cluster).alias("c")
    )
    schema = "silhouette double, rows bigint"
    if rows.select("c").distinct().limit(2).count() < 2:
        return df.sparkSession.createDataFrame([(None, rows.count())], schema)
    if isinstance(rows.schema["c"].dataType, T.NumericType):
        coded = rows.withColumn("prediction", F.col("c").cast("double"))
    else:
        named = rows.withColumn("c", F.col("c").cast("string"))
        coded = StringIndexer(inputCol="c", outputCol="prediction").fit(named).transform(named)
    vectors = VectorAssembler(inputCols=safe, outputCol="features").transform(coded)
    score = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(vectors)
    shown = score if ndigits is None else round(score, ndigits)
    return df.sparkSession.createDataFrame([(shown, rows.count())], schema)


def best_model(scores: DataFrame, metric: str) -> DataFrame:
    """The first model with the highest score (``candidate`` is the order of trial)."""
    return scores.orderBy(F.col(metric).desc_nulls_last(), "candidate").limit(1)


def model_comparison(scores: DataFrame, metric: str) -> DataFrame:
    """All models, best first, with their rank."""
    # One row per model.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(metric).desc_nulls_last(), "candidate")
    return scores.withColumn("rank", F.row_number().over(order)).orderBy("rank")


def feature_importance(
    spark: SparkSession, names: Sequence[str], raw: Sequence[float]
) -> DataFrame:
    """Importances scaled to the largest, four decimals, most important first."""
    values = [round(abs(float(v)), 4) for v in raw]
    top = max(values, default=0.0) or 1.0
    rows = sorted(
        ((n, round(v / top, 4)) for n, v in zip(names, values)), key=lambda nv: (-nv[1], nv[0])
    )
    return spark.createDataFrame(rows, "feature string, importance double")


def cluster_spread(centres: DataFrame, features: Sequence[str], ndigits: int | None = 4) -> DataFrame:
    """Population deviation of the cluster centres per feature, widest first."""
    out = per_column(centres, list(features), lambda f: {"spread": F.stddev_pop(col(f))})
    return out.select(
        F.col("column").alias("feature"), rounded(F.col("spread"), ndigits).alias("importance")
    ).orderBy(F.desc("importance"), "feature")


def prediction_preview(
    predictions: DataFrame, model: str, n: int = PREVIEW_ROWS, order_by: Sequence[str] = ("pos",)
) -> DataFrame:
    """First test rows of one model."""
    return (
        predictions.where(F.col("model") == model)
        .orderBy(*[col(c) for c in order_by])
        .limit(n)
        .select(*[col(c) for c in order_by], "actual", "predicted")
    )


def top_drivers(importance: DataFrame, n: int = TOP_DRIVERS) -> DataFrame:
    """The strongest features with their importance relative to the first, in percent."""
    return (
        importance.orderBy(F.desc("importance"), "feature")
        .limit(n)
        .select("feature", "importance", F.round(F.col("importance") * 100, 0).alias("share_pct"))
    )
