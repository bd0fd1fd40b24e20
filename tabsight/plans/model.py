"""From a table to compared models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import missing_as_null
from ..operators import evaluate, train
from ..operators.features import Features, engineer_features
from ..operators.problem import Problem, clustering, detect_problem
from ..session import materialise

MIN_ROWS = 10


@dataclass
class Modeling:
    problem: Problem
    problem_table: DataFrame
    features: Features
    split_info: dict
    scores: DataFrame | None = None
    best: str | None = None
    importance: DataFrame | None = None
    drivers: DataFrame | None = None
    predictions: DataFrame | None = None
    preview: DataFrame | None = None
    clusters: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        named = {
            "problem": self.problem_table,
            "transformations": self.features.transformations,
            "target_mapping": self.features.target_mapping,
            "model_comparison": self.scores,
            "feature_importance": self.importance,
            "drivers": self.drivers,
            "predictions": self.predictions,
            "predictions_preview": self.preview,
            "clusters": self.clusters,
        }
        return {k: v for k, v in named.items() if v is not None}


def model(
    df: DataFrame,
    target: str | None = None,
    order_by: Sequence[str] | None = None,
    settings: dict[str, dict] | None = None,
    cluster: bool = False,
    **feature_options,
) -> Modeling:
    """Detect the problem, prepare features, fit the candidates, compare and explain.

    ``settings`` overrides options per candidate, e.g. fewer trees for a trial run.
    ``cluster`` asks for clusters whatever the values of the target, which joins the features.
    """
    df = missing_as_null(df)
    problem = clustering(df, target) if cluster else detect_problem(df, target, order_by)
    prepared = engineer_features(df, problem, order_by, **feature_options)
    matrix, names = prepared.matrix, prepared.names
    out = Modeling(problem, problem.table(df), prepared, {})
    if not names or matrix.limit(MIN_ROWS).count() < MIN_ROWS:
        return out
    if problem.problem_type == "clustering":
        return _clusters(out, matrix, names)
    if problem.problem_type == "time_series":
        split, method = train.chronological_split(matrix), "chronological"
    elif problem.problem_type == "regression":
        split, method = train.random_split(matrix, ["pos"]), "random"
    else:
        split, method = train.stratified_split(matrix, problem.target, ["pos"]), "stratified_random"
    split = materialise(split, "split")
    regression = problem.problem_type != "classification"
    trained = train.fit_candidates(
        split, names, problem.target, train.REGRESSION if regression else train.CLASSIFICATION, settings
    )
    out.split_info = {"method": method, **trained.split_info}
    if trained.predictions is None:
        return out
    out.predictions = materialise(trained.predictions, "predictions")
    if regression:
        metric, scores = "r2", evaluate.regression_metrics(out.predictions)
    else:
        metric, scores = "f1", evaluate.classification_metrics(out.predictions)
    tried = out.predictions.select("model", "candidate").distinct()
    scores = materialise(scores.join(tried, "model").repartition(1), "scores")
    out.best = evaluate.best_model(scores, metric).first()["model"]
    out.scores = evaluate.model_comparison(scores, metric).withColumn(
        "is_best", F.col("model") == out.best
    )
    out.importance = evaluate.feature_importance(
        df.sparkSession, names, train.importances(trained.models[out.best])
    )
    out.drivers = evaluate.top_drivers(out.importance)
    out.preview = evaluate.prediction_preview(out.predictions, out.best)
    return out


def _clusters(out: Modeling, matrix: DataFrame, names: list[str]) -> Modeling:
    found = train.kmeans_sweep(matrix, names)
    out.best = f"KMeans (k={found.best_k})"
    out.scores = found.scores.withColumn("is_best", F.col("model") == out.best)
    out.importance = evaluate.cluster_spread(found.centres, names)
    out.drivers = evaluate.top_drivers(out.importance)
    out.clusters = materialise(found.assigned.select("pos", "cluster"), "clusters")
    out.preview = out.clusters.orderBy("pos").limit(evaluate.PREVIEW_ROWS)
    out.split_info = {"method": "full_dataset", "best_k": found.best_k}
    return out
