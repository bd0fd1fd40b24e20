"""Everything at once: ingest, explore, model, and save the result tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import classify_columns
from ..operators import charts
from .explore import Exploration, explore
from .ingest import Ingested, ingest
from .model import Modeling, model


@dataclass
class Analysis:
    ingested: Ingested
    explored: Exploration
    modeled: Modeling
    charts: dict[str, DataFrame]

    def tables(self) -> dict[str, DataFrame]:
        return {
            **self.ingested.tables(),
            **self.explored.tables(),
            **self.modeled.tables(),
            **{f"chart_{k}": v for k, v in self.charts.items()},
        }

    def save(self, path: str) -> None:
        """Write every result table as Parquet under ``path``."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def chart_tables(df: DataFrame, explored: Exploration, modeled: Modeling) -> dict[str, DataFrame]:
    """Chart data; quartiles, correlations and value counts are those of the exploration."""
    classes = classify_columns(df)
    out, counts = {}, explored.counts
    if classes.numeric:
        out["histogram"] = charts.histogram(df, classes.numeric)
        out["box_plot"] = charts.box_plot(df, classes.numeric, known_quartiles=explored.quartiles)
        out["box_outliers"] = charts.box_outliers(df, classes.numeric, explored.quartiles)
    if len(classes.numeric) > 1:
        out["heatmap"] = charts.heatmap(df, classes.numeric, correlations=explored.correlations)
    if classes.categorical:
        out["bar"] = charts.bar(df, classes.categorical, counts=counts)
        out["pie"] = charts.pie(df, classes.categorical, counts=counts, sizes=explored.categorical)
    for r in explored.strong_correlations.collect():
        out[f"scatter_{r['a']}_{r['b']}"] = charts.scatter(df, r["a"], r["b"])
    splits = [
        (r["split_column"], r["column"])
        for r in explored.segments.where("type = 'categorical_split'")
        .orderBy("effect_size", ascending=False)
        .collect()
    ]
    if splits:
        out["grouped_box"] = charts.grouped_box(df, splits)
    if modeled.scores is not None:
        out["model_bars"] = charts.model_bars(modeled.scores, modeled.problem.problem_type)
    if modeled.importance is not None:
        out["importance_bars"] = charts.importance_bars(modeled.importance)
    if modeled.predictions is not None and modeled.problem.problem_type in ("regression", "time_series"):
        best = modeled.predictions.where(modeled.predictions.model == modeled.best)
        out["actual_vs_predicted"] = charts.actual_vs_predicted(best)
        out["residuals"] = charts.residual_histogram(best)
    if modeled.clusters is not None:
        out["cluster_distribution"] = charts.cluster_distribution(modeled.clusters)
    return out


def analyze(
    spark: SparkSession,
    source: str | DataFrame,
    target: str | None = None,
    order_by: Sequence[str] | None = None,
    settings: dict[str, dict] | None = None,
    save_to: str | None = None,
    **load_options,
) -> Analysis:
    """Run the whole analysis of one source; ``save_to`` writes the result tables."""
    loaded = ingest(spark, source, order_by=order_by, **load_options)
    explored = explore(
        loaded.data, order_by, counts=loaded.value_counts, metadata=loaded.metadata
    )
    modeled = model(loaded.data, target, order_by, settings)
    out = Analysis(loaded, explored, modeled, chart_tables(loaded.data, explored, modeled))
    if save_to:
        out.save(save_to)
    return out
