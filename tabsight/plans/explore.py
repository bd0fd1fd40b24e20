"""Exploratory statistics of a table, with the expensive passes shared."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.columns import classify_columns, missing_as_null
from ..functions.counts import small_domains, value_counts
from ..operators import bivariate, profile, rules, segments, series, shape, univariate
from ..session import materialise


@dataclass
class Exploration:
    numeric: DataFrame | None
    categorical: DataFrame | None
    top_values: DataFrame | None
    datetime: DataFrame | None
    correlations: DataFrame
    strong_correlations: DataFrame
    grouped_statistics: DataFrame
    associations: DataFrame
    distributions: DataFrame | None
    segments: DataFrame
    time_series: DataFrame | None
    insights: DataFrame
    recommendations: DataFrame
    findings: DataFrame
    # What later steps need again: quartiles by number, saved value counts.
    quartiles: dict = field(default_factory=dict)
    counts: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if v is not None and k not in ("quartiles", "counts")}


_EMPTY = {
    "numeric": "column string, cv double",
    "categorical": "column string, mode string, mode_pct double",
    "shapes": "column string, distribution_type string, skewness double, is_multimodal boolean",
}


def explore(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    ndigits: int | None = 4,
    counts: DataFrame | None = None,
    metadata: DataFrame | None = None,
) -> Exploration:
    """Univariate, bivariate, shape, segment and time-series results plus rule tables.

    Quartiles, value counts, cardinality gates and group statistics are made once and passed to every step
    that needs them; the small result tables are saved before rules combine them.
    ``order_by`` (time column first, unique column last) sets the row order; without it rows
    go by the first datetime column and those of equal times by their numbers.
    """
    spark = df.sparkSession
    df = missing_as_null(df)
    classes = classify_columns(df)
    numbers, categories, dates = classes.numeric, classes.categorical, classes.datetime

    def saved(result: DataFrame, label: str) -> DataFrame:
        return materialise(result.repartition(1), label)

    def empty(name: str) -> DataFrame:
        return spark.createDataFrame([], _EMPTY[name])

    numeric = categorical = top = when = shapes = along = None
    quartiles = univariate.quartiles(df, numbers) if numbers else {}
    if numbers:
        numeric = saved(univariate.numeric_univariate(df, numbers, ndigits, quartiles), "numeric")
        shapes = saved(shape.classify_distribution(df, numbers, ndigits, quartiles), "shapes")
    if categories:
        if counts is None:
            counts = materialise(value_counts(df, categories), "value_counts")
        categorical = saved(univariate.categorical_univariate(df, categories, counts), "categorical")
        top = univariate.top_values(df, categories, counts=counts)
    if dates:
        when = univariate.datetime_univariate(df, dates)
    correlations = saved(bivariate.correlation_matrix(df, numbers), "correlations")
    strong = bivariate.strong_correlations(correlations, ndigits=ndigits)
    # The widest gate; the narrower ones of associations and segments follow from it.
    domains = small_domains(df, categories, bivariate.GROUPED_MAX_DISTINCT)
    gated = list(domains) if numbers else []
    groups = saved(bivariate.group_table(df, gated, numbers), "groups") if gated else None
    found = saved(
        segments.detect_segments(df, categories, numbers, ndigits, groups, quartiles or None, domains), "segments"
    )
    if dates and numbers:
        along = saved(
            series.time_series_analysis(df, order_by, numbers, ndigits), "time_series"
        )
    if metadata is None:
        metadata = profile.dataset_metadata(df)
    n, c = numeric if numeric is not None else empty("numeric"), categorical
    s = shapes if shapes is not None else empty("shapes")
    return Exploration(
        numeric=numeric,
        categorical=categorical,
        top_values=top,
        datetime=when,
        correlations=correlations,
        strong_correlations=strong,
        grouped_statistics=bivariate.grouped_statistics(
            df, categories, numbers, ndigits=ndigits, groups=groups, domains=domains
        ),
        associations=bivariate.categorical_associations(df, categories, ndigits=ndigits, domains=domains),
        distributions=shapes,
        segments=found,
        time_series=along,
        insights=rules.insights(n, c if c is not None else empty("categorical"), strong, s, found),
        recommendations=rules.chart_recommendations(
            spark, numbers, categories, strong, found, along, dates[0] if dates else None
        ),
        findings=rules.findings(metadata, s, strong, found, along),
        quartiles=quartiles,
        counts=counts,
    )
