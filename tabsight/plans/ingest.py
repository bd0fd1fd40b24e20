"""Load a source and profile it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import classify_columns, missing_as_null, schema_table
from ..functions.counts import value_counts
from ..operators import profile
from ..session import materialise
from ..sources import detect_source_kind, load_csv, load_json, load_table, promote_datetimes


@dataclass
class Ingested:
    data: DataFrame
    source_type: str
    schema: DataFrame
    metadata: DataFrame
    missing: DataFrame
    summary: DataFrame
    preview: DataFrame
    value_counts: DataFrame | None

    def tables(self) -> dict[str, DataFrame]:
        return {
            "schema": self.schema,
            "metadata": self.metadata,
            "missing_values": self.missing,
            "column_summary": self.summary,
            "preview": self.preview,
        }


def ingest(
    spark: SparkSession,
    source: str | DataFrame,
    source_type: str | None = None,
    table: str | None = None,
    columns: Sequence[str] | None = None,
    filters: Mapping[str, object] | None = None,
    row_limit: int | None = None,
    order_by: Sequence[str] | None = None,
    preview_rows: int = 5,
    **options,
) -> Ingested:
    """Load, promote dates and profile. An empty source raises ``ValueError``.

    Text sources are saved once as Parquet: the later passes then read only the columns
    they use instead of parsing every line again. Where dates were promoted, the promoted table
    is saved too, so no later pass parses them again.
    """
    if isinstance(source, DataFrame):
        kind, df = source_type or "table", source
    else:
        kind = source_type or detect_source_kind(source)
        shaping = dict(columns=columns, filters=filters, row_limit=row_limit, order_by=order_by)
        if kind == "csv":
            df = load_csv(spark, source, **shaping, **options)
        elif kind == "json":
            df = load_json(spark, source, **shaping, **options)
        elif kind in ("table", "parquet", "orc", "jdbc"):
            df = load_table(spark, source, table=table, **shaping, **options)
        else:
            raise ValueError(f"unsupported source type: {kind}")
    if kind in ("csv", "json", "jdbc") or row_limit is not None:
        df = materialise(df, "source")
    if df.isEmpty():
        raise ValueError("the source holds no rows")
    promoted = promote_datetimes(df)
    if promoted.schema != df.schema:
        promoted = materialise(promoted, "promoted")
    df = missing_as_null(promoted)
    classes = classify_columns(df)
    # Counts of categories serve the summary and the exploration; numbers and times, whose
    # distinct values may be as many as the rows, are only counted, never saved.
    counts = None
    if classes.categorical:
        counts = materialise(value_counts(df, classes.categorical), "value_counts")
    return Ingested(
        data=df,
        source_type=kind,
        schema=schema_table(df),
        metadata=profile.dataset_metadata(df, kind),
        missing=profile.missing_values(df),
        summary=profile.column_summary(df, counts),
        preview=profile.preview(df, preview_rows, order_by),
        value_counts=counts,
    )
