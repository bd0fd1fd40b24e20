"""Dataset and column profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    as_double,
    classify_columns,
    col,
    missing_as_null,
    per_column,
    rounded,
    schema_table,
    union_all,
)
from ..functions.counts import LONG_TEXT_BYTES, column_modes, value_counts
from ..sources.shaping import limit_rows

# Storage bytes of the fixed-width types.
TYPE_WIDTH = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4,
    "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def _row_key(df: DataFrame) -> Column:
    """32 bytes whose equality means equal rows (nulls equal): the SHA-256 of all values.

    Every value stands with its length, and null apart from empty, so neither can be
    mistaken for its neighbour's; long text enters by a digest of its own. However wide the
    table, a row crosses the network as one key.
    """
    parts = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            long = F.octet_length(c) > LONG_TEXT_BYTES
            raw = c if isinstance(f.dataType, T.StringType) else F.hex(c)
            shown = F.when(long, F.concat(F.lit("#"), F.sha2(c.cast("binary"), 256))).otherwise(F.concat(F.lit("="), raw))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            shown = (c + F.lit(0.0)).cast("string")  # both zeros are one value
        elif isinstance(f.dataType, T.TimestampType):
            shown = F.unix_micros(c).cast("string")  # text would join two hours of some zones
        elif isinstance(f.dataType, (T.MapType, T.VariantType, T.ArrayType, T.StructType)):
            shown = F.to_json(c)
        else:
            shown = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("n")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def missing_values(df: DataFrame) -> DataFrame:
    """``(column, missing)`` for columns that have missing cells."""
    df = missing_as_null(df)
    out = per_column(df, df.columns, lambda c: {"missing": F.count_if(col(c).isNull())})
    return out.where("missing > 0").select("column", "missing")


def dataset_metadata(df: DataFrame, source_type: str = "table") -> DataFrame:
    """One row: rows, columns, missing cells and rows that repeat an earlier row.

    One grouped pass answers all of it: equal rows share their missing cells.
    """
    df = missing_as_null(df)
    nulls = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    groups = (
        df.select(_row_key(df).alias("_key"), nulls.alias("_nulls"))
        .groupBy("_key")
        .agg(F.count("*").alias("_n"), F.sum("_nulls").alias("_missing"))
    )
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("total_missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_row_count"),
        F.lit(source_type).alias("source_type"),
    )


def missing_share(df: DataFrame) -> DataFrame:
    """One row: missing cells as a percentage of all cells, one decimal."""
    df = missing_as_null(df)
    nulls = sum((col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    cells = F.count(F.lit(1)) * len(df.columns)
    total = F.coalesce(F.sum(nulls), F.lit(0))
    return df.agg(
        total.alias("total_missing_cells"),
        F.round(F.try_divide(total.cast("double"), cells.cast("double")) * 100, 1).alias("missing_pct"),
    )


def data_size(df: DataFrame) -> DataFrame:
    """One row: uncompressed bytes of all cells and the same in MB (three decimals)."""
    fixed = 0
    variable = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        width = TYPE_WIDTH.get(f.dataType.simpleString())
        if width is not None:
            fixed += width
        elif isinstance(f.dataType, T.DecimalType):
            fixed += 16
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            variable = variable + F.coalesce(F.octet_length(col(f.name)), F.lit(0))
        else:
            variable = variable + F.coalesce(F.octet_length(F.to_json(col(f.name))), F.lit(0))
    total = F.coalesce(F.sum(variable + F.lit(fixed)), F.lit(0))
    return df.agg(total.alias("data_bytes"), F.round(total / 1_048_576, 3).alias("data_mb"))


def column_summary(df: DataFrame, counts: DataFrame | None = None, ndigits: int = 4) -> DataFrame:
    """One row per column: type, presence, distinct values and the usual extremes.

    ``counts`` may pass value counts of the categorical columns made by another step;
    of the other columns only the number of distinct values is kept.
    """
    df = missing_as_null(df)
    classes = classify_columns(df)
    columns = [c for c in df.columns if classes.of(c)]

    def stats(c: str) -> dict[str, Column]:
        kind = classes.of(c)
        extremes = kind in ("numeric", "datetime")
        shown = "double" if kind == "numeric" else "string"
        return {
            "rows": F.count(F.lit(1)),
            "non_null": F.count(col(c)),
            "mean": rounded(F.avg(as_double(c)), ndigits) if kind == "numeric" else F.avg(F.lit(None).cast("double")),
            "min": (F.min(col(c)) if extremes else F.min(F.lit(None).cast("int"))).cast(shown).cast("string"),
            "max": (F.max(col(c)) if extremes else F.max(F.lit(None).cast("int"))).cast(shown).cast("string"),
        }

    base = per_column(df, columns, stats)
    if counts is None and classes.categorical:
        counts = value_counts(df, classes.categorical)
    others = [c for c in columns if c not in classes.categorical]
    found = []
    if classes.categorical:
        modes = column_modes(df, counts)
        found.append(modes.select("column", F.col("cardinality").alias("unique"), F.col("mode").alias("_mode")))
    if others:
        distinct = value_counts(df, others).groupBy("column")
        found.append(
            distinct.agg(F.count("*").alias("unique")).withColumn("_mode", F.lit(None).cast("string"))
        )
    modes = union_all(found)
    types = schema_table(df).select("column", "dtype", "column_class")
    return (
        base.join(F.broadcast(types), "column")
        .join(F.broadcast(modes), "column", "left")
        .select(
            "position",
            "column",
            "dtype",
            "non_null",
            (F.col("rows") - F.col("non_null")).alias("null_count"),
            F.round(
                F.coalesce(F.try_divide(F.col("rows") - F.col("non_null"), F.col("rows")), F.lit(0.0)) * 100, 2
            ).alias("null_pct"),
            F.coalesce("unique", F.lit(0)).alias("unique"),
            "mean",
            "min",
            "max",
            F.when(F.col("column_class") == "categorical", F.col("_mode")).alias("top_value"),
        )
    )


def column_details(df: DataFrame, ndigits: int = 4) -> DataFrame:
    """``column_summary`` widened by spread, quartiles and shape of numeric columns."""
    from .univariate import numeric_univariate

    summary = column_summary(df, ndigits=ndigits)
    numeric = classify_columns(df).numeric
    if not numeric:
        shape = df.sparkSession.createDataFrame(
            [], "column string, std double, q1 double, median double, q3 double, skewness double, kurtosis double"
        )
    else:
        shape = numeric_univariate(df, numeric, ndigits=ndigits).select(
            "column", "std", "q1", "median", "q3", "skewness", "kurtosis"
        )
    return summary.join(F.broadcast(shape), "column", "left").select(
        "position", "column", "dtype", "non_null", "null_pct", "unique", "top_value",
        "mean", "std", "min", "q1", "median", "q3", "max", "skewness", "kurtosis",
    )


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First rows for display."""
    return limit_rows(df, n, order_by)


def sample_rows(df: DataFrame, n: int = 50, order_by: Sequence[str] | None = None) -> DataFrame:
    """First rows as context for a reader of the analysis."""
    return limit_rows(df, n, order_by)


__all__ = [
    "column_details",
    "column_summary",
    "data_size",
    "dataset_metadata",
    "missing_share",
    "missing_values",
    "preview",
    "sample_rows",
]
