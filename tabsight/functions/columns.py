"""Column classes, quoting, missing values and guarded arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"

# Aggregate functions in one global aggregate. More are split over several scans (each
# reads only its own columns): beyond this the generated code grows past what the JVM
# compiles and the aggregate runs an order of magnitude slower.
AGGREGATES_PER_SCAN = 32


def col(name: str) -> Column:
    """Column by its exact name (flattened JSON names contain dots)."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class ColumnClasses:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    def of(self, name: str) -> str | None:
        for label in (NUMERIC, CATEGORICAL, DATETIME):
            if name in getattr(self, label):
                return label
        return None


def classify_columns(df: DataFrame) -> ColumnClasses:
    """Sort columns by type; nested and binary columns take no part in the analysis."""
    out = ColumnClasses()
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out.numeric.append(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out.datetime.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            out.categorical.append(f.name)
        else:
            out.skipped.append(f.name)
    return out


def schema_table(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, column_class)`` read off the schema."""
    classes = classify_columns(df)
    rows = [
        (i, f.name, f.dataType.simpleString(), classes.of(f.name))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, dtype string, column_class string"
    )


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing, infinity does not."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c)
            for c in df.columns
        ]
    )


def as_double(name: str) -> Column:
    return col(name).cast("double")


def epoch_micros(name: str, data_type: T.DataType) -> Column:
    """A date or timestamp as microseconds since 1970, without any zone shift."""
    c = col(name)
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c)
    # A value without zone is read as UTC, whatever the session zone is.
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c.cast("timestamp_ntz"))
    return F.unix_micros(local.cast("timestamp"))


def rounded(c: Column, ndigits: int | None) -> Column:
    return c if ndigits is None else F.round(c, ndigits)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson over complete pairs; null where a side does not vary."""
    both_x = F.when(y.isNotNull(), x)
    both_y = F.when(x.isNotNull(), y)
    return F.try_divide(
        F.covar_pop(both_x, both_y), F.stddev_pop(both_x) * F.stddev_pop(both_y)
    )


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column, null below three values."""
    n = F.count(c).cast("double")
    g1 = F.coalesce(F.skewness(c), F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.try_subtract(n, F.lit(2.0)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column, null below four values."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(
        n >= 4,
        F.coalesce(
            F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3)), F.lit(0.0)
        ),
    )


def columns_per_scan(aggregates_per_column: int) -> int:
    return max(1, AGGREGATES_PER_SCAN // aggregates_per_column)


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    stats: Callable[[str], dict[str, Column]],
    carry: Callable[[str], dict[str, Column]] | None = None,
) -> DataFrame:
    """One output row per input column, computed by global aggregates.

    ``stats(column)`` names the aggregates (same names for every column). Each
    aggregate pass covers a few columns and reads only those from the source.
    """
    frames = []
    step = columns_per_scan(len(stats(columns[0]))) if columns else 1
    for start in range(0, len(columns), step):
        part = columns[start : start + step]
        flat, structs = [], []
        for i, c in enumerate(part):
            named = stats(c)
            flat += [expr.alias(f"c{i}_{name}") for name, expr in named.items()]
            structs.append(
                F.struct(
                    F.lit(start + i).alias("position"),
                    F.lit(c).alias("column"),
                    *[F.col(f"c{i}_{name}").alias(name) for name in named],
                    *[v.alias(k) for k, v in (carry(c) if carry else {}).items()],
                )
            )
        frames.append(df.agg(*flat).select(F.inline(F.array(*structs))))
    return union_all(frames)
