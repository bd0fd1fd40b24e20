"""Projection, equality filter and row limit; Catalyst pushes all three to the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_of, col
from ..functions.order import ascending


def project(df: DataFrame, columns: Sequence[str] | None, strict: bool = True) -> DataFrame:
    """Keep the named columns; unknown ones raise, or are passed over if not ``strict``."""
    if not columns:
        return df
    unknown = [c for c in columns if c not in df.columns]
    if unknown and strict:
        raise ValueError(f"unknown columns: {unknown}")
    return df.select(*[col(c) for c in columns if c in df.columns])


def where_equals(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """AND of equalities; ``None`` asks for missing values."""
    if not filters:
        return df
    return df.where(
        all_of(col(c).isNull() if v is None else col(c) == F.lit(v) for c, v in filters.items())
    )


def limit_rows(
    df: DataFrame, row_limit: int | None, order_by: Sequence[str] | None = None
) -> DataFrame:
    """First rows: a top-k in the given order, else whichever rows come first."""
    if row_limit is None:
        return df
    if order_by:
        df = df.orderBy(*ascending(order_by))
    return df.limit(row_limit)
