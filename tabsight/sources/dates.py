"""Promotion of text columns that hold dates."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col

# Date layouts tried in this order; a column takes the first that parses
# all of its values.
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "MM/dd/yyyy HH:mm:ss",
    "dd-MM-yyyy",
    "yyyyMMdd",
    "dd MMM yyyy",
    "MMM dd, yyyy",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "M/d/yyyy",
    "M/d/yyyy H:mm",
    "d MMM yyyy",
    "MMM d, yyyy",
]
MIN_PARSED_SHARE = 0.5


# A value can only match a layout of its own shape: digits as 9, letters as a.
_DIGITS, _LETTERS = "0123456789", string.ascii_letters


def _shape(value: Column) -> Column:
    return F.translate(value, _DIGITS + _LETTERS, "9" * len(_DIGITS) + "a" * len(_LETTERS))


# The shapes that a layout's parts can have; a longer part stands before its prefixes.
_PARTS = {
    "SSSSSS": ["999999"], "yyyy": ["9999"], "MMM": ["aaa"], "SSS": ["999"], "XXX": ["a", "+99:99", "-99:99"], "'T'": ["a"],
    "MM": ["99"], "dd": ["99"], "HH": ["99"], "mm": ["99"], "ss": ["99"], "M": ["9", "99"], "d": ["9", "99"], "H": ["9", "99"],
}


def layout_shapes(layout: str) -> set[str]:
    """All shapes of the values that a layout can read."""
    parts = re.findall("|".join(map(re.escape, _PARTS)) + "|.", layout)
    return {"".join(way) for way in product(*(_PARTS.get(p, [p]) for p in parts))}


def column_shapes(df: DataFrame, columns: Sequence[str], known: set[str]) -> dict[str, tuple[float, set[str]] | None]:
    """Of each text column, the share of values present and the known shapes they have, or
    None where a value has another shape. The shape of a value is made once, below the
    aggregate, and a set holds known shapes only, so its size does not depend on the data."""
    longest = max(map(len, known), default=0)
    shaped = df.select(*[F.when(F.length(col(c)) <= longest, _shape(col(c))).alias(f"s{i}") for i, c in enumerate(columns)], *[col(c).isNotNull().alias(f"n{i}") for i, c in enumerate(columns)])
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        listed = F.col(f"s{i}").isin(sorted(known))
        aggregates += [
            F.count_if(F.col(f"n{i}")).alias(f"n{i}"),
            F.count_if(F.col(f"n{i}") & ~F.coalesce(listed, F.lit(False))).alias(f"odd{i}"),
            F.collect_set(F.when(listed, F.col(f"s{i}"))).alias(f"s{i}"),
        ]
    r = shaped.agg(*aggregates).first()
    return {c: None if r[f"odd{i}"] or not r["rows"] else (r[f"n{i}"] / r["rows"], set(r[f"s{i}"])) for i, c in enumerate(columns)}


def promote_datetimes(df: DataFrame, formats: Sequence[str] = tuple(DATE_FORMATS)) -> DataFrame:
    """Turn text columns into timestamps when every value parses and most are present.

    A column's shapes, from one scan, leave the layouts that can read all of them, mostly
    one or none; a second scan parses the columns that have any by those alone, and the first
    that reads every value holds.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    shapes = {f: layout_shapes(f) for f in formats}
    possible = {}
    for c, seen in column_shapes(df, strings, set().union(*shapes.values())).items():
        if seen and seen[1] and seen[0] > MIN_PARSED_SHARE:
            possible[c] = [f for f in formats if seen[1] <= shapes[f]]
    tries = [(c, f) for c, layouts in possible.items() for f in layouts]
    chosen: dict[str, str] = {}
    if tries:
        unread = [F.count_if(col(c).isNotNull() & F.try_to_timestamp(col(c), F.lit(f)).isNull()) for c, f in tries]
        for (c, f), n in zip(tries, df.select(*[col(c) for c in possible]).agg(*unread).first()):
            if n == 0:
                chosen.setdefault(c, f)
    return df.select(
        *[
            F.try_to_timestamp(col(c), F.lit(chosen[c])).alias(c) if c in chosen else col(c)
            for c in df.columns
        ]
    )
