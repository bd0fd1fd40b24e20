"""Contingency counts of many pairs of columns of few values in one scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_functions_of
from .columns import union_all
from .counts import text

ship_functions_of(__name__)

# Pairs whose matrices a task holds at once; with 30 values a column, 4,096 of them take 32 MB.
PAIRS_AT_ONCE = 4096


def _grown(counts: np.ndarray, width: int) -> np.ndarray:
    """The same matrices with room for ``width`` values on both sides."""
    wider = np.zeros((len(counts), width, width), dtype=np.int64)
    wider[:, : counts.shape[1], : counts.shape[2]] = counts
    return wider


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(p, a, b, count)``: how often the values a and b of the p-th pair meet.

    For columns that a gate has found to hold few values. A task numbers the values of a
    column as it meets them, adds each batch to a matrix a pair, and sends the cells that
    are not empty: no more rows than values x values x pairs, whatever it reads. Nulls
    count nowhere. Pairs beyond ``PAIRS_AT_ONCE`` take further scans of their columns.
    """
    parts = [
        _block(df, list(pairs[at : at + PAIRS_AT_ONCE]), at) for at in range(0, len(pairs), PAIRS_AT_ONCE)
    ]
    return union_all(parts).groupBy("p", "a", "b").agg(F.sum("count").alias("count"))


def _block(df: DataFrame, pairs: list[tuple[str, str]], start: int) -> DataFrame:
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(columns)}
    sides = [(place[a], place[b]) for a, b in pairs]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict[str, int]] = [{} for _ in columns]
        counts, width = np.zeros((len(sides), 1, 1), dtype=np.int64), 1
        for batch in batches:
            codes = []
            for seen, values in zip(known, batch.columns):
                coded = values.dictionary_encode()
                # Null is the last entry of the numbering, cut off below.
                numbers = np.array([seen.setdefault(v, len(seen)) for v in coded.dictionary.to_pylist()] + [-1])
                codes.append(numbers[coded.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)])
            if (most := max(map(len, known), default=0)) > width:
                width = max(most, 2 * width)
                counts = _grown(counts, width)
            for p, (i, j) in enumerate(sides):
                both = (codes[i] >= 0) & (codes[j] >= 0)
                met = np.bincount(codes[i][both] * width + codes[j][both], minlength=width * width)
                counts[p] += met.reshape(width, width)
        names = [pa.array(list(seen), pa.string()) for seen in known]
        for p, (i, j) in enumerate(sides):
            a, b = np.nonzero(counts[p])
            if len(a):
                made = [np.full(len(a), start + p, np.int32), names[i].take(pa.array(a)), names[j].take(pa.array(b)), counts[p][a, b]]
                yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], ["p", "a", "b", "count"])

    plain = df.select(*[text(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    return plain.mapInArrow(count, "p int, a string, b string, count bigint")
