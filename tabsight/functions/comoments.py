"""Moments of every pair of many columns in one scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_functions_of
from .columns import col

ship_functions_of(__name__)

_NAMES = ["n", "odd", "si", "sj", "sii", "sjj", "sij", "li", "hi", "lj", "hj"]
# Rows whose products are taken at once.
BLOCK_ROWS = 8192


def _extremes(x: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of column i among the rows where j is present."""
    least, most = np.where(here, x, np.inf), np.where(here, x, -np.inf)
    k = x.shape[1]
    low, high = np.empty((k, k)), np.empty((k, k))
    low[:], high[:] = least.min(axis=0)[:, None], most.max(axis=0)[:, None]
    for j in np.flatnonzero(~here.all(axis=0)):
        low[:, j], high[:, j] = least[here[:, j]].min(axis=0, initial=np.inf), most[here[:, j]].max(axis=0, initial=-np.inf)
    return low, high


def pair_moments(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, j, n, odd, si, sj, sii, sjj, sij, li, hi, lj, hj)`` for every pair i < j of columns
    of doubles: the complete pairs, those that hold an infinity, sums, squares, products
    and extremes of both sides over the complete pairs without one.

    Values are taken less the column's mean (one more scan), so sums lose no digits. A task
    keeps a few matrices of columns x columns, whatever its rows, and sends one row a
    pair; the rows of all tasks are then added up by pair.
    """
    columns = list(columns)
    finite = [F.when(F.abs(col(c)) < float("inf"), col(c)) for c in columns]
    shift = np.array([m or 0.0 for m in values.agg(*[F.avg(c) for c in finite]).first()])
    first, second = np.triu_indices(len(columns), 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shift)
        sums = {name: np.zeros((k, k)) for name in ("n", "odd", "s", "ss", "sp")}
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                present, infinite = ~np.isnan(raw), np.isinf(raw)
                x = np.where(present & ~infinite, raw - shift, 0.0)
                here, there = present.astype(float), infinite.astype(float)
                sums["n"] += here.T @ here
                if infinite.any():
                    sums["odd"] += there.T @ here + here.T @ there
                sums["s"] += x.T @ here
                sums["ss"] += (x * x).T @ here
                sums["sp"] += x.T @ x
                a, b = _extremes(x, present)
                np.minimum(low, a, out=low)
                np.maximum(high, b, out=high)
        s, ss = sums["s"], sums["ss"]
        sides = [sums["n"], sums["odd"], s, s.T, ss, ss.T, sums["sp"], low, high, low.T, high.T]
        made = [pa.array(first, pa.int32()), pa.array(second, pa.int32()), *[pa.array(m[first, second]) for m in sides]]
        yield pa.RecordBatch.from_arrays(made, ["i", "j", *_NAMES])

    schema = "i int, j int, " + ", ".join(f"{n} double" for n in _NAMES)
    parts = values.select(*[col(c).alias(f"_c{i}") for i, c in enumerate(columns)]).mapInArrow(gather, schema)
    merged = {"li": F.min, "lj": F.min, "hi": F.max, "hj": F.max}
    return parts.groupBy("i", "j").agg(*[merged.get(n, F.sum)(n).alias(n) for n in _NAMES])


def correlation(moments: DataFrame) -> DataFrame:
    """``(i, j, r)``: Pearson's r of each pair; null where a side does not vary among the
    complete pairs, NaN where it holds an infinity."""
    n, si, sj = F.col("n"), F.col("si"), F.col("sj")
    vi = F.greatest(F.col("sii") - si * F.try_divide(si, n), F.lit(0.0))
    vj = F.greatest(F.col("sjj") - sj * F.try_divide(sj, n), F.lit(0.0))
    r = F.try_divide(F.col("sij") - si * F.try_divide(sj, n), F.sqrt(vi) * F.sqrt(vj))
    varies = (F.col("li") < F.col("hi")) & (F.col("lj") < F.col("hj"))
    return moments.select("i", "j", F.when(F.col("odd") > 0, F.lit(float("nan"))).when(varies, r).alias("r"))
