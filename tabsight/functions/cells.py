"""Rows that boosted trees cannot tell apart, as one weighted row each.

Trees look at a feature's bins only, so rows with equal bins go the same way through every
tree. Boosting by squared error needs their number and mean label, boosting of two classes their
number by label: fitting on these cells splits and predicts as fitting on all rows does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_functions_of
from .boosting import CUT_ERROR, MAX_BINS, _binned, _lists, _matrix

ship_functions_of(__name__)


def cut_points(train: DataFrame, bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper ends of a feature's bins but the last: all values where they are few, else
    quantiles of all rows."""
    wide = train.select(vector_to_array("features").alias("x"))
    first = wide.first()
    if first is None:
        raise ValueError("no training rows")
    columns = [f"f{i}" for i in range(len(first["x"]))]
    few = _few_values(wide, len(columns), bins)
    many = [c for i, c in enumerate(columns) if i not in few]
    values = wide.select(*[F.col("x")[i].alias(c) for i, c in enumerate(columns) if i not in few])
    ranks = [i / bins for i in range(1, bins)]
    found = dict(zip(many, values.approxQuantile(many, ranks, CUT_ERROR))) if many else {}
    return [few[i][:-1] if i in few else np.unique(found[c]) for i, c in enumerate(columns)]


def _few_values(wide: DataFrame, width: int, most: int) -> dict[int, np.ndarray]:
    """The values, in order, of each number of the arrays ``x`` that has at most so many; from one scan."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0)] * width
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, width))
            for i in range(width):
                if len(held[i]) <= most:
                    held[i] = np.union1d(held[i], x[:, i])[: most + 1]
        at = np.repeat(np.arange(width, dtype=np.int32), [len(h) for h in held])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(held))], ["at", "value"])

    # A task sends at most one value more of a number than are few.
    told = wide.mapInArrow(seen, "at int, value double").groupBy("at").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return {r["at"]: np.array(r["values"]) for r in told.where(F.size("values") <= most).collect()}


def with_bins(rows: DataFrame, cuts: list[np.ndarray], name: str) -> DataFrame:
    """Add the bins of the vector ``features`` as an array."""

    @F.arrow_udf("array<tinyint>")
    def bins(features: pa.Array) -> pa.Array:
        if not len(features):
            return pa.array([], pa.list_(pa.int8()))
        return _lists(_binned(_matrix(features), cuts).astype(np.int8), pa.int8())

    return rows.withColumn(name, bins(vector_to_array("features")))


def as_vector(column: str):
    return array_to_vector(F.col(column).cast("array<double>"))


def cells(train: DataFrame, cuts: list[np.ndarray], by_label: bool) -> DataFrame:
    """``(features, label, weight)``: the bins of the rows, each combination once, with the mean
    label, or once a label, and the number of rows."""
    binned = with_bins(train.select("features", F.col("label").cast("double").alias("label")), cuts, "x").select("x", "label")
    keys = ["x", "label"] if by_label else ["x"]
    found = binned.groupBy(*keys).agg(F.count("*").cast("double").alias("weight"), *([] if by_label else [F.avg("label").alias("label")]))
    return found.select(as_vector("x").alias("features"), "label", "weight")


def packed_cells(train: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``(x, label, weight)``: the bins of the rows as bytes, each combination once, with the mean
    label and the number of rows."""

    @F.arrow_udf("binary")
    def packed(features: pa.Array) -> pa.Array:
        if not len(features):
            return pa.array([], pa.binary())
        x = _binned(_matrix(features), cuts).astype(np.uint8)
        return pa.array([row.tobytes() for row in x], pa.binary())

    binned = train.select(packed(vector_to_array("features")).alias("x"), F.col("label").cast("double").alias("label"))
    return binned.groupBy("x").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))


class OnBins:
    """A tree model of bins that takes the rows as they are; its trees split at bin numbers."""

    def __init__(self, model, cuts: list[np.ndarray]):
        self.model, self.cuts = model, cuts

    def __getattr__(self, name: str):
        if name in ("model", "cuts"):
            raise AttributeError(name)
        return getattr(self.model, name)

    def transform(self, rows: DataFrame) -> DataFrame:
        given = with_bins(rows, self.cuts, "_bins").withColumnRenamed("features", "_given")
        told = self.model.transform(given.withColumn("features", as_vector("_bins")))
        added = [c for c in told.columns if c not in (*rows.columns, "_given", "_bins")]
        return told.select(*[F.col("_given").alias(c) if c == "features" else c for c in rows.columns], *added)
