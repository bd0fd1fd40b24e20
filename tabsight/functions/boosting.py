"""Multinomial gradient boosting over binned features: a tree for each class a round.

The trees of all classes grow in the same scans of a saved table of bins. A scan of a
level adds gradients up by class, node, feature and bin inside each task, Spark finds the best
split of every node from the summed histograms, and only the splits come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship_functions_of

ship_functions_of(__name__)

MAX_BINS = 32
# Rank error of the cut points of the bins, over all rows.
CUT_ERROR = 1 / 1024
# Rows whose histogram cells are held at once, and cells that a task holds for a scan.
BLOCK_ROWS, CELLS = 4096, 1 << 22
# After so many rounds the scores of all rows are written anew, so a scan evaluates few trees.
SAVE_ROUNDS = 8
LEAST_GAIN = 1e-9
# Left and whole sums of gradients, second derivatives and rows.
CELL = ["slot", "bin", "gl", "hl", "nl", "g", "h", "n"]
HISTOGRAM = "slot bigint, bin bigint, gl double, hl double, nl double, g double, h double, n double"


@dataclass
class Tree:
    """Nodes in heap order; ``feature`` is -1 in leaves, rows with a bin up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def places(self, x: np.ndarray) -> np.ndarray:
        """The node each row of bins ends in."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[at]
            if (f < 0).all():
                return at
            at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > self.cut[at]))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def _binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, values[:, i], side="left") for i, c in enumerate(cuts)])


def _raised(scores: np.ndarray, x: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    out = scores.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.value[tree.places(x)]
    return out


def _shares(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class MultinomialBoosting:
    """A fitted model; ``deviance`` is the mean log-loss of the training rows before each round
    and after the last."""

    cuts: list[np.ndarray]
    start: np.ndarray
    rounds: list[list[Tree]]
    gains: np.ndarray
    deviance: list[float] = field(default_factory=list)

    @property
    def numClasses(self) -> int:
        return len(self.start)

    @property
    def featureImportances(self) -> DenseVector:
        """Shares of the features in what all splits gained."""
        return Vectors.dense(self.gains / (self.gains.sum() or 1.0))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``probability`` (an array, by class) and ``prediction`` (the likeliest class,
        the first of equals) from the vector ``features``."""
        cuts, start, rounds = self.cuts, self.start, self.rounds

        @F.arrow_udf("array<double>")
        def probability(features: pa.Array) -> pa.Array:
            if not len(features):
                return pa.array([], pa.list_(pa.float64()))
            x = _binned(_matrix(features), cuts)
            return _lists(_shares(_raised(np.tile(start, (len(x), 1)), x, rounds)), pa.float64())

        shown = rows.withColumn("probability", probability(vector_to_array("features")))
        likeliest = F.array_position("probability", F.array_max("probability")) - 1
        return shown.withColumn("prediction", likeliest.cast("double"))


class _Rows:
    """The training rows: bins, label and the scores as of the last writing."""

    def __init__(self, train: DataFrame, cuts: list[np.ndarray], start: np.ndarray):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _binned(_matrix(batch.column(0)), cuts) if batch.num_rows else np.zeros((0, len(cuts)))
                scores = np.tile(start, (len(x), 1))
                yield pa.RecordBatch.from_arrays(
                    [_lists(x.astype(np.int8), pa.int8()), batch.column(1), _lists(scores, pa.float64())], ["x", "label", "scores"]
                )

        rows = train.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"))
        self.table = materialise(rows.mapInArrow(cut, "x array<tinyint>, label int, scores array<double>"), "boosted")
        self.late: list[list[Tree]] = []
        self.features, self.classes = len(cuts), len(start)

    def add(self, trees: list[Tree]) -> None:
        self.late.append(trees)
        if len(self.late) < SAVE_ROUNDS:
            return
        late = self.late

        def raise_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    scores = _raised(_matrix(batch.column(2)), _matrix(batch.column(0)), late)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(scores, pa.float64())], batch.schema.names)

        self.table = materialise(self.table.mapInArrow(raise_, self.table.schema), "boosted")
        self.late = []

    def splits(self, trees: list[Tree], level: int, least_rows: int) -> tuple[dict[tuple[int, int], tuple], float]:
        """(class, node) -> gain, feature, bin, left and whole sums of the best split of every
        node of a level; and the loss of all rows."""
        cells = 2**level * self.features * MAX_BINS * 3
        at_once = max(1, CELLS // cells)
        found: dict[tuple[int, int], tuple] = {}
        for low in range(0, self.classes, at_once):
            more, loss = self._splits(trees, level, range(low, min(low + at_once, self.classes)), least_rows)
            found.update(more)
        return found, loss

    def _splits(self, trees: list[Tree], level: int, some: range, least_rows: int) -> tuple[dict[tuple[int, int], tuple], float]:
        late, first, nodes, width, classes = self.late, 2**level - 1, 2**level, self.features, self.classes

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, loss = np.zeros((len(some), 3, nodes * width * MAX_BINS)), 0.0
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(lo, BLOCK_ROWS)
                    x = _matrix(part.column(0))
                    p = _shares(_raised(_matrix(part.column(2)), x, late))
                    label = part.column(1).to_numpy()
                    loss -= float(np.log(np.maximum(p[np.arange(len(p)), label], 1e-300)).sum())
                    for i, k in enumerate(some):
                        at = trees[k].places(x) - first
                        here = at >= 0
                        q = p[here, k]
                        cell = ((at[here, None] * width + np.arange(width)) * MAX_BINS + x[here]).ravel()
                        for j, w in enumerate(((label[here] == k) - q, q * (1 - q), np.ones(len(q)))):
                            held[i, j] += np.bincount(cell, np.repeat(w, width), held.shape[2])
            # Left sums of all bins of the nodes that have rows: they add up over tasks as counts do.
            whole = held.reshape(len(some), 3, nodes, width, MAX_BINS)
            i, node = np.nonzero(whole[:, 2, :, 0].sum(axis=2))
            left = whole[i, :, node].cumsum(axis=3)
            sums = [left[:, j].ravel() for j in range(3)] + [np.repeat(left[:, j, :, -1], MAX_BINS) for j in range(3)]
            slot = ((some.start + i) * nodes + node)[:, None] * width + np.arange(width)
            keys = [np.repeat(slot, MAX_BINS), np.tile(np.arange(MAX_BINS), slot.size)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*keys, *sums)], CELL)
            # One more slot holds the loss.
            last = [classes * nodes * width, 0, 0.0, 0.0, 0.0, loss, 0.0, 0.0]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in last], CELL)

        cells = self.table.mapInArrow(add, HISTOGRAM).groupBy("slot", "bin").agg(*[F.sum(c).alias(c) for c in CELL[2:]])
        # What a split lets the squared differences fall by; equal ones go to the first feature and bin.
        gain = f"if(nl >= {least_rows} AND n - nl >= {least_rows}, nl * (n - nl) / n * power(try_divide(gl, nl) - try_divide(g - gl, n - nl), 2), 0.0)"
        best = cells.groupBy(F.expr(f"slot div {width}").alias("node")).agg(
            F.expr(f"max(struct({gain} AS gain, -(slot % {width}) AS f, -bin AS bin, gl, hl, g, h))").alias("m")
        )
        # At most classes x nodes of a level.
        found = {(r["node"] // nodes, first + r["node"] % nodes): r["m"] for r in best.collect()}
        loss = found.pop((classes, first))["g"]
        return {at: (m["gain"], -m["f"], -m["bin"], m["gl"], m["hl"], m["g"], m["h"]) for at, m in found.items()}, loss


def fit(
    train: DataFrame,
    rounds: int,
    depth: int,
    step: float,
    least_rows: int = 1,
    bins: int = MAX_BINS,
) -> MultinomialBoosting:
    """Fit ``rounds`` trees of at most ``depth`` splits for each class 0, 1, ... of ``label``
    on the vectors ``features`` (finite, of one length).

    Scores start at the logarithm of the class shares. A tree follows the differences between
    a row's class and its present probability, splits by the largest drop of their squares, and its
    leaves take a Newton step for the log-loss, times ``step``. Cut points lie at quantiles of
    all rows. A round takes a scan a level, whatever the number of classes, unless their
    histograms exceed ``CELLS`` numbers; an empty table is an error.
    """
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"bins must lie between 2 and {MAX_BINS}")
    counted = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}
    if not counted:
        raise ValueError("no training rows")
    n, classes = sum(counted.values()), max(counted) + 1
    start = np.log([max(counted.get(k, 0) / n, 1e-12) for k in range(classes)])
    wide = train.select(vector_to_array("features").alias("x"))
    width = len(wide.first()["x"])
    columns = [f"f{i}" for i in range(width)]
    ranks = [i / bins for i in range(1, bins)]
    cuts = [
        np.unique(found)
        for found in wide.select(*[F.col("x")[i].alias(c) for i, c in enumerate(columns)]).approxQuantile(columns, ranks, CUT_ERROR)
    ]
    rows, shrink = _Rows(train, cuts, start), step * (classes - 1) / classes
    out = MultinomialBoosting(cuts, start, [], np.zeros(width))

    def leaf(g: float, h: float) -> float:
        return shrink * g / h if h > 1e-150 else 0.0

    for _ in range(rounds):
        trees = [Tree.of_depth(depth) for _ in range(classes)]
        for level in range(depth):
            grew = False
            found, loss = rows.splits(trees, level, least_rows)
            if not level:
                out.deviance.append(loss / n)
            for (k, node), (gain, f, cut, gl, hl, g, h) in found.items():
                tree = trees[k]
                if not level:
                    tree.value[node] = leaf(g, h)
                if gain <= LEAST_GAIN:
                    continue
                grew = True
                tree.feature[node], tree.cut[node] = f, cut
                tree.value[2 * node + 1], tree.value[2 * node + 2] = leaf(gl, hl), leaf(g - gl, h - hl)
                out.gains[f] += gain
            if not grew:
                break
        out.rounds.append(trees)
        rows.add(trees)
    _, loss = rows.splits([Tree.of_depth(0) for _ in range(classes)], 0, n)
    out.deviance.append(loss / n)
    return out
