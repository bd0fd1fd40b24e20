"""Regression trees by squared error on bins: those of a forest in the same scans, or boosted ones in turn.

Rows are packed once into blocks of bins that stay in the executors' memory or on their disks. A
level takes one short job on these blocks: tasks add weights and labels up by node, feature and bin, the best
split of every node is found from the sums, and only splits, or the sums of one tree's level, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_functions_of
from .boosting import _binned, _matrix
from .cells import OnBins
from .lloyd import GOLDEN, MIX_A, MIX_B, SENT_AT_ONCE

ship_functions_of(__name__)

BLOCK_ROWS = 65_536
# Numbers of a table of nodes and joint bins; few enough for the caches, as rows go to any of them.
TABLE, MOST_JOINT = 1 << 16, 1 << 11
# Nodes of a tree whose sums are sent at once, at most, and numbers of these; a task holds the sums of some trees.
NODES, SENT = 512, 1 << 18
# After so many rounds the predictions of all rows are kept anew, so a scan evaluates few trees.
SAVE_ROUNDS = 4
# A split gains more than the rounding of the sums it is made of.
ROUNDING = 1e-12
# A split as ``_best`` returns it: sums of the left side and of the whole node.
GAIN, FEATURE, BIN, LEFT_W, LEFT_S, WHOLE_W, WHOLE_S = range(7)

# Bins of a block (features x rows), its labels and weights; for boosting, labels less the predictions so far.
Block = tuple[np.ndarray, ...]


@dataclass
class Tree:
    """Nodes by number: rows with a bin up to ``cut`` go to ``left``, others to the next number. A leaf
    is its own left node, and no bin is above its cut."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(1, np.intp))
    cut: np.ndarray = field(default_factory=lambda: np.full(1, 255, np.uint8))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.intp))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))
    depth: int = 0
    # Nodes of the last level.
    open: np.ndarray = field(default_factory=lambda: np.zeros(1, np.intp))

    def split(self, best: np.ndarray) -> np.ndarray:
        """Split the open nodes, whose children are open then; whether each was split."""
        if not self.depth:
            self.value[0], self.weight[0] = best[0, WHOLE_S] / max(best[0, WHOLE_W], 1e-300), best[0, WHOLE_W]
        grow = best[:, GAIN] > 0
        at, b, first = self.open[grow], best[grow], len(self.feature)
        self.feature[at], self.cut[at], self.gain[at] = b[:, FEATURE], b[:, BIN], b[:, GAIN]
        self.left[at] = first + 2 * np.arange(len(at))
        self.open = first + np.arange(2 * len(at))
        weights = np.column_stack([b[:, LEFT_W], b[:, WHOLE_W] - b[:, LEFT_W]]).ravel()
        sums = np.column_stack([b[:, LEFT_S], b[:, WHOLE_S] - b[:, LEFT_S]]).ravel()
        more = Tree(np.zeros(2 * len(at), np.intp), np.full(2 * len(at), 255, np.uint8), self.open, sums / np.maximum(weights, 1e-300), weights, np.zeros(2 * len(at)))
        for name in ("feature", "cut", "left", "value", "weight", "gain"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(more, name)]))
        self.depth += bool(len(at))
        return grow

    def lighter(self) -> np.ndarray:
        """The side of the lighter child of each pair of open nodes."""
        return self.weight[self.open].reshape(-1, 2).argmin(axis=1)

    def places(self, x: np.ndarray, rows: np.ndarray, steps: int | None = None) -> np.ndarray:
        """The node after so many steps (all) of these rows of bins (features x rows)."""
        at, bins, column = np.zeros(len(rows), np.intp), x.ravel(), self.feature * x.shape[1]
        for _ in range(self.depth if steps is None else steps):
            right = bins.take(column.take(at) + rows) > self.cut.take(at)
            at = self.left.take(at) + right
        return at

    def gains(self, width: int) -> np.ndarray:
        return np.bincount(self.feature, self.gain, width)

    def __str__(self) -> str:
        inner = np.flatnonzero(self.left != np.arange(len(self.left)))
        lines = [f"  {i}: bin {self.feature[i]} <= {self.cut[i]} ? {self.left[i]}" for i in inner.tolist()]
        leaves = [f"  {i}: {self.value[i]!r}" for i in sorted(set(range(len(self.left))) - set(inner.tolist()))]
        return "\n".join([*lines, *leaves])


@dataclass
class Trees:
    """The sum of weighted trees, or the mean of a forest's, whose gains count by their share of a tree's."""

    trees: list[Tree]
    treeWeights: list[float]
    width: int
    by_tree: bool

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:
        """Shares of the features in what all splits gained."""
        gains = [t.gains(self.width) for t in self.trees]
        total = sum((g / (g.sum() or 1.0) if self.by_tree else g for g in gains), np.zeros(self.width))
        return Vectors.dense(total / (total.sum() or 1.0))

    @property
    def toDebugString(self) -> str:
        return "\n".join([f"{len(self.trees)} trees", *[f"Tree {i} (weight {w})\n{t}" for i, (t, w) in enumerate(zip(self.trees, self.treeWeights))]])

    def predicted(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(x.shape[1]), np.zeros(x.shape[1])
        for tree, weight in zip(self.trees, self.treeWeights):
            out += weight * tree.value.take(tree.places(x, rows))
        return out / len(self.trees) if self.by_tree else out


class BinnedTrees(OnBins):
    """Trees of bins that take the rows as they are."""

    def transform(self, rows: DataFrame) -> DataFrame:
        model, cuts = self.model, self.cuts

        @F.arrow_udf("double")
        def prediction(features: pa.Array) -> pa.Array:
            if not len(features):
                return pa.array([], pa.float64())
            return pa.array(model.predicted(_bins(_matrix(features), cuts)))

        return rows.withColumn("prediction", prediction(vector_to_array("features")))


def _bins(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of values, features x rows."""
    return np.ascontiguousarray(_binned(values, cuts).T.astype(np.uint8))


# --- sums ---------------------------------------------------------------------------------


def _joint(sizes: Sequence[int], most: int) -> list[list[int]]:
    """Features whose bins are counted together: a table of all their combinations is small."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        for i, (cells, some) in enumerate(groups):
            if cells * sizes[f] <= most:
                groups[i] = (cells * sizes[f], [*some, f])
                break
        else:
            groups.append((sizes[f], [f]))
    return [some for _, some in groups]


class _Sums:
    """Adds weights and weighted labels of rows up by node, feature and bin."""

    def __init__(self, sizes: Sequence[int], nodes: int):
        self.sizes, self.nodes = list(sizes), nodes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.groups = _joint(sizes, max(max(sizes), min(MOST_JOINT, TABLE // max(1, nodes))))
        self.shapes = [[sizes[f] for f in some] for some in self.groups]
        self.tables = [np.zeros((2, nodes * int(np.prod(shape)))) for shape in self.shapes]

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        """A number for each row's bins in the features of each group."""
        out = []
        for some in self.groups:
            code = x[some[0]].astype(np.uint16)
            for f in some[1:]:
                code *= np.uint16(self.sizes[f])
                code += x[f]
            out.append(code)
        return out

    def add(self, codes: list[np.ndarray], rows: np.ndarray | None, node: np.ndarray, weight: np.ndarray | None, label: np.ndarray) -> None:
        """``rows``: of the block, all if not given; ``weight``: 1 if not given; ``label`` is weighted."""
        for code, table, shape in zip(codes, self.tables, self.shapes):
            cell = node * int(np.prod(shape))
            cell += code if rows is None else code.take(rows)
            table[0] += np.bincount(cell, weight, table.shape[1])
            table[1] += np.bincount(cell, label, table.shape[1])

    def taken(self) -> np.ndarray:
        """2 x nodes x bins of all features, of what was added since the last call."""
        out = np.empty((2, self.nodes, int(self.starts[-1])))
        for some, table, shape in zip(self.groups, self.tables, self.shapes):
            whole = table.reshape(2, self.nodes, *shape)
            for i, f in enumerate(some):
                others = tuple(2 + j for j in range(len(some)) if j != i)
                out[:, :, self.starts[f] : self.starts[f + 1]] = whole.sum(axis=others) if others else whole
            table[:] = 0
        return out


def _both(parents: np.ndarray, found: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Sums of the children, of those of their parents and of the child on this side of each."""
    pairs, at = np.empty((2, len(side), 2, found.shape[2])), np.arange(len(side))
    pairs[:, at, side] = found
    pairs[:, at, 1 - side] = parents - found
    return pairs.reshape(2, -1, found.shape[2])


def _best(sums: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """The split of each node by which squared differences fall most; of equal ones the first feature and bin."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    w, s = sums[0, :, : sizes[0]].sum(axis=1), sums[1, :, : sizes[0]].sum(axis=1)
    out = np.zeros((sums.shape[1], 7))
    out[:, WHOLE_W], out[:, WHOLE_S] = w, s
    nodes = np.arange(len(out))
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = s * s / w
        for f, size in enumerate(sizes):
            if size < 2:
                continue
            left_w, left_s = sums[:, :, starts[f] : starts[f + 1] - 1].cumsum(axis=2)
            right_w, right_s = w[:, None] - left_w, s[:, None] - left_s
            parts = left_s * left_s / left_w + right_s * right_s / right_w
            gain = parts - whole[:, None]
            gain[~((left_w > 0) & (right_w > 0) & (gain > ROUNDING * parts))] = 0.0
            b = gain.argmax(axis=1)
            found = gain[nodes, b]
            better = found > out[:, GAIN] * (1 + ROUNDING)
            at = nodes[better]
            made = [found, np.full(len(b), f), b, left_w[nodes, b], left_s[nodes, b]]
            for column, values in zip((GAIN, FEATURE, BIN, LEFT_W, LEFT_S), made):
                out[at, column] = values[better]
    return out


# --- rows ---------------------------------------------------------------------------------


def _packed(rows: DataFrame, binned: Callable[[pa.Array], np.ndarray], width: int) -> RDD:
    """Blocks ``(bins, label, weight)`` of rows ``(x, label, weight)`` in their order; ``binned`` reads bins (features x rows)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Block] = []

        def block() -> pa.RecordBatch:
            made = [np.concatenate([h[i] for h in held], axis=-1).tobytes() for i in range(3)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([m], pa.binary()) for m in made], ["x", "label", "weight"])

        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            if np.isnan(label).any():
                raise ValueError("a label is missing")
            held.append((binned(batch.column(0)), label, batch.column(2).to_numpy(zero_copy_only=False).astype(float)))
            if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                yield block()
        if held:
            yield block()

    found = rows.mapInArrow(pack, "x binary, label binary, weight binary").rdd
    return found.map(lambda r: (np.frombuffer(r[0], np.uint8).reshape(width, -1), np.frombuffer(r[1]), np.frombuffer(r[2])))


def packed_bins(cells: DataFrame, width: int) -> RDD:
    """Blocks of the rows ``(x, label, weight)`` of ``cells.packed_cells``."""

    def binned(x: pa.Array) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, width).T)

    return _packed(cells.select("x", "label", "weight"), binned, width)


# --- forest -------------------------------------------------------------------------------


def _poisson() -> np.ndarray:
    """Draws of a Poisson number of mean 1, by 16 random bits."""
    share, below, out = np.exp(-1.0), 0.0, np.zeros(1 << 16, np.uint8)
    for k in range(1, 10):
        below += share
        out[int(round(below * (1 << 16))) :] = k
        share /= k
    return out


def _bits(rows: np.ndarray, salt: int) -> np.ndarray:
    """64 random bits a row, the same whenever the row is read again."""
    z = rows * np.uint64(GOLDEN) + np.uint64((salt * GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def _bagged(trees: list[Tree], counted: list[np.ndarray], level: int, sizes: Sequence[int], at_once: int, seed: int, shift: float) -> Callable:
    """What a task does for a level: the sums of all trees' counted nodes, a tree after the other."""
    most = min(at_once, max(len(c) for c in counted))

    def add(task: int, blocks: Iterator[Block]) -> Iterator[tuple[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        sums, times, held, row = _Sums(sizes, most), _poisson(), [], task << 40
        for x, label, _ in blocks:
            held.append((x, label - shift, np.arange(row, row + len(label), dtype=np.uint64), sums.codes(x)))
            row += len(label)
        for t, tree in enumerate(trees):
            if not t % 4:
                bits = [_bits(rows, seed * 1_000_003 + t // 4) for _, _, rows, _ in held]
            for low in range(0, len(counted[t]), at_once):
                some = counted[t][low : low + at_once]
                slot = np.full(len(tree.feature), -1, np.intp)
                slot[some] = np.arange(len(some))
                for (x, label, _, codes), b in zip(held, bits):
                    n = times.take((b >> np.uint64(16 * (t % 4))) & np.uint64(0xFFFF))
                    rows = np.flatnonzero(n)
                    node = slot.take(tree.places(x, rows, level))
                    here = node >= 0
                    if not here.all():
                        rows, node = rows[here], node[here]
                    weight = n.take(rows).astype(float)
                    sums.add(codes, rows, node, weight, label.take(rows) * weight)
                weights, labels = sums.taken()[:, : len(some)]
                # Weights are counts of a task's rows.
                yield (t, low), (weights.astype(np.uint32), labels)

    return add


def forest(train: DataFrame, cuts: list[np.ndarray], trees: int, depth: int, seed: int) -> BinnedTrees:
    """Trees of at most ``depth`` levels, each on its own draw of the rows with replacement.

    A row is drawn a Poisson number of times, which goes by its place in its task. All trees grow in
    the same scans; a level's sums are added up and searched by the tree, spread over the executors.
    """
    sizes = [len(c) + 1 for c in cuts]
    at = train.agg(F.avg("label").alias("m"), F.count("*").alias("n")).first()
    if not at["n"]:
        raise ValueError("no training rows")
    shift = at["m"] or 0.0
    read = train.select(vector_to_array("features").alias("x"), "label", F.lit(1.0).alias("weight"))
    blocks = _packed(read, lambda x: _bins(_matrix(x), cuts), len(sizes)).persist(StorageLevel.MEMORY_AND_DISK)
    grown = [Tree() for _ in range(trees)]
    at_once = max(1, min(NODES, SENT // sum(sizes)))
    parts = max(1, min(trees, 2 * train.sparkSession.sparkContext.defaultParallelism))

    def added(found: Iterator[tuple]) -> Iterator[tuple]:
        held, parents = {}, {}
        for key, (weights, labels) in found:
            if key[1] < 0:
                parents[key[0]] = np.stack([weights, labels])
            elif key in held:
                held[key][0] += weights
                held[key][1] += labels
            else:
                held[key] = np.stack([weights, labels]).astype(float)
        for (t, low), sums in held.items():
            yield (t, low), _both(parents.pop(t), sums, sides[t]) if parents else sums

    def searched(found: Iterator[tuple]) -> Iterator[tuple]:
        for key, sums in found:
            yield key, _best(sums, sizes)

    whole = None
    try:
        for level in range(depth):
            if not any(len(t.open) for t in grown):
                break
            counted, sides, split = [t.open for t in grown], {}, whole
            if split is not None:
                # The lighter child of each split node is counted, the other is what it leaves of its parent.
                sides = {t: tree.lighter() for t, tree in enumerate(grown) if len(tree.open)}
                counted = [tree.open.reshape(-1, 2)[np.arange(len(sides[t])), sides[t]] if t in sides else tree.open for t, tree in enumerate(grown)]
            found = blocks.mapPartitionsWithIndex(_bagged(grown, counted, level, sizes, at_once, seed, shift))
            if split is not None:
                kept = {t: grew[t] for t in sides}
                found = found.union(split.flatMap(lambda r, kept=kept: [((r[0][0], -1), tuple(r[1][:, kept[r[0][0]]]))] if r[0][0] in kept else []))
            of = found.partitionBy(parts, lambda k: k[0] + max(k[1], 0) // at_once).mapPartitions(added)
            # Sums of several parts a tree are not kept; nor are the last.
            whole = of.persist(StorageLevel.MEMORY_AND_DISK) if level + 1 < depth and all(2 * len(t.open) <= at_once for t in grown) else None
            best = dict((of if whole is None else whole).mapPartitions(searched).collect())
            if split is not None:
                split.unpersist()
            grew = {}
            for t, tree in enumerate(grown):
                if len(tree.open):
                    grew[t] = tree.split(np.concatenate([best[t, low] for low in range(0, len(tree.open), at_once)]))
    finally:
        blocks.unpersist()
        if whole is not None:
            whole.unpersist()
    for tree in grown:
        tree.value += shift
    return BinnedTrees(Trees(grown, [1.0] * trees, len(sizes), True), cuts)


# --- boosting -----------------------------------------------------------------------------


class _Here:
    """Blocks ``(bins, difference, weight)`` in this process; no weight if each is 1."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    def total(self, add: Callable) -> np.ndarray:
        return reduce(np.add, add(iter(self.blocks)))

    def move(self, change: Callable) -> None:
        self.blocks = [change(b) for b in self.blocks]


class _There:
    """The same in the executors' memory or on their disks."""

    def __init__(self, blocks: RDD):
        self.blocks, self.before = blocks, None

    def total(self, add: Callable) -> np.ndarray:
        sent = self.sent(add)
        if self.before is not None:
            # The new blocks have been made by now.
            self.before.unpersist()
            self.before = None
        return sent

    def sent(self, add: Callable) -> np.ndarray:
        bytes_of = getattr(add, "sends", 0) * self.blocks.getNumPartitions()
        return self.blocks.mapPartitions(add).treeReduce(np.add, 1 if bytes_of <= SENT_AT_ONCE else 2)

    def move(self, change: Callable) -> None:
        self.before, self.blocks = self.blocks, self.blocks.map(change).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        for blocks in (self.before, self.blocks):
            if blocks is not None:
                blocks.unpersist()


def _lessened(difference: np.ndarray, x: np.ndarray, trees: Sequence[Tree], weights: Sequence[float]) -> np.ndarray:
    rows, out = np.arange(x.shape[1]), difference.copy()
    for tree, weight in zip(trees, weights):
        out -= (weight * tree.value).take(tree.places(x, rows))
    return out


def _wanted(tree: Tree, counted: np.ndarray, late: list[Tree], weights: list[float], first: bool, sizes: Sequence[int]) -> Callable:
    """What a task does for a level of one tree: the sums of the counted nodes."""
    level = tree.depth

    def add(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        sums = _Sums(sizes, len(counted))
        slot = np.full(len(tree.feature), -1, np.intp)
        slot[counted] = np.arange(len(counted))
        for x, difference, weight in blocks:
            # Squared errors fall along twice the differences; the first tree is of the labels.
            wanted = difference if first else 2 * _lessened(difference, x, late, weights)
            rows, codes = None, sums.codes(x)
            node = np.zeros(len(wanted), np.intp)
            if level:
                node = slot.take(tree.places(x, np.arange(len(wanted)), level))
                rows = np.flatnonzero(node >= 0)
                node, wanted = node.take(rows), wanted.take(rows)
            if weight is not None:
                weight = (weight if rows is None else weight.take(rows)).astype(float)
                wanted = wanted * weight
            sums.add(codes, rows, node, weight, wanted)
        yield sums.taken()

    add.sends = 16 * len(counted) * sum(sizes)
    return add


def _boost(rows: _Here | _There, sizes: Sequence[int], rounds: int, depth: int, step: float) -> tuple[list[Tree], list[float]]:
    trees, weights, late = [], [], 0
    for m in range(rounds):
        tree, sums = Tree(), None
        for _ in range(depth):
            counted = tree.open
            if sums is not None:
                # The lighter child of each split node is counted, the other is what it leaves of its parent.
                side = tree.lighter()
                counted = tree.open.reshape(-1, 2)[np.arange(len(side)), side]
            found = rows.total(_wanted(tree, counted, trees[late:], weights[late:], not m, sizes))
            if sums is not None:
                found = _both(sums, found, side)
            grew = tree.split(_best(found, sizes))
            sums = found[:, grew]
            if not grew.any():
                break
        trees.append(tree)
        weights.append(step if m else 1.0)
        if len(trees) - late == SAVE_ROUNDS:
            new, of = trees[late:], weights[late:]
            rows.move(lambda b, new=new, of=of: (b[0], _lessened(b[1], b[0], new, of), b[2]))
            late = len(trees)
    return trees, weights


def boosted(packed: RDD, cuts: list[np.ndarray], rounds: int, depth: int, step: float) -> BinnedTrees:
    """The first tree follows the labels, each later one twice the differences to the predictions so far,
    and adds ``step`` of its values. Rows of a single task are worked on there, in one job."""
    sizes = [len(c) + 1 for c in cuts]
    # Every pass reads the blocks, so weights take as few bytes as they can.
    blocks = packed.map(lambda b: (b[0], b[1], None if (b[2] == 1).all() else b[2].astype(np.min_scalar_type(int(b[2].max())))))
    if packed.getNumPartitions() == 1:
        (trees, weights), = blocks.mapPartitions(lambda b: [_boost(_Here(list(b)), sizes, rounds, depth, step)]).collect()
    else:
        there = _There(blocks.persist(StorageLevel.MEMORY_AND_DISK))
        try:
            trees, weights = _boost(there, sizes, rounds, depth, step)
        finally:
            there.release()
    return BinnedTrees(Trees(trees, weights, len(sizes), False), cuts)
