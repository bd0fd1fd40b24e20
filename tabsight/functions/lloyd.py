"""Many k-means models over the same rows, fitted in the same scans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_functions_of
from .columns import col

ship_functions_of(__name__)

# Rows whose distances to all centres are held at once; few enough for the caches, and less of wide rows.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 18
# Bytes of sums that the tasks of a pass send to the driver; of more, tasks add them up first.
SENT_AT_ONCE = 1 << 24
# Fixed values of the row hash (splitmix64).
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
# Rounds in which rows far from the centres chosen so far become candidates.
SEED_ROUNDS = 2
TOLERANCE = 1e-4


@dataclass
class Fit:
    """One model: its centres, the cost (sum of squared distances) and the rounds it took."""

    k: int
    centres: np.ndarray
    cost: float
    rounds: int


def _blocks(batch: pa.RecordBatch, shift: np.ndarray, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        columns = [c.to_numpy(zero_copy_only=False) for c in part.columns[: len(shift)]]
        yield part, np.column_stack(columns).astype(float) - shift


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.maximum(d, 0.0)


def _draws(rows: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) a row, the same whenever the row is read again."""
    z = rows.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64((salt * GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


class Rows:
    """A saved table of double columns ``features`` and a row number ``row``, read by every pass.

    Values are taken less the column's mean, so that distances lose no digits. The passes read
    blocks of them (``blocks``: row numbers, and rows x columns), made once from the saved table and
    kept until ``release``; a lost block is made again. A pass is one short job on these blocks.
    """

    def __init__(self, saved: DataFrame, features: Sequence[str], row: str):
        self.table = saved.select(*[col(f) for f in features], col(row).cast("bigint").alias("_row"))
        wrong = [F.count_if(col(f).isNull() | F.isnan(col(f)) | (F.abs(col(f)) == float("inf"))) for f in features]
        # 32 functions a scan stay in generated code.
        means, bad = [], 0
        for at in range(0, len(features), 16):
            some = features[at : at + 16]
            found = self.table.agg(*[F.avg(col(f)) for f in some], *wrong[at : at + 16]).first()
            means += [m or 0.0 for m in found[: len(some)]]
            bad += sum(found[len(some) :])
        if bad:
            raise ValueError("k-means needs finite values in every row")
        self.shift = np.array(means)
        self.passes = 0
        shift, width = self.shift, len(features)
        size = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(1, width))))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, xs = [], []
                for part, x in _blocks(batch, shift, size):
                    rows.append(part.column(width).to_numpy().tobytes())
                    xs.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(xs, pa.binary())], ["row", "x"])

        packed = self.table.mapInArrow(pack, "row binary, x binary").rdd
        arrays = packed.map(lambda r: (np.frombuffer(r[0], np.int64), np.frombuffer(r[1]).reshape(-1, width)))
        self.blocks = arrays.persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.blocks.unpersist()

    def sums(self, groups: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each group of centres the rows nearest to each centre, their sums, and the whole cost.

        A task adds its rows up for every group and sends a row for each centre, however
        many rows it reads; if that is much in all, tasks add theirs up among each other first.
        """
        self.passes += 1
        all_centres = np.concatenate(groups)
        ends = np.cumsum([len(g) for g in groups])
        starts, width = ends - [len(g) for g in groups], len(self.shift)
        same_size: list[tuple[int, int, int]] = []
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            k = hi - lo
            if same_size and same_size[-1][2] == k:
                lo = same_size.pop()[0]
            same_size.append((lo, hi, k))

        def add(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
            # Sums, then the count of each centre; then the cost of each group.
            held, costs = np.zeros((len(all_centres), width + 1)), np.zeros(len(ends))
            twice, own = -2 * all_centres, (all_centres * all_centres).sum(axis=1)[:, None]
            for _, x in blocks:
                # Squared distances less the row's own square, centres x rows.
                d, far = twice @ x.T, (x * x).sum(axis=1)
                d += own
                mine, of = np.empty(d.shape), 0
                for lo, hi, k in same_size:
                    # Groups of one size lie side by side: the nearest centres of all at once.
                    part = d[lo:hi].reshape(-1, k, len(x))
                    least = part.min(axis=1)
                    near = part == least[:, None, :]
                    if np.count_nonzero(near) > least.size:
                        # Of equally near centres the first.
                        near &= np.cumsum(near, axis=1) == 1
                    mine[lo:hi] = near.reshape(hi - lo, len(x))
                    costs[of : of + len(least)] += np.maximum(least + far, 0.0).sum(axis=1)
                    of += len(least)
                held[:, :-1] += mine @ x
                held[:, -1] += mine.sum(axis=1)
            yield np.concatenate([held.ravel(), costs])

        sent = 8 * (len(all_centres) * (width + 1) + len(ends)) * self.blocks.getNumPartitions()
        depth = 1 if sent <= SENT_AT_ONCE else 2
        total = self.blocks.mapPartitions(add).treeReduce(np.add, depth)
        costs, total = total[-len(ends) :], total[: -len(ends)].reshape(-1, width + 1)
        return [(total[a:b, -1], total[a:b, :-1], float(c)) for a, b, c in zip(starts, ends, costs)]

    def candidates(self, chosen: Sequence[np.ndarray], costs: Sequence[float], wanted: int, salt: int) -> list[np.ndarray]:
        """For each set of centres about ``wanted`` further rows, drawn by their squared distance."""
        self.passes += 1
        width, all_centres = len(self.shift), np.concatenate(chosen)
        ends = np.cumsum([len(g) for g in chosen])

        def draw(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, list[float]]]:
            for rows, x in blocks:
                d, lo = _distances(x, all_centres), 0
                for s, hi in enumerate(ends):
                    share = wanted * d[:, lo:hi].min(axis=1) / costs[s] if costs[s] > 0 else np.zeros(len(x))
                    hit = np.flatnonzero(_draws(rows, salt * len(ends) + s) < share)
                    lo = hi
                    yield from zip([s] * len(hit), rows[hit].tolist(), x[hit].tolist())

        found = self.blocks.mapPartitions(draw).collect()
        more = [sorted((row, x) for of, row, x in found if of == s) for s in range(len(chosen))]
        return [np.concatenate([c, np.array([x for _, x in m]).reshape(-1, width)]) for c, m in zip(chosen, more)]

    def seeds(self, starts: int, wanted: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each start some candidates and how many rows each stands for."""
        first = self.table.orderBy(F.xxhash64("_row", F.lit(seed)), "_row").limit(starts).collect()
        points = [np.array([list(r)[:-1]], dtype=float) - self.shift for r in first]
        chosen = [points[s % len(points)] for s in range(starts)]
        for again in range(SEED_ROUNDS):
            costs = [cost for _, _, cost in self.sums(chosen)]
            chosen = self.candidates(chosen, costs, wanted, seed + again)
        return [(c, n) for c, (n, _, _) in zip(chosen, self.sums(chosen))]


def _spread_out(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of a few weighted points, each drawn by its squared distance from those before."""
    rng = np.random.default_rng(seed)
    weights = weights if weights.sum() > 0 else np.ones(len(points))
    taken = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(taken) < k:
        chance = weights * _distances(points, points[taken]).min(axis=1)
        chance = chance if chance.sum() > 0 else np.ones(len(points))
        taken.append(int(rng.choice(len(points), p=chance / chance.sum())))
    return points[taken]


def lloyd(rows: Rows, first: Sequence[np.ndarray], max_iter: int) -> list[Fit]:
    """Move the centres of all models in the same scans until each model stands still.

    A model that stands still (no centre moves by more than ``TOLERANCE``) leaves the scans, so
    there are as many as the slowest model needs, and one for the costs of all.
    """
    centres, done = [c.copy() for c in first], [0] * len(first)
    active = list(range(len(first)))
    for round_ in range(1, max_iter + 1):
        if not active:
            break
        moving = []
        for m, (n, total, _) in zip(active, rows.sums([centres[m] for m in active])):
            # A centre without rows stays where it is.
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1.0)[:, None], centres[m])
            still = ((moved - centres[m]) ** 2).sum(axis=1).max() <= TOLERANCE**2
            centres[m], done[m] = moved, round_
            if not still:
                moving.append(m)
        active = moving
    costs = [cost for _, _, cost in rows.sums(centres)]
    return [Fit(len(c), c + rows.shift, cost, n) for c, cost, n in zip(centres, costs, done)]


def fit_all(rows: Rows, ks: Sequence[int], starts: int, seed: int, max_iter: int) -> dict[tuple[int, int], Fit]:
    """A model for each number of centres and each start, keyed by both.

    The models of a start share its candidates, drawn from all rows as k-means|| does, for
    the largest k of all.
    """
    tasks = [(k, s) for k in ks for s in range(starts)]
    drawn = rows.seeds(starts, 2 * max(ks), seed)
    first = [_spread_out(*drawn[s], k, seed + 1000 * k + s) for k, s in tasks]
    return dict(zip(tasks, lloyd(rows, first, max_iter)))


def assign(df: DataFrame, features: Sequence[str], centres: dict[str, np.ndarray]) -> DataFrame:
    """``df`` with the number of the nearest centre under each name."""
    place = [df.columns.index(f) for f in features]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = np.column_stack([part.column(i).to_numpy(zero_copy_only=False) for i in place]).astype(float)
                found = [_distances(x - c[0], c - c[0]).argmin(axis=1).astype(np.int32) for c in centres.values()]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, found)], names)

    names = [*df.columns, *centres]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.IntegerType()) for c in centres]])
    return df.mapInArrow(near, schema)
