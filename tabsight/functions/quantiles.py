"""Exact order statistics without ever gathering a column.

``percentile`` keeps every distinct value of a group in one task, which a column of
10^13 amounts cannot afford. Here a mergeable KLL sketch first brackets each wanted
rank, one scan counts how many values lie below and inside each bracket, and only the
values inside the brackets (a few per thousand) are grouped and ranked. Brackets that
are still too full are narrowed by further sketch scans. The counts prove that each
rank lies in its bracket (a bracket that misses is moved), so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import AGGREGATES_PER_SCAN, all_of, any_of, col, missing_as_null

SKETCH_K = 4096
# Rank error of such a sketch is about 0.0013 at 99 % confidence.
SLACK = 0.003
GRID = 200
# Tables up to this size need no bracket: all their values may be ranked.
UNBRACKETED_ROWS = 2_000
# Most rows an open bracket may hold when its values are ranked by one task.
RANKABLE_ROWS = 4_000_000
# Group rows joined back by broadcast: small by contract, checked here.
MAX_GROUPS = 50_000


@dataclass
class _Bracket:
    """Where ranks ``first`` and ``last`` (0-based, adjacent or equal) must lie."""

    lo: float | int
    hi: float | int
    first: int
    last: int
    below: int = 0
    inside: int = 0

    @property
    def open(self) -> bool:
        return self.lo != self.hi

    @property
    def holds(self) -> bool:
        return self.below <= self.first and self.last < self.below + self.inside


@dataclass
class _Group:
    key: tuple
    counts: list[int]
    extremes: list[tuple]
    brackets: list[list[_Bracket]]

    def slots(self) -> Iterator[tuple[int, int, _Bracket]]:
        for i, row in enumerate(self.brackets):
            for j, b in enumerate(row):
                yield i, j, b


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    **tuning,
) -> dict[tuple, tuple[list[int], list[list[float | None]]]]:
    """Linear-interpolated quantiles: per key, non-null counts and a value per column and prob."""

    def ranks(p: float, n: int) -> tuple[int, int]:
        return math.floor(p * (n - 1)), math.ceil(p * (n - 1))

    doubles = missing_as_null(
        df.select(*[col(k) for k in keys], *[col(c).cast("double").alias(c) for c in columns])
    )
    result = {}
    for key, (counts, pairs) in ranked_values(
        doubles, columns, probs, ranks, keys, **tuning
    ).items():
        table = []
        for n, row in zip(counts, pairs):
            out = []
            for p, pair in zip(probs, row):
                if pair is None:
                    out.append(None)
                    continue
                lo, hi = map(float, pair)
                share = p * (n - 1) - math.floor(p * (n - 1))
                out.append(lo if lo == hi else lo + (hi - lo) * share)
            table.append(out)
        result[key] = (counts, table)
    return result


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], **tuning
) -> dict[str, tuple[int, list[float | None]]]:
    """Quantiles of whole columns, keyed by column name."""
    if not columns:
        return {}
    counts, values = exact_quantiles(df, columns, probs, **tuning)[()]
    return {c: (counts[i], values[i]) for i, c in enumerate(columns)}


def ranked_values(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    ranks,
    keys: Sequence[str] = (),
    rankable_rows: int | None = None,
    unbracketed_rows: int | None = None,
) -> dict[tuple, tuple[list[int], list[list[tuple | None]]]]:
    """Values at the 0-based ranks ``ranks(p, n) = (first, last)``, per key and column.

    The ranks must lie within one row of ``p * n``. Columns are all double or all bigint
    and free of NaN. Groups must be few (one row each comes back to the driver): callers
    pass gated categories or class labels.
    """
    limit = RANKABLE_ROWS if rankable_rows is None else rankable_rows
    small = UNBRACKETED_ROWS if unbracketed_rows is None else unbracketed_rows
    slots = len(probs)
    groups = _sketch(df, columns, probs, ranks, keys, small)
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"{len(groups)} groups: order statistics need a bounded number of groups")
    if not groups:
        return {}
    full = None
    while True:
        _count(df, columns, slots, keys, groups)
        moved = _move_missed(groups)
        crowded = [b for g in groups for _, _, b in g.slots() if b.open and b.inside > limit]
        if not moved:
            # Narrowing stops helping when only a few, often repeated values are left;
            # grouping equal values before ranking them absorbs those.
            now = sum(b.inside for b in crowded)
            if not crowded or now == full:
                break
            full = now
        if crowded and not moved:
            _narrow(df, columns, slots, keys, groups)
    picked = _pick(df, columns, slots, keys, groups)
    out = {}
    for g in groups:
        values: list[list[tuple | None]] = [[None] * slots for _ in columns]
        for i, j, b in g.slots():
            values[i][j] = (
                (picked[(*g.key, i, j, b.first)], picked[(*g.key, i, j, b.last)])
                if b.open
                else (b.lo, b.hi)
            )
        out[g.key] = (g.counts, values)
    return out


def _chunks(columns: Sequence[str], aggregates_per_column: int) -> Iterator[list[int]]:
    step = max(1, AGGREGATES_PER_SCAN // aggregates_per_column)
    for start in range(0, len(columns), step):
        yield list(range(start, min(start + step, len(columns))))


def _array(values: Sequence[float]) -> Column:
    # One literal parsed by Spark: building it value by value costs seconds of driver time.
    return F.expr("array(" + ", ".join(f"{v!r}D" for v in values) + ")")


def _sketch_quantiles(value: Column, data_type: T.DataType, at: Sequence[float]) -> Column:
    if isinstance(data_type, T.LongType):
        sketch = F.kll_sketch_agg_bigint(value, F.lit(SKETCH_K))
        read = F.kll_sketch_get_quantile_bigint
    else:
        sketch = F.kll_sketch_agg_double(value, F.lit(SKETCH_K))
        read = F.kll_sketch_get_quantile_double
    return F.when(F.count(value) > 0, read(sketch, _array(at)))


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _collect(df, keys, aggs) -> dict[tuple, T.Row]:
    rows = df.groupBy(*[col(k) for k in keys]).agg(*aggs).collect()
    return {tuple(r[k] for k in keys): r for r in rows}


def _sketch(df, columns, probs, ranks, keys, small) -> list[_Group]:
    """First scan: counts, extremes and the sketch values around each probability."""
    at = [0.0]
    for p in probs:
        at += [max(p - SLACK, 0.0), min(p + SLACK, 1.0)]
    at.append(1.0)
    types = _types(df)
    groups: dict[tuple, _Group] = {}
    for part in _chunks(columns, 6):
        aggs = []
        for i in part:
            c = columns[i]
            aggs += [
                F.count(col(c)).alias(f"n{i}"),
                _sketch_quantiles(col(c), types[c], at).alias(f"s{i}"),
            ]
        for key, row in _collect(df, keys, aggs).items():
            g = groups.setdefault(key, _Group(key, [], [], []))
            for i in part:
                n, s = row[f"n{i}"], row[f"s{i}"]
                g.counts.append(n)
                g.extremes.append((s[0], s[-1]) if n else (None, None))
                g.brackets.append([])
                for j, p in enumerate(probs if n else ()):
                    first, last = ranks(p, n)
                    lo, hi = (s[0], s[-1]) if n <= small else (s[1 + 2 * j], s[2 + 2 * j])
                    if p - SLACK <= 0:
                        lo = s[0]
                    if p + SLACK >= 1:
                        hi = s[-1]
                    g.brackets[i].append(_Bracket(lo, hi, first, last))
    return list(groups.values())


def _with_brackets(df, columns, slots, keys, groups) -> tuple[DataFrame, dict]:
    """Attach every row's bracket bounds: literals, or a small broadcast for groups."""
    types = _types(df)
    if not keys:
        at = {
            (i, j): (F.lit(b.lo).cast(types[columns[i]]), F.lit(b.hi).cast(types[columns[i]]))
            for i, j, b in groups[0].slots()
        }
        return df, at
    names = [(i, j) for i in range(len(columns)) for j in range(slots)]
    fields = [T.StructField(f"_k{m}", types[k]) for m, k in enumerate(keys)]
    for i, j in names:
        fields.append(T.StructField(f"_lo{i}_{j}", types[columns[i]]))
        fields.append(T.StructField(f"_hi{i}_{j}", types[columns[i]]))
    rows = []
    for g in groups:
        known = {(i, j): b for i, j, b in g.slots()}
        row = list(g.key)
        for at in names:
            row += [known[at].lo, known[at].hi] if at in known else [None, None]
        rows.append(tuple(row))
    small = F.broadcast(df.sparkSession.createDataFrame(rows, T.StructType(fields)))
    on = all_of(col(k).eqNullSafe(F.col(f"_k{m}")) for m, k in enumerate(keys))
    return df.join(small, on), {at: (F.col("_lo%d_%d" % at), F.col("_hi%d_%d" % at)) for at in names}


def _count(df, columns, slots, keys, groups) -> None:
    """How many values lie below and inside each bracket."""
    tagged, at = _with_brackets(df, columns, slots, keys, groups)
    for part in _chunks(columns, 2 * slots):
        aggs = []
        for i, j in at:
            if i in part:
                lo, hi = at[i, j]
                x = col(columns[i])
                aggs.append(F.count(F.when(x < lo, 1)).alias(f"b{i}_{j}"))
                aggs.append(F.count(F.when((x >= lo) & (x <= hi), 1)).alias(f"w{i}_{j}"))
        if not aggs:
            continue
        found = _collect(tagged, keys, aggs)
        for g in groups:
            for i, j, b in g.slots():
                if i in part:
                    b.below, b.inside = found[g.key][f"b{i}_{j}"], found[g.key][f"w{i}_{j}"]


def _move_missed(groups) -> bool:
    """Move brackets that missed their rank to the side where it must be."""
    moved = False
    for g in groups:
        for i, _, b in g.slots():
            if not b.holds:
                lowest, highest = g.extremes[i]
                if (b.lo, b.hi) == (lowest, highest):
                    raise RuntimeError("the input changed between scans")
                if b.first < b.below:
                    b.lo = lowest
                if b.last >= b.below + b.inside:
                    b.hi = highest
                moved = True
    return moved


def _narrow(df, columns, slots, keys, groups) -> None:
    """Sketch only the values inside the brackets and tighten each around its rank."""
    tagged, at = _with_brackets(df, columns, slots, keys, groups)
    types = _types(df)
    grid = [j / GRID for j in range(GRID + 1)]
    for part in _chunks(columns, 4 * slots):
        aggs = []
        for i, j in at:
            if i in part:
                lo, hi = at[i, j]
                x = F.when((col(columns[i]) >= lo) & (col(columns[i]) <= hi), col(columns[i]))
                aggs.append(_sketch_quantiles(x, types[columns[i]], grid).alias(f"s{i}_{j}"))
        if not aggs:
            continue
        found = _collect(tagged, keys, aggs)
        for g in groups:
            for i, j, b in g.slots():
                if i in part and b.open:
                    s = found[g.key][f"s{i}_{j}"]
                    left = (b.first - b.below) / b.inside - SLACK
                    right = (b.last + 1 - b.below) / b.inside + SLACK
                    b.lo = s[max(math.floor(left * GRID), 0)]
                    b.hi = s[min(math.ceil(right * GRID), GRID)]


def _pick(df, columns, slots, keys, groups) -> dict[tuple, float | int]:
    """Group the few values inside open brackets and read off the wanted ranks."""
    types = _types(df)
    targets = [
        (*g.key, str(i), j, b.lo, b.hi, rank - b.below, rank)
        for g in groups
        for i, j, b in g.slots()
        if b.open
        for rank in sorted({b.first, b.last})
    ]
    if not targets:
        return {}
    tagged, at = _with_brackets(df, columns, slots, keys, groups)
    by = [f"_g{m}" for m in range(len(keys))]
    wanted = sorted({int(t[len(keys)]) for t in targets})
    value_type = types[columns[0]]
    inside = []
    for i in wanted:
        x = col(columns[i])
        hit = any_of(
            (x >= at[i, j][0]) & (x <= at[i, j][1]) & (at[i, j][0] < at[i, j][1])
            for j in range(slots)
            if (i, j) in at
        )
        inside.append(F.when(hit, x).alias(str(i)))
    counted = (
        tagged.select(*[col(k).alias(g) for k, g in zip(keys, by)], *inside)
        .unpivot([F.col(g) for g in by], [F.col(f"`{i}`") for i in wanted], "_i", "_v")
        .where(F.col("_v").isNotNull())
        .groupBy(*by, "_i", "_v")
        .agg(F.count("*").alias("_c"))
    )
    fields = [T.StructField(f"_t{m}", types[k]) for m, k in enumerate(keys)]
    fields += [T.StructField("_ti", T.StringType()), T.StructField("_j", T.LongType())]
    fields += [T.StructField(n, value_type) for n in ("_from", "_to")]
    fields += [T.StructField(n, T.LongType()) for n in ("_rank", "_id")]
    small = F.broadcast(df.sparkSession.createDataFrame(targets, T.StructType(fields)))
    on = all_of(F.col(g).eqNullSafe(F.col(f"_t{m}")) for m, g in enumerate(by))
    on = on & (F.col("_i") == F.col("_ti"))
    on = on & (F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))
    upto = (
        Window.partitionBy(*by, "_i", "_j", "_id")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.join(small, on).withColumn("_upto", F.sum("_c").over(upto))
    rows = (
        ranked.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        .select(*by, "_i", "_j", "_id", "_v")
        .collect()
    )
    return {(*r[: len(by)], int(r["_i"]), r["_j"], r["_id"]): r["_v"] for r in rows}
