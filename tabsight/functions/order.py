"""Global row positions and neighbour access without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, ship_functions_of
from .columns import col

ship_functions_of(__name__)

# Rows per window partition when looking at neighbouring rows.
BLOCK_ROWS = 200_000


def ascending(names: Sequence[str]) -> list[Column]:
    return [col(n).asc_nulls_last() for n in names]


def dense_position(
    df: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str] = (),
    name: str = "pos",
    weight: str | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in the global order (nulls last).

    The sort is range-partitioned on the whole ordering, so one hot timestamp is spread
    over tasks by its tiebreaker. The sorted rows are saved once: their task and row
    numbers are then facts in a file, and the position is the row number plus the size
    of the tasks before it. ``within`` restarts the count for each (non-null) group.
    With ``weight`` the running total of that column up to and including the row is
    added as ``<name>_total``; it restarts in the same way.
    """
    within = list(within)
    ordered = df.orderBy(*ascending([*within, *order_by])).withColumn(
        "_row", F.monotonically_increasing_id()
    )
    saved = materialise(ordered, "sorted").withColumn("_task", F.shiftright("_row", 33))
    # One row per sort task and group inside it: small, whatever the size of the data.
    sizes = [F.count("*").alias("_n"), F.min("_row").alias("_start")]
    if weight:
        sizes.append(F.sum(col(weight)).alias("_w"))
    tasks = saved.groupBy("_task", *[col(w) for w in within]).agg(*sizes)
    earlier = (
        Window.partitionBy(*([col(w) for w in within] or [F.lit(0)]))
        .orderBy("_task")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")]
    if weight:
        offsets.append(F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_woffset"))
    starts = tasks.select("_task", *[col(w) for w in within], "_start", *offsets)
    # Without groups there is a row per sort task; groups may be many.
    out = saved.join(starts if within else F.broadcast(starts), ["_task", *within]).withColumn(
        name, F.col("_offset") + F.col("_row") - F.col("_start")
    )
    keep = [col(c) for c in df.columns] + [F.col(name)]
    if weight:
        running = (
            Window.partitionBy("_task", *[col(w) for w in within])
            .orderBy("_row")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        keep.append((F.col("_woffset") + F.sum(col(weight)).over(running)).alias(f"{name}_total"))
    return out.select(*keep)


def counts_before(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of rows that are sorted over tasks: their values, ``_task``, and for each column i how
    many rows before it in its task have a value there, as ``_p<i>``. Nothing is shuffled."""
    columns = list(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), [0] * len(columns)
        for batch in batches:
            made = [pa.array(np.full(batch.num_rows, task), pa.int64())]
            for i, values in enumerate(batch.columns):
                valid = pc.is_valid(values).to_numpy(zero_copy_only=False)
                until = np.cumsum(valid)
                made.append(pa.array(seen[i] + until - valid))
                seen[i] += int(until[-1]) if len(until) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    plain = df.select(*[col(c) for c in columns])
    names = [*columns, "_task", *[f"_p{i}" for i in range(len(columns))]]
    schema = T.StructType([*plain.schema.fields, *[T.StructField(n, T.LongType()) for n in names[len(columns) :]]])
    return plain.mapInArrow(count, schema)


def totals_before(df: DataFrame, order_by: Sequence[str], weight: str, name: str) -> DataFrame:
    """Add the total of the whole-number column ``weight`` over all rows before a row in the given order.

    One range-partitioned sort, saved with the totals inside each task; a row a task gives what earlier
    tasks hold, so nothing is sorted or shuffled again.
    """
    ordered = df.orderBy(*ascending(order_by))
    at = df.columns.index(weight)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            each = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            until = held + np.cumsum(each)
            made = [pa.array(np.full(batch.num_rows, task), pa.int64()), pa.array(until - each)]
            held = int(until[-1]) if len(until) else held
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    names = [*df.columns, "_task", name]
    schema = T.StructType([*df.schema.fields, T.StructField("_task", T.LongType()), T.StructField(name, T.LongType())])
    saved = materialise(ordered.mapInArrow(add, schema), "sorted")
    # One row a sort task.
    tasks = saved.groupBy("_task").agg(F.sum(col(weight)).alias("_w"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("_task", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset"))
    return saved.join(F.broadcast(offsets), "_task").select(*[col(c) for c in df.columns], (col(name) + F.col("_offset")).alias(name))


def steps_taken(df: DataFrame, order_by: Sequence[str], columns: Sequence[str]) -> dict[str, tuple[bool, bool]]:
    """For each column whether its values ever fall, and ever rise, in the given row order;
    nulls are passed over.

    All columns share one range-partitioned sort of their rows. A sort task sends one row:
    the first and the last value of each column and the steps between its rows. These are
    put together in task order, so nothing is saved and no row meets its neighbour twice.
    """
    columns = list(columns)
    if not columns:
        return {}
    keys = [f"_o{i}" for i in range(len(order_by))]
    wide = df.select(
        *[col(c).alias(k) for k, c in zip(keys, order_by)], *[col(c).alias(f"_v{i}") for i, c in enumerate(columns)]
    )
    values = wide.orderBy(*ascending(keys)).select(*[f"_v{i}" for i in range(len(columns))])
    sides = [(n, f.dataType) for f in values.schema.fields for n in (f"first{f.name}", f"last{f.name}")]
    moves = [n for i in range(len(columns)) for n in (f"falls_v{i}", f"rises_v{i}")]
    names = ["_task", *[n for n, _ in sides], *moves]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, last, types = [None] * len(columns), [None] * len(columns), None
        falls, rises = [False] * len(columns), [False] * len(columns)
        for batch in batches:
            types = [v.type for v in batch.columns]
            for i, column in enumerate(batch.columns):
                held = column.drop_null()
                if not len(held):
                    continue
                # The last value before the batch stands before its rows.
                run = held if last[i] is None else pa.concat_arrays([pa.array([last[i]], held.type), held])
                falls[i] = falls[i] or bool(pc.any(pc.less(run[1:], run[:-1])).as_py())
                rises[i] = rises[i] or bool(pc.any(pc.greater(run[1:], run[:-1])).as_py())
                first[i] = held[0].as_py() if first[i] is None else first[i]
                last[i] = held[-1].as_py()
        if types is None:
            return
        ends = [pa.array([v], t) for f, l, t in zip(first, last, types) for v in (f, l)]
        steps = [pa.array([v]) for pair in zip(falls, rises) for v in pair]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), *ends, *steps], names)

    schema = T.StructType(
        [
            T.StructField("_task", T.LongType()),
            *[T.StructField(n, t) for n, t in sides],
            *[T.StructField(n, T.BooleanType()) for n in moves],
        ]
    )
    # One row a sort task.
    earlier = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = values.mapInArrow(summarise, schema)
    joined = parts.select(
        "*", *[F.last(f"last_v{i}", ignorenulls=True).over(earlier).alias(f"_b{i}") for i in range(len(columns))]
    )
    row = joined.agg(
        *[F.bool_or(F.col(f"falls_v{i}") | F.coalesce(F.col(f"first_v{i}") < F.col(f"_b{i}"), F.lit(False))) for i in range(len(columns))],
        *[F.bool_or(F.col(f"rises_v{i}") | F.coalesce(F.col(f"first_v{i}") > F.col(f"_b{i}"), F.lit(False))) for i in range(len(columns))],
    ).first()
    return {c: (bool(row[i]), bool(row[len(columns) + i])) for i, c in enumerate(columns)}


def with_halo(
    df: DataFrame, width: int, pos: str = "pos", block_rows: int | None = None
) -> DataFrame:
    """Cut positions into blocks and lend each block the ``width`` rows before it.

    Borrowed rows carry ``_halo = true``: window functions over ``_block`` may look up to
    ``width`` rows back, then the borrowed rows are dropped by the caller.
    """
    size = max(block_rows or BLOCK_ROWS, width)
    block = F.floor(col(pos) / F.lit(size))
    lends = col(pos) % size >= size - width
    blocks = F.when(lends, F.array(block, block + 1)).otherwise(F.array(block))
    return df.select("*", F.explode(blocks).alias("_block")).withColumn(
        "_halo", F.col("_block") != block
    )


def neighbours(within: Sequence[str] = (), pos: str = "pos"):
    """Window over one block of ``with_halo``, in position order."""
    return Window.partitionBy(*[col(w) for w in within], "_block").orderBy(col(pos))
