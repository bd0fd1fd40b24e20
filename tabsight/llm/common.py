"""Helpers that several of the operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids that may be broadcast to pick or leave out rows.
BROADCAST_IDS = 1 << 21
# Rows of texts that a stage of the pipeline sends to a worker at once.
BATCH_ROWS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the whole text (null: empty) and nothing else, so that other columns,
    whatever their names, cannot clash with those of an operator."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(c, UPPER, LOWER)


def row_key(docs: DataFrame) -> Column:
    """A digest of a row's id and text, for stages whose rows may lack an id or share one;
    rows with equal ids and texts are one to them."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def bounded(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A saved table of one long, to be broadcast if it has at most ``most`` rows (16 bytes
    each); beyond that a join with it is a shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """At most so many rows in a batch that goes to a Python worker from here on: with
    texts of some kilobytes, ten thousand rows at once are most of what a task holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def tasks_of(spark: SparkSession) -> int:
    """How many parts the session's shuffles have: the parts of an explicit repartition."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def process_cache(name: str) -> dict:
    """A dictionary that outlives a task in a reused Python worker.

    Functions shipped by value get fresh module globals in each task; loaded tokenizers
    and memo tables are kept here instead.
    """
    holder = sys.modules.setdefault("_tabsight_process_cache", types.ModuleType("_tabsight_process_cache"))
    return holder.__dict__.setdefault(name, {})


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes in a text column; a longer text is a part
    of its own, so memory is bounded by the longest text."""
    text = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    # A reused worker would keep what the parts took.
    pa.default_memory_pool().release_unused()
