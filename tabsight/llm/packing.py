"""Sequence packing: best-fit decreasing into windows of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import texts
from .tokens import SLICE_BYTES, encoded

# Pieces that one task packs among themselves.
BUCKET_PIECES = 65_536
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class OpenWindows:
    """Open windows by what still fits into them: a segment tree over the capacities
    that counts windows and finds the smallest sufficient capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, room: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least ``length``."""
        node, count = self.size + length, self.count
        while not count[node]:
            # Up to the next subtree on the right.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return self.windows[room].pop(), room


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The window and the offset of each length; the lengths are in descending order."""
    open_windows, opened = OpenWindows(capacity), 0
    window, offset = [], []
    for n in lengths:
        found = open_windows.tightest(n)
        if found is None:
            found, opened = (opened, capacity), opened + 1
        at, room = found
        window.append(at)
        offset.append(capacity - room)
        if room > n:
            open_windows.put(at, room - n)
    return window, offset


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, slice_bytes: int = SLICE_BYTES, memo_words: int | None = None) -> DataFrame:
    """Each document's ids with the end id, cut into full windows and a rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, begins in encoded(batches, tokenizer, slice_bytes, memo_words):
            out: list[tuple] = []
            data = memoryview(np.insert(ids, begins[1:], end_id).astype("<u4").tobytes())
            sizes = np.diff(begins) + 1
            at = 0
            for doc_id, n in zip(rows.column(0).to_pylist(), sizes.tolist()):
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(data[4 * (at + start) : 4 * (at + start + length)])
                    out.append((doc_id, start, length, crc, n))
                at += n
            columns = list(zip(*out))
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(names, columns)})

    return texts(docs).mapInArrow(cut, PIECES)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 2048,
    bucket_pieces: int = BUCKET_PIECES,
    slice_bytes: int = SLICE_BYTES,
    memo_words: int | None = None,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Documents are encoded and overlong ones cut into full windows and a rest; the
    pieces are saved (a few numbers each), numbered and dealt by a hash of that number
    into buckets of about ``bucket_pieces``; within a bucket pieces go by descending length
    into the open window with the least sufficient room. A sequence id is the bucket in
    the upper 32 bits and the window in the lower. Only windows of the same bucket compete,
    which costs a few half-empty windows a bucket. ``slice_bytes`` and ``memo_words`` bound
    what a worker's encoder holds, not what it returns.

    A null or empty text is its end id alone; repeated rows and ids are documents of
    their own; no documents give no rows.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, slice_bytes, memo_words)
    saved = materialise(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    buckets = max(1, -(-saved.count() // bucket_pieces))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("piece", "ascending")])
        window, offset = best_fit(rows["length"].to_pylist(), capacity)
        base = rows["bucket"][0].as_py() << 32
        rows = rows.drop_columns(["bucket", "piece"])
        rows = rows.append_column("sequence_id", pa.array([base + w for w in window], pa.int64()))
        return rows.append_column("offset", pa.array(offset, pa.int64()))

    return (
        saved.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("long"))
        .groupBy("bucket")
        .applyInArrow(packed, PACKED)
    )
