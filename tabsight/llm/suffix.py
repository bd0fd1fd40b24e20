"""Exact repeated strings: bucket refinement over sampled suffixes.

A byte goes if a string of ``span`` bytes that covers it starts anywhere else too. Of all
starts, those whose strings have the same least q-gram (by hash; leftmost of equals)
form a segment around that anchor, so equal strings have equal anchors at equal offsets,
and about one suffix in 170 stands for all. Segments fall into buckets by the anchor's
q-gram. A bucket is refined by identifiers of what lies at earlier and later offsets: first
of all bytes that a segment's strings cover, then of sixteen cells of offsets, then of single
offsets; each time those with equal identifiers are settled, those alone in a bucket fall
out, and one segment for each identifier stands for it in the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import texts

SPAN, GRAM, CELLS = 400, 65, 16
# Starts of a very long text that are sampled at once.
CHUNK = 1 << 20
PLACE = np.uint64((1 << 24) - 1)
SEGMENTS = "digest binary, x long, low long, high long, last long, n long, core long, one long, two long"
CONTEXTS = "digest binary, x long, low long, high long, alone boolean, bytes binary"
CELL_ROWS = "id long, low long, high long, alone boolean, core long, one long, two long"
SINGLES = "digest binary, low long, alone boolean, one long, two long"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and powers of an odd base and of its inverse."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    n = CHUNK + SPAN + 1
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64), np.cumprod(up), np.cumprod(down)


def gram_keys(raw: np.ndarray, gram: int, tables) -> np.ndarray:
    """A hash of every q-gram, from running sums."""
    numbers, up, down = tables
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(numbers[raw] * up[: len(raw)])])
        h = (sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def anchors(keys: np.ndarray, window: int) -> np.ndarray:
    """For each window of q-grams the place of its least key, the leftmost of equals."""
    m = (keys & ~PLACE) | np.arange(len(keys), dtype=np.uint64)
    n, size = len(keys) - window + 1, 1
    while 2 * size <= window:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return (np.minimum(m[:n], m[window - size : window - size + n]) & PLACE).astype(np.int64)


def two(data: bytes, seed: int = 0) -> tuple[int, int]:
    """A 128-bit hash as two signed longs."""
    d = xxhash.xxh3_128_digest(data, seed=seed)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def segments(text: bytes, span: int, gram: int, tables) -> list[tuple]:
    """(x, low, high, last, n, core, one, two): the starts low to high share the anchor x;
    core identifies its q-gram, (one, two) all bytes that their strings cover. Segments that
    follow each other with the same bytes are one row with their number n and the
    last start of all."""
    out: list[tuple] = []
    window = span - gram + 1
    for at in range(0, len(text) - span + 1, CHUNK):
        part = text[at : at + CHUNK + span - 1]
        keys = gram_keys(np.frombuffer(part, np.uint8), gram, tables)
        x = anchors(keys, window)
        edges = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
        for low, stop, place, core in zip(edges[:-1].tolist(), edges[1:].tolist(), x[edges[:-1]].tolist(), keys[x[edges[:-1]]].view(np.int64).tolist()):
            ids = two(part[low : stop - 1 + span], seed=place - low)
            if out and out[-1][6:] == ids and out[-1][5] == core and out[-1][3] == at + low - 1:
                out[-1] = (*out[-1][:3], at + stop - 1, out[-1][4] + 1, *out[-1][5:])
            else:
                out.append((at + place, at + low, at + stop - 1, at + stop - 1, 1, core, *ids))
    return out


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    names, types = zip(*(f.split() for f in fields.split(", ")))
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names)


def find_segments(docs: DataFrame, span: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables()
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column(0):
                text = t.as_buffer().to_pybytes()
                if len(text) >= span:
                    digest = hashlib.sha256(text).digest()[:16]
                    rows += [(digest, *s) for s in segments(text, span, gram, tables)]
                if len(rows) > 100_000:
                    yield _batch(rows, SEGMENTS)
                    rows = []
            yield _batch(rows, SEGMENTS)

    return docs.select("text").mapInArrow(find, SEGMENTS)


def _settled(groups: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups that hold two or more."""
    return rows.join(groups.where(F.col("n") > 1).select(*keys), keys, "left_semi")


def _open(groups: DataFrame, bucket: str) -> DataFrame:
    """One member of each group, for buckets of several groups of which one is not settled."""
    several = groups.groupBy(bucket).agg(F.count("*").alias("k"), F.max("alone").alias("a")).where((F.col("k") > 1) & F.col("a")).select(bucket)
    return groups.join(several, bucket, "left_semi")


def repeated_starts(docs: DataFrame, span: int, gram: int, cells: int) -> DataFrame:
    """(digest, low, high): all starts whose strings of ``span`` bytes also start elsewhere,
    for every text by the first half of its SHA-256. ``docs`` has a text column."""
    size = (span - gram + 1) // cells
    every = materialise(find_segments(docs, span, gram), "segments")
    # Initial q-gram buckets: those of a single segment fall out.
    shared = every.groupBy("core").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("core")
    rows = materialise(every.join(shared, "core", "left_semi"), "buckets")
    keys = ["core", "one", "two"]
    # The member that stands for a group; a group of one is not settled.
    member = F.min(F.struct("digest", "x", "low", "high")).alias("m")
    groups = materialise(rows.groupBy(*keys).agg(F.sum("n").alias("n"), member).withColumn("alone", F.col("n") == 1), "groups")
    found = [_settled(groups, rows, keys).select("digest", "low", F.col("last").alias("high"))]

    open_ = _open(groups, "core").select("m.*", "alone")
    wanted = open_.groupBy("digest").agg(F.collect_list(F.struct("x", "low", "high", "alone")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for digest, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_buffer().to_pybytes()
                out += [(digest, w["x"], w["low"], w["high"], w["alone"], data[w["low"] : w["high"] + span]) for w in asked]
            yield _batch(out, CONTEXTS)

    # Copies of a text have equal digests: any of them gives the bytes.
    digest = F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest")
    around = (
        docs.select(digest, "text")
        .join(wanted, "digest")
        .select("digest", "text", "wanted")
        .mapInArrow(cut, CONTEXTS)
        .dropDuplicates(["digest", "low"])
    )
    contexts = materialise(around.withColumn("id", F.monotonically_increasing_id()), "contexts")

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell of offsets that a segment has starts in."""
        for batch in batches:
            out: list[tuple] = []
            for id_, x, low, high, alone, data in zip(*(batch.column(c).to_pylist() for c in range(6))):
                for cell in range((x - high) // size, (x - low) // size + 1):
                    # Owned starts, and what all strings of the cell have in common.
                    a, b = max(low, x - (cell + 1) * size + 1), min(high, x - cell * size)
                    inner = data[x - cell * size - low : x - (cell + 1) * size + 1 + span - low]
                    core = xxhash.xxh3_64_intdigest(inner, seed=cell) - (1 << 63)
                    out.append((id_, a, b, alone, core, *two(data[a - low : b + span - low], seed=x - a)))
            yield _batch(out, CELL_ROWS)

    cells_of = materialise(contexts.select("id", "x", "low", "high", "alone", "bytes").mapInArrow(refine, CELL_ROWS), "cells")
    finer = cells_of.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("id", "low", "high")).alias("m"), F.max("alone").alias("alone"))
    finer = materialise(finer.withColumn("alone", F.col("alone") & (F.col("n") == 1)), "groups")
    names = contexts.select("id", "digest")
    unsettled = cells_of.where("alone")
    found.append(_settled(finer, unsettled, keys).join(names, "id").select("digest", "low", "high"))

    last = _open(finer, "core").select("m.*", "alone").groupBy("id").agg(F.collect_list(F.struct("low", "high", "alone")).alias("wanted"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each start of an open cell."""
        for batch in batches:
            out: list[tuple] = []
            for digest, x, low, data, asked in zip(*(batch.column(c).to_pylist() for c in range(5))):
                for w in asked:
                    for p in range(w["low"], w["high"] + 1):
                        out.append((digest, p, w["alone"], *two(data[p - low : p + span - low], seed=x - p)))
                if len(out) > 100_000:
                    yield _batch(out, SINGLES)
                    out = []
            yield _batch(out, SINGLES)

    starts = contexts.join(last, "id").select("digest", "x", "low", "bytes", "wanted")
    singles = materialise(starts.mapInArrow(single, SINGLES), "starts")
    equal = singles.groupBy("one", "two").agg(F.count("*").alias("n"))
    found.append(_settled(equal, singles.where("alone"), ["one", "two"]).select("digest", "low", F.col("low").alias("high")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def merged(ranges: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings with these first and last starts cover."""
    runs: list[list[int]] = []
    for low, high in sorted(ranges):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high + span)
        else:
            runs.append([low, high + span])
    return [tuple(r) for r in runs]


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """Remove every byte that a repeated string of ``span`` bytes covers.

    Texts are taken as UTF-8 bytes; matches never cross texts, overlaps and matches inside a
    text count, and all strings are judged on the input. Returns doc_id, n_bytes,
    n_removed, spans (maximal removed runs as structs start, end), kept (the other bytes).

    Null texts are empty; texts shorter than ``span`` stay whole; copies lose all; null and
    repeated ids are rows of their own; an empty table gives no rows.
    """
    if (span - gram + 1) % cells:
        raise ValueError("cells must divide span - gram + 1")
    own = texts(docs)
    starts = repeated_starts(own, span, gram, cells).distinct()
    ranges = materialise(starts.groupBy("digest").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "ranges")
    digest = F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest")
    joined = own.select("doc_id", "text", digest).join(ranges, "digest", "left").select("doc_id", "text", "ranges")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, gone, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                data = text.as_buffer().to_pybytes()
                runs = merged([(r["low"], r["high"]) for r in found or ()], span)
                edges = [0, *(x for r in runs for x in r), len(data)]
                sizes.append(len(data))
                gone.append(sum(b - a for a, b in runs))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
