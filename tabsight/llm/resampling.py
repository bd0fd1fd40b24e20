"""Importance resampling: documents drawn by how much their n-grams look like a target's."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, islice
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import dense_position
from ..session import materialise
from .common import slices

WORDS, BUCKETS, MIN_WORDS, SEED = 3, 10_000, 20, 42
# Bytes of text and features that are handled at once.
SLICE_BYTES, CHUNK = 4 << 20, 1 << 20
# A-Z become a-z, what is no word character becomes a space; bytes of other characters stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scanner(n: int = WORDS) -> regex.Pattern:
    """A pattern that, scanned with overlaps, matches once at each word of a text with
    single spaces; its groups n to 1 (0 for the longest) are the runs of 1 to n words from
    there, as far as the text goes (then a longer run equals the longest there is)."""
    runs = "[^ ]++"
    for _ in range(n - 1):
        runs = f"({runs})(?: [^ ]++)?+"
    return regex.compile(rb"(?<= |^)" + runs.encode())


def feature_buckets(text: bytes, pattern: regex.Pattern, n: int = WORDS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each run of 1 to n words: the crc32 of
    its words joined by one space, modulo ``buckets``."""
    plain = b" ".join(text.translate(_PLAIN).split())
    spans = map(itemgetter(*range(n)), pattern.finditer(plain, overlapped=True))
    found = map(crc32, chain.from_iterable(spans) if n > 1 else spans)
    parts = []
    while len(part := np.fromiter(islice(found, CHUNK // n * n), np.uint32)):
        parts.append((part % buckets).astype("<u2"))
    if not parts:
        return 0, np.zeros(0, "<u2")
    # Group 0 is the longest run and the last group one word: a column for each length.
    runs = np.concatenate(parts).reshape(-1, n)
    left = len(runs) - np.arange(max(0, len(runs) - n), len(runs))  # words from there to the end
    keep = np.ones(runs.shape, bool)
    keep[-len(left) :] = np.arange(n, 0, -1)[None, :] <= left[:, None]
    return len(runs), runs[keep]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit buckets of a binary column in a row, and where each value's begin."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, "<u2", (bounds[-1] - bounds[0]) // 2, int(bounds[0])) if data is not None and bounds[-1] > bounds[0] else np.zeros(0, "<u2")
    return flat, (bounds - bounds[0]) // 2


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, features) of every whole text: the id in decimals, and the 16-bit
    bucket numbers of the features."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("between 1 and 65,536 buckets")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = scanner(n)
        for part in (p for batch in batches for p in slices(batch, "text", SLICE_BYTES)):
            found = [feature_buckets(t.as_py(), pattern, n, buckets) for t in part.column(1)]
            columns = [part.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array([f.tobytes() for _, f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "features"])

    raw = docs.select(docs[id_col].cast("string").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    return raw.mapInArrow(scan, "doc_id string, n_words long, features binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket: a task sends one number a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            flat, _ = _flat(batch.column(0))
            for at in range(0, len(flat), CHUNK):
                total += np.bincount(flat[at : at + CHUNK], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    partial = found.select("features").mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier each bucket is in the target, with one
    added to each count, rounded down."""
    s, t, b = source.tolist(), target.tolist(), len(source)
    of_s, of_t = sum(s) + b, sum(t) + b
    return np.array([math.floor(1000 * math.log(float(t[i] + 1) * float(of_s) / (float(s[i] + 1) * float(of_t)))) for i in range(b)], np.int64)


def gumbel(doc_id: str | None, seed: int = SEED) -> int:
    """A thousand times a Gumbel number that depends on the id alone, rounded down."""
    h = int(sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (5, 100),
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    n: int = WORDS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Draw a share of the documents, without replacement, with chances in proportion to
    the likelihood ratio of their n-grams between ``target`` and the documents themselves.

    Returns (doc_id, n_words, n_features, weight, score, rank) of every row: weight is the sum
    of the gains of a text's runs of 1 to n words, score adds a Gumbel number of the id, and
    the rows with at least ``min_words`` words and the highest scores are ranked from 1;
    equal scores go by the smaller id, then by fewer features. Rows not drawn have no rank.

    Each text is scanned once; its buckets are saved (two bytes a feature), counted with one
    row a bucket and task, and weighed from there. Ranks come from one range-partitioned
    sort of narrow rows with a row number as last key, so neither equal scores nor
    repeated rows meet in one task. Null and empty texts have no features and weight 0; a
    null id has the Gumbel number of the empty id and comes last among equal scores;
    repeated rows are documents of their own; no documents give no rows, and without a
    target's texts all its buckets hold nothing.
    """
    found = materialise(features(docs, n=n, buckets=buckets), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target.withColumn("doc_id", F.lit(0)), n=n, buckets=buckets), buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = _flat(batch.column(2))
            weights = [
                sum(int(gain[flat[at : min(b, at + CHUNK)]].sum()) for at in range(a, b, CHUNK)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
            ]
            ids = batch.column(0).to_pylist()
            columns = [
                pa.array([None if i is None else int(i) for i in ids], pa.int64()),
                batch.column(1),
                pa.array(np.diff(bounds)),
                pa.array(weights, pa.int64()),
                pa.array([w + gumbel(i, seed) for i, w in zip(ids, weights)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    weighed = found.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")
    late, down = F.when(F.col("n_words") >= min_words, 0).otherwise(1), -F.col("score")
    saved = materialise(weighed.select("*", late.alias("late"), down.alias("down"), F.monotonically_increasing_id().alias("row")), "weighed")
    drawn = saved.where("late = 0").count() * share[0] // share[1]
    placed = dense_position(saved, ["late", "down", "doc_id", "n_features", "row"])
    rank = F.when((F.col("late") == 0) & (F.col("pos") < drawn), F.col("pos") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))
