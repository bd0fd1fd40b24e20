"""Quality rules: rule statistics of each text, and an isolation forest over them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import texts

# The rules of the contract.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
# The forest: trees, rows that each tree is grown from, rows of the table they are drawn
# from (the sampling of the method), bins of the calibrated score, and the threshold
# where there are no labels to calibrate it.
TREES, TREE_ROWS, DRAWN_ROWS, BINS, DEFAULT_THRESHOLD = 100, 256, 8192, 1000, 0.65
# A share takes part if the labels differ in it by so many standard deviations.
MIN_DIFFERENCE = 0.4


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        last = -1  # the last word counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeats += i + 2 - max(last, i - 1)
                last = i + 2
    joined = b"".join(words)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        len(lines),
        len(joined) - len(joined.translate(None, PUNCTUATION)),
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """The counts of every whole text (null: none), one row a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *COUNTS])

    return texts(docs).mapInArrow(count, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# Shares that do not depend on the length of the text: (part, whole).
SHARES = (("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_punctuation", "word_chars"))


def features(n: dict[str, np.ndarray], shares=SHARES) -> np.ndarray:
    """The shares, a row for each text."""
    return np.stack([n[a] / np.maximum(1, n[b]) for a, b in shares], axis=1)


def telling_shares(labelled: DataFrame) -> tuple:
    """The shares in which the labelled rows of both kinds differ; all without labels."""
    values = [F.col(a) / F.greatest(F.col(b), F.lit(1)) for a, b in SHARES]
    kinds = [F.when(F.col("quality") == k, v) for v in values for k in (0, 1)]
    got = labelled.agg(*[f(k) for k in kinds for f in (F.avg, F.var_pop)]).first()
    told = []
    for i, share in enumerate(SHARES):
        bad, bad_var, good, good_var = got[4 * i : 4 * i + 4]
        if bad is None or good is None:
            return SHARES
        if abs(bad - good) > MIN_DIFFERENCE * math.sqrt((bad_var + good_var) / 2):
            told.append(share)
    return tuple(told) or SHARES


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Random axis-parallel splits; all trees in flat arrays of nodes."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 42):
        self.depth = max(1, math.ceil(math.log2(max(2, min(rows, len(sample))))))
        self.scale = expected_path(min(rows, len(sample))) or 1.0
        rng = np.random.default_rng(seed)
        self.feature, self.cut, self.left, self.right, self.path, self.roots = [], [], [], [], [], []
        for _ in range(trees if len(sample) else 0):
            own = sample[rng.choice(len(sample), min(rows, len(sample)), replace=False)]
            self.roots.append(self._grow(own, 0, rng))
        for k in ("feature", "cut", "left", "right", "path"):
            setattr(self, k, np.array(getattr(self, k)))

    def _grow(self, rows: np.ndarray, depth: int, rng) -> int:
        node = len(self.feature)
        for values, v in ((self.feature, 0), (self.cut, np.inf), (self.left, node), (self.right, node), (self.path, depth + expected_path(len(rows)))):
            values.append(v)
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        if depth < self.depth and len(rows) > 1 and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            below = rows[:, f] < cut
            self.feature[node], self.cut[node] = f, cut
            self.left[node] = self._grow(rows[below], depth + 1, rng)
            self.right[node] = self._grow(rows[~below], depth + 1, rng)
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        if not self.roots:
            return np.full(len(x), 0.5)
        total, each = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[each, self.feature[node]] < self.cut[node], self.left[node], self.right[node])
            total += self.path[node]
        return 2.0 ** (-total / len(self.roots) / self.scale)


def scored(stats: DataFrame, forest: Forest, shares=SHARES) -> DataFrame:
    names = stats.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in COUNTS}
            values = forest.score(features(counts, shares)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*names, "anomaly"])

    return stats.mapInArrow(score, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", anomaly double")


def calibrate(rows: DataFrame, default: float = DEFAULT_THRESHOLD) -> float:
    """The threshold over all labelled rows (anomaly, quality) that parts the labels best:
    most bad rows at or above it less good rows at or above it, each as a share; the
    middle of the widest run of such thresholds. The default without rows of both labels."""
    bin_of = F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1))
    got = rows.groupBy(bin_of.alias("bin")).agg(
        F.sum((F.col("quality") == 0).cast("long")).alias("bad"), F.sum((F.col("quality") == 1).cast("long")).alias("good")
    )
    bad, good = np.zeros(BINS), np.zeros(BINS)
    for r in got.collect():  # at most one row for each bin
        bad[r.bin], good[r.bin] = r.bad or 0, r.good or 0
    if not bad.sum() or not good.sum():
        return default
    gain = np.append((bad / bad.sum() - good / good.sum())[::-1].cumsum()[::-1], 0.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=lambda r: (len(r), r[-1]))
    return float(widest[0] + widest[-1]) / 2 / BINS


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, anomaly score and verdict of every whole text.

    Returns doc_id, the counts of ``COUNTS``, base_failed (under 50 words, or over half
    of them in repeated 3-word windows), anomaly (0 to 1, of an isolation forest over
    length-free shares of the counts in which labelled rows differ) and kept: false if base_failed, else whether the
    anomaly is under the threshold that all labelled rows (doc_id, quality 0/1) give.

    The counts are saved once. Each of the 100 trees is grown from 256 of 8,192 rows
    that pass the base rules, chosen by hash: the sampling of the method; every row is
    scored. Null texts are empty and fail; repeated rows are judged alike; null ids stay;
    rows with null labels are passed over; without labels of both kinds the threshold
    is 0.65; an empty table gives no rows.
    """
    stats = materialise(rule_statistics(docs).withColumn("base_failed", base_failed()), "quality")
    passed = stats.where(~F.col("base_failed"))
    drawn = passed.orderBy(F.xxhash64("doc_id", *COUNTS)).limit(DRAWN_ROWS).select(*COUNTS).toArrow()
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("quality")).where(F.col("quality").isNotNull())
    labelled = passed.join(known, "doc_id")
    shares = telling_shares(labelled)
    counts = {c: drawn.column(c).to_numpy() for c in COUNTS}
    forest = Forest(features(counts, shares) if drawn.num_rows else np.zeros((0, len(shares))))
    threshold = calibrate(scored(labelled, forest, shares))
    return scored(stats, forest, shares).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))
