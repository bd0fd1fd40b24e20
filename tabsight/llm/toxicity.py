"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import texts

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
# Labelled documents to learn from (chosen by hash), words the model may use, and the
# evidence (log-likelihood ratio over distinct sentences) that a word needs.
TRAIN_ROWS, MAX_WORDS, MIN_EVIDENCE = 20_000, 4096, 15.0
STEPS, RATE, RIDGE, START_WORD, START_BIAS = 400, 0.1, 1e-4, 3.0, -1.0
THRESHOLD = 0.7
SCORED = "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:long,end:long,score:double>>"


def remainder(doc_id: Column) -> Column:
    """Fold of a document: its rows with 1 are held out."""
    return F.crc32(doc_id.cast("string")) % 3


class Model:
    """P(toxic) = 1 - (1 - leak) * product over sentences with evidence of (1 - p), where
    p = sigmoid(bias + sum of the sentence's word weights). Sentences without a known
    word carry no evidence, so a long text is not toxic by its length."""

    def __init__(self, weights: dict[str, float], bias: float, leak: float):
        self.weights, self.bias, self.leak = weights, bias, leak

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of its offending sentences."""
        if self.weights.keys().isdisjoint(WORD.findall(text.lower())):
            return self.leak, []
        clean, found = np.log1p(-self.leak), []
        for m in SENTENCE.finditer(text):
            known = {w for w in WORD.findall(m.group().lower()) if w in self.weights}
            if known:
                z = self.bias + sum(self.weights[w] for w in sorted(known))
                clean -= np.logaddexp(0.0, z)
                p = float(1 / (1 + np.exp(-z)))
                if p >= 0.5:
                    found.append((m.start(), m.end(), p))
        return float(-np.expm1(clean)), found


def fit_noisy_or(toxic: np.ndarray, sentences: pa.Array, words: int) -> tuple[np.ndarray, float, float]:
    """Word weights, bias and leak that make the document labels likeliest.

    A bag is a label and a list of its sentences with evidence, each a list of word
    ids. The leak is the smoothed share of toxic documents among those without any.
    """
    bags = np.diff(sentences.offsets.to_numpy())
    inner = sentences.flatten()
    sizes = np.diff(inner.offsets.to_numpy())
    word = inner.flatten().to_numpy(zero_copy_only=False)
    without = toxic[bags == 0]
    leak = min((without.sum() + 0.5) / (len(without) + 10.0), 0.3)
    weights, bias = np.full(words, START_WORD), START_BIAS
    held = np.flatnonzero(bags)
    if not len(held):
        return weights, bias, float(leak)
    y = toxic[held].astype(float)
    bag = np.repeat(np.arange(len(held)), bags[held])
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    theta = np.append(weights, bias)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(sentence, theta[word], len(sizes))
        p = 1 / (1 + np.exp(-z))
        log_clean = np.log1p(-leak) - np.bincount(bag, np.logaddexp(0, z), len(held))
        toxic = np.maximum(-np.expm1(log_clean), 1e-12)
        # d loss / d z of a sentence: pulled up by toxic bags, down by clean ones.
        pull = np.where(y == 1, -np.exp(log_clean) / toxic, 1.0)
        dz = pull[bag] * p / len(held)
        grad = np.append(np.bincount(word, dz[sentence], words), dz.sum()) + RIDGE * (theta - np.append(weights, START_BIAS))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1]), float(leak)


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each sentence, and a checksum of those of the one before."""
    for batch in batches:
        toxic, words, before = [], [], []
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            last = 0
            for s in SENTENCE.findall(text.as_py().lower()):
                if found := sorted(set(WORD.findall(s))):
                    toxic.append(label)
                    words.append(found)
                    before.append(last)
                    last = zlib.crc32(" ".join(found).encode())
        columns = [pa.array(toxic, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(before, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["toxic", "words", "before"])


def telling_words(drawn: DataFrame, max_words: int, min_evidence: float) -> list[str]:
    """Words whose distinct sentences are in toxic documents far more often than others.

    Sentences after equal ones count once, and as clean if a clean document holds both:
    so the rest of a copied toxic document gains nothing by its copies, yet a sentence
    that stands in different documents counts for each.
    """
    sentences = drawn.mapInArrow(_sentences, "toxic int, words array<string>, before long")
    distinct = materialise(sentences.groupBy("words", "before").agg(F.min("toxic").alias("toxic")), "sentences")
    totals = distinct.agg(F.sum("toxic"), F.count("*")).first()
    bad, all_ = totals[0] or 0, totals[1]
    if not bad or bad == all_:
        return []
    share = bad / all_
    counts = distinct.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    k, n = F.col("k"), F.col("n")
    rest = F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - share)))).otherwise(0.0)
    evidence = 2 * (F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0) + rest)
    strong = counts.withColumn("evidence", evidence).where((k > n * share) & (F.col("evidence") >= min_evidence))
    return [r.word for r in strong.orderBy(F.desc("evidence"), "word").limit(max_words).select("word").collect()]


def train_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, max_words: int = MAX_WORDS, min_evidence: float = MIN_EVIDENCE) -> Model:
    """Fit on at most ``train_rows`` labelled documents, never on held-out ones.

    The rows are chosen by a hash of their id; their ids, of a bounded number, are
    broadcast, so only their texts are shuffled. Null labels and ids are passed over; of several
    labels the toxic one holds, and of several texts of one id the first in order, so a
    repeated id brings no more than one row.
    """
    doc_id = labels["doc_id"].cast("long")
    known = labels.select(doc_id.alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 1))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    matched = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    drawn = materialise(matched.select("text", "toxic"), "labelled")
    words = telling_words(drawn, max_words, min_evidence)
    index = {w: i for i, w in enumerate(words)}

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                found = ([index[w] for w in sorted(set(WORD.findall(s))) if w in index] for s in SENTENCE.findall(text.as_py().lower()))
                out.append([f for f in found if f])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["toxic", "sentences"])

    rows = drawn.mapInArrow(bag, "toxic int, sentences array<array<int>>").toArrow()
    weights, bias, leak = fit_noisy_or(rows["toxic"].to_numpy(), rows["sentences"].combine_chunks(), len(words))
    return Model(dict(zip(words, weights.tolist())), bias, leak)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every whole text's score, label at ``threshold``, and its offending sentences.

    Null and empty texts get the model's leak; null ids stay and are not held out;
    repeated rows get equal scores; an empty table gives no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(t.as_py()) for t in batch.column(1)]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in found] for _, found in got]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([s for s, _ in got], pa.float64()),
                    pa.array([int(s >= threshold) for s, _ in got], pa.int32()),
                    pa.array(spans, kind),
                ],
                ["doc_id", "held_out", "score", "predicted", "offending"],
            )

    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return texts(docs).select("doc_id", "text", held_out.alias("held_out")).mapInArrow(score, SCORED)
