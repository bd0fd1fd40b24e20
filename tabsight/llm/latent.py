"""Benchmark decontamination by latent semantic retrieval.

TF-IDF passages of all documents get latent coordinates by a distributed randomised SVD;
passages whose coordinates are close to a benchmark item's are candidates; the longest
common subsequence of words, and the answer's words among them, decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import slices, texts

# What is trimmed from both ends of a word.
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
# A passage is two steps of words long and begins at each step.
STEP = 32
# Pieces of items in one block (each has its own vocabulary and basis), Gaussian directions, and the
# share of the largest singular value below which a direction is noise.
BLOCK_ITEMS, DIRECTIONS, NOISE = 256, 32, 1e-4
# A word is telling if it occurs at most so often for each step of the corpus, or if it is
# among the MIN_TELLING rarest of an item. Passages need MIN_TERMS telling words.
MAX_SHARE, MIN_TELLING, MIN_TERMS = 0.002, 8, 3
# Least cosine with a piece of an item, and least part of its weight that a passage carries.
MIN_COSINE, MIN_WEIGHT = 0.4, 0.3
# Shares of an item's words in common order: sure, or enough if the answer's are there too.
SURE, ENOUGH, ANSWER = 0.8, 0.6, 0.6
LEAST_WORDS = 6
# Steps whose words are projected at once, rows of a matrix that are summed together, and
# documents whose steps are held at once.
GATHER, ROWS, DOCS = 1024, 512, 512
# Bytes of text that are cut into words at once.
SLICE_BYTES = 4 << 20


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in a row, and where each text's begin (one more at the end): what white
    space parts, in lower case, without punctuation at its ends."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    words = pc.utf8_trim(lists.flatten(), characters=PUNCTUATION)
    full = pc.greater(pc.binary_length(words), 0)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full), before[bounds]


def words_of(text: str) -> list[str]:
    return cut_words(pa.array([text]))[0].to_pylist()


def answer_of(text: str) -> list[str]:
    """The words of the last sentence, or the last third where there is only one."""
    parts = [w for w in map(words_of, re.split(r"[.!?\n]+", text)) if w]
    words = words_of(text)
    return parts[-1] if len(parts) > 1 else words[-(-len(words) // 3) :]


def places_of(words: list[str]) -> list[int]:
    """Where an item's pieces begin: one piece, or as many of a passage's length as cover a
    longer item, from every step and up to its end."""
    last = max(0, len(words) - 2 * STEP)
    return [*range(0, last, STEP), last]


def common_length(a: list[str], b: list[str]) -> int:
    """Words of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = places.get(w, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def steps_of(bounds: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' term ids (-1: none): the known ones in a row, how many each step
    has, and how many steps each text has."""
    sizes = np.diff(bounds)
    steps = -(-sizes // STEP)
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], sizes)
    step = np.repeat(np.cumsum(steps) - steps, sizes) + place // STEP
    known = ids >= 0
    return ids[known], np.bincount(step[known], minlength=int(steps.sum())), steps


def term_ids(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    return pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)


def _summed(parts: DataFrame, dtype: str) -> list[bytes]:
    """Sums of equal blocks over all tasks, in the order of the blocks. Each block is
    added up by a task of its own; the driver gets one array for each."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(d.as_py(), dtype) for d in rows["data"])
        return pa.table({"block": rows["block"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    got = parts.groupBy("block").applyInArrow(add, "block long, data binary").collect()
    return [bytes(r.data) for r in sorted(got, key=lambda r: r.block)]


def _blocks(matrix: np.ndarray) -> pa.RecordBatch:
    pieces = [matrix[i : i + ROWS].tobytes() for i in range(0, len(matrix), ROWS)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int64()), pa.array(pieces, pa.binary())], ["block", "data"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Term ids of all steps in a row, how many each step has, and each step's document, of
    some documents at a time."""
    for part in (batch.slice(at, DOCS) for batch in batches for at in range(0, batch.num_rows, DOCS)):
        ids, lengths = part.column(0), part.column(1)
        counts = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(part.num_rows), np.diff(lengths.offsets.to_numpy()))
        yield ids.flatten().to_numpy(zero_copy_only=False), counts, doc


def passage_vectors(
    ids: np.ndarray, counts: np.ndarray, doc: np.ndarray, basis: np.ndarray, telling: np.ndarray, least: int = MIN_TERMS
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(steps, their passages' coordinates, how many telling words they have) some at a time:
    a passage is the sum of a step's and the next step's rows of the basis; those of fewer
    than ``least`` telling words are left out."""
    step = np.repeat(np.arange(len(counts)), counts)
    step, ids = step[telling[ids]], ids[telling[ids]]
    held = np.bincount(step, minlength=len(counts) + 1)
    joined = np.zeros(len(counts), bool)
    joined[:-1] = doc[1:] == doc[:-1]
    terms = held[:-1] + np.where(joined, held[1:], 0)
    edges = np.searchsorted(step, np.arange(len(counts) + 1))
    for at in range(0, len(counts), GATHER):
        stop = min(len(counts), at + GATHER)
        some = np.flatnonzero(terms[at:stop] >= least)
        if not len(some):
            continue
        end = min(len(counts), stop + 1)
        a, b = edges[at], edges[end]
        sums = np.zeros((end - at + 1, basis.shape[1]), np.float32)
        used = np.flatnonzero(held[at:end])
        sums[used] = np.add.reduceat(basis[ids[a:b]], edges[at + used] - a, axis=0)
        both = sums[some] + np.where(joined[at + some, None], sums[some + 1], 0)
        yield at + some, both, terms[at + some]


class Index:
    """A block of items in latent coordinates: weights of words, a basis, unit pieces, the
    number of each piece's item and its place there, and the telling words that a passage
    needs to be compared with it: MIN_TERMS, or all that the piece has."""

    def __init__(self, vocabulary, telling, basis, items, pieces, unit, norms, needs):
        self.vocabulary, self.telling, self.basis = vocabulary, telling, basis
        self.items, self.pieces, self.unit, self.norms, self.needs = items, pieces, unit, norms, needs


def weigh(items: list[list[str]], index: dict[str, int], df: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse frequencies, and which words tell."""
    telling = df <= MAX_SHARE * total
    for words in items:
        telling[sorted({index[w] for w in words}, key=lambda i: (df[i], i))[:MIN_TELLING]] = True
    return np.log(1 + total / (1.0 + df)), telling


def fit(docs: DataFrame, items: list[tuple[int | None, str]], directions: int = DIRECTIONS) -> Index:
    """Distributed randomised SVD of the TF-IDF passages over the items' vocabulary.

    One pass over the texts saves the term ids of each step of words; document
    frequencies (occurrences), the range of the passage matrix (its Gram matrix times Gaussian
    directions) and the Gram matrix in that range are then sums over tasks, of a size
    that the vocabulary of a block fixes. Items go in pieces; the pieces' own directions are put into the range,
    so rare words of an item are never lost in the noise of the corpus.
    """
    item_words = [words_of(t) for _, t in items]
    index = {w: i for i, w in enumerate(sorted({w for ws in item_words for w in ws}))}
    n = len(index)
    pieces = [(k, at) for k, ws in enumerate(item_words) for at in places_of(ws)]
    piece_words = [item_words[k][at : at + 2 * STEP] for k, at in pieces]

    vocabulary = sorted(index)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        for part in (p for batch in batches for p in slices(batch, "text", SLICE_BYTES)):
            words, bounds = cut_words(part.column(0))
            ids, counts, steps = steps_of(bounds, term_ids(words, known))
            ends = np.concatenate([[0], np.cumsum(steps)])
            held = np.concatenate([[0], np.cumsum(counts)])[ends]
            columns = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, pa.int32())) for e, v in ((held, ids), (ends, counts))]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "lengths"])

    saved = materialise(docs.select("text").mapInArrow(take, "ids array<int>, lengths array<int>"), "steps")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n + 1, np.int64)
        for ids, counts, _ in _steps(batches):
            seen[:n] += np.bincount(ids, minlength=n)
            seen[n] += len(counts)
        yield _blocks(seen)

    seen = np.frombuffer(b"".join(_summed(saved.mapInArrow(frequencies, "block long, data binary"), "i8")), "i8")
    seen = seen if len(seen) else np.zeros(n + 1, np.int64)
    idf, telling = weigh(piece_words, index, seen[:n], int(seen[n]))

    queries = np.zeros((len(pieces), n))
    for q, words in enumerate(piece_words):
        for w in words:
            if telling[index[w]]:
                queries[q, index[w]] += idf[index[w]]
    omega = (np.random.default_rng(11).standard_normal((n, directions)) * idf[:, None] * telling[:, None]).astype(np.float32)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, directions))
        for ids, counts, doc in _steps(batches):
            step = np.repeat(np.arange(len(counts)), counts)
            y = np.zeros((len(counts) + 1, directions), np.float32)
            for steps, both, _ in passage_vectors(ids, counts, doc, omega, telling):
                y[steps] = both
            # A step belongs to the passage it begins and to the one before it.
            follows = np.zeros(len(counts), bool)
            follows[1:] = doc[1:] == doc[:-1]
            z = y[:-1] + np.where(follows[:, None], np.roll(y[:-1], 1, axis=0), 0)
            order = np.argsort(ids, kind="stable")
            sorted_ids, sorted_steps = ids[order], step[order]
            terms, first = np.unique(sorted_ids, return_index=True)
            for t, a, b in zip(terms.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                if telling[t]:
                    total[t] += z[sorted_steps[a:b]].sum(axis=0, dtype=np.float64)
        yield _blocks(total * (idf * telling)[:, None])

    found = b"".join(_summed(saved.mapInArrow(ranged, "block long, data binary"), "f8"))
    y = np.frombuffer(found, "f8").reshape(-1, directions) if found else np.zeros((n, directions))
    start = np.concatenate([queries.T, y / (np.abs(y).max() or 1.0)], axis=1)
    q, r = np.linalg.qr(start)
    q = q[:, np.abs(np.diag(r)) > 1e-9 * max(1e-300, np.abs(np.diag(r)).max())]
    scaled = (q * idf[:, None]).astype(np.float32)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((q.shape[1], q.shape[1]))
        for some in _steps(batches):
            for _, both, _ in passage_vectors(*some, scaled, telling):
                total += both.T @ both
        yield _blocks(total)

    found = b"".join(_summed(saved.mapInArrow(grams, "block long, data binary"), "f8"))
    gram = np.frombuffer(found, "f8").reshape(q.shape[1], -1) if found else np.zeros((q.shape[1],) * 2)
    # The pieces are passages too, so none of their directions is lost.
    gram = gram + (queries @ q).T @ (queries @ q)
    squares, turn = np.linalg.eigh(gram)
    kept = turn[:, squares > (NOISE**2) * max(squares.max(initial=0), 1e-300)]
    basis = (scaled @ kept).astype(np.float32)
    unit = queries @ q @ kept
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = (unit / np.where(norms > 0, norms, 1)).astype(np.float32)
    needs = np.array([min(MIN_TERMS, sum(telling[index[w]] for w in words)) for words in piece_words])
    return Index(sorted(index), telling, basis, [(i, w, answer_of(t)) for (i, t), w in zip(items, item_words)], pieces, unit, norms[:, 0], needs)


def leaked(words: pa.Array, at: int, item: list[str], answer: list[str]) -> tuple[int, int, int] | None:
    """Words in common order, and the region around the item's length from ``at`` on that
    has them, or None."""
    reach = max(2 * STEP, len(item))
    low, high = max(0, at - reach // 2), max(0, min(len(words), at + reach + reach // 2))
    region = words.slice(low, high - low).to_pylist()
    n = common_length(item, region)
    if n < min(len(item), max(LEAST_WORDS, ENOUGH * len(item))):
        return None
    if n < SURE * len(item) and common_length(answer, region) < ANSWER * len(answer):
        return None
    return n, low, high


FOUND = "doc_id long, item_id long, common_words long, item_words long, from_word long, to_word long"


def search(docs: DataFrame, block: Index) -> DataFrame:
    """One row for each document and item of the block that it holds."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(block.vocabulary, pa.string())
        for part in (p for batch in batches for p in slices(batch, "text", SLICE_BYTES)):
            words, bounds = cut_words(part.column(1))
            ids, counts, steps = steps_of(bounds, term_ids(words, known))
            doc = np.repeat(np.arange(len(steps)), steps)
            first = np.cumsum(steps) - steps
            best: dict[tuple[int, int], tuple] = {}
            compared: set[tuple[int, int, int]] = set()
            for which, both, terms in passage_vectors(ids, counts, doc, block.basis, block.telling, max(1, block.needs.min())):
                norms = np.linalg.norm(both, axis=1)
                along = both @ block.unit.T
                least = np.maximum(MIN_COSINE * norms[:, None], MIN_WEIGHT * block.norms[None, :])
                enough = terms[:, None] >= block.needs[None, :]
                for s, k in zip(*np.nonzero((along >= least) & (norms[:, None] > 0) & enough)):
                    d = int(doc[which[s]])
                    k, place = block.pieces[k]
                    _, item, answer = block.items[k]
                    # The item would begin so far before its piece; it may be negative.
                    at, low = int(which[s] - first[d]) * STEP - place, int(bounds[d])
                    if (d, k, at) in compared:
                        continue
                    compared.add((d, k, at))
                    hit = leaked(words.slice(low, int(bounds[d + 1]) - low), at, item, answer)
                    if hit and hit > best.get((d, k), (0,)):
                        best[d, k] = hit
            names = part.column(0).to_pylist()
            out = [(names[d], block.items[k][0], n, len(block.items[k][1]), low, high) for (d, k), (n, low, high) in best.items()]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in FOUND.split(", ")])

    return docs.mapInArrow(find, FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Which documents hold which benchmark items: doc_id, item_id, common_words (longest
    common subsequence with the item's item_words words), from_word, to_word (the region).

    All passages of all whole texts (64 words, from every 32nd) are searched for all
    items, taken in blocks of ``block_items`` pieces: an item of more words than a passage
    is cut into pieces of 64 words, from every 32nd, and is never divided between blocks.
    Where a passage's cosine with a piece is 0.4 or more in the latent space, and it
    carries 0.3 of the piece's weight, the whole item is compared word by word with the
    passage's surroundings: 0.8 of the item's words in the same order tell, or 0.6 if 0.6 of the answer's words (an item's
    last sentence) are in order there too; at least six words, or all of a shorter item. A
    passage needs three of a piece's telling words, or as many as the piece has, so items of
    one and two words are found too.

    Null texts are empty and hold nothing; items without words are passed over. Every
    different (item_id, text) is an item, so equal and null item_ids lose nothing: a document
    has a row for each of them that it holds. Null ids stay; repeated documents are all
    reported; empty tables give no rows.
    """
    own = texts(docs)
    known = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].alias("text")).where(F.col("text").rlike(r"[^\s\p{Punct}]"))
    rows = known.distinct().orderBy("item_id", "text")
    blocks: list[list[tuple[int | None, str]]] = [[]]
    held = 0
    for r in rows.toLocalIterator():
        pieces = len(places_of(words_of(r.text)))
        if held + pieces > block_items and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((r.item_id, r.text))
        held += pieces
    found = [search(own, fit(own, b)) for b in blocks if b]
    if not found:
        return docs.sparkSession.createDataFrame([], FOUND)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
