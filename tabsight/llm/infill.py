"""Fill-in-middle: texts cut at token borders and put together with the middle last."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, 1
SLICE_BYTES = 4 << 20
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """Where the code points of a UTF-8 text are: only characters of several bytes are kept,
    with the bytes beyond one that they and all before them add; what lies between them is
    a byte a code point."""

    def __init__(self, raw: np.ndarray):
        self.size = len(raw)
        self.byte_at = np.flatnonzero(raw >= 0xC0)
        lead = raw[self.byte_at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))])
        self.char_at = self.byte_at - self.excess[:-1]

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """How many code points lie before cuts in bytes (between characters)."""
        return cuts - self.excess[np.searchsorted(self.byte_at, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """How many bytes lie before cuts in code points."""
        return cuts + self.excess[np.searchsorted(self.char_at, cuts)]

    @property
    def length(self) -> int:
        """The code points of the text."""
        return int(self.size - self.excess[-1])


def token_starts(raw: np.ndarray, index: Exceptions) -> np.ndarray:
    """The code points at which tokens begin: a run of letters A-Z, a-z is a token, any
    other character is one."""
    lower = raw | 0x20
    letter = (lower >= 97) & (lower <= 122)
    starts = (raw < 0x80) | (raw >= 0xC0)
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return index.chars(np.flatnonzero(starts))


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that depend on the id alone."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def infill(text: bytes, doc_id: int | None, seed: int = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output) of a text."""
    raw = np.frombuffer(text, np.uint8)
    index = Exceptions(raw)
    starts = token_starts(raw, index)
    n = len(starts)
    first, second, form, order = draws(doc_id, seed)
    if not n or form % 100 >= PLAIN_FROM or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    units = sorted((first % (n + 1), second % (n + 1)))
    cuts = np.array([starts[u] if u < n else index.length for u in units])
    a, b = index.bytes(cuts).tolist()
    prefix, middle, suffix = PREFIX.encode() + text[:a], MIDDLE.encode() + text[a:b], SUFFIX.encode() + text[b:]
    spm = order % 100 < SPM_BELOW
    output = suffix + prefix + middle if spm else prefix + suffix + middle
    return n, SPM if spm else PSM, int(cuts[0]), int(cuts[1] - cuts[0]), output


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text.

    Two hashed draws cut a text of n tokens (a run of letters A-Z, a-z, or any other
    character) into prefix, middle and suffix, each perhaps empty. A tenth of the texts, texts
    that hold a mark, empty and null texts stay as they are (plain, without counts); a fifth of the
    rest puts the suffix first (spm). Draws depend on the id alone, so rows that repeat an
    id get the same draws; a null id draws as the empty id. Nothing is shuffled, and a row is
    one row of the result; no documents give no rows.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text", SLICE_BYTES)):
            rows = [infill(t.as_py(), i, seed) for i, t in zip(part.column(0).to_pylist(), part.column(1))]
            n, form, prefix, middle, output = zip(*rows)
            columns = [
                part.column(0),
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()),
                pa.array(output, pa.binary()).view(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    raw = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    return raw.mapInArrow(transform, COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that holds a mark is plain, and no
    mark can begin inside another one, so splitting at marks gives back the three parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    prefix, suffix = F.when(form == PSM, parts[1]).otherwise(parts[2]), F.when(form == PSM, parts[2]).otherwise(parts[1])
    return F.when(form == PLAIN, output).otherwise(F.concat(prefix, parts[3], suffix))
