"""Whole texts to token ids, a batch at a time."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from .common import process_cache, slices

# Bytes of text encoded at once, and distinct pieces that each half of a worker's memo holds.
SLICE_BYTES = 4 << 20
MEMO_WORDS = 500_000
# Novel pieces that go to the library in one string, between its end mark.
GROUP = 64
END = "<|endoftext|>"
# Words of Latin letters, perhaps after a space: one unit of either tokenizer's first step.
# Letters whose small form has several code points are left out.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+")
_PROBES = ["word", " word", " Word", "Éa", " señor", " Straße", " Ža"]
# ASCII punctuation before which a letter's unit ends; | is left out as it is in END.
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;=?@[]^_`{}~>")] = True


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable Latin-1 as it is, the others as the
    characters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def _kept(word: str) -> str:
    return word.encode().decode("latin-1").translate(_BYTE_LETTERS)


def _lowered(word: str) -> str:
    return _kept(word.lstrip(" ").lower())


class Half:
    """Ids of pieces in one flat array, found by a dictionary of places."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.begins, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def add(self, pieces: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.places)
        self.places.update(zip(pieces, range(n, n + len(pieces))))
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths and the ids in a row of the pieces at some places."""
        lengths = self.begins[at + 1] - self.begins[at]
        ends = np.cumsum(lengths)
        return lengths, self.ids[np.repeat(self.begins[at] - (ends - lengths), lengths) + np.arange(lengths.sum())]


class Encoder:
    """Ids of whole texts by a tokenizer file, equal to those of the library's own
    ``encode(text, add_special_tokens=False)`` with special strings as ordinary text.

    Neither tokenizer looks across a run of plain white space that follows another
    character, nor from a letter to punctuation, so texts are cut there and each distinct
    piece is encoded by the library once. Where the character before white space is some
    other white space, nothing is cut, as the run could join it. Plain words go straight to the
    library's model. The pieces that a worker remembers are bounded (by ``memo_words``, else
    MEMO_WORDS): when the newer half of its memo is full, it becomes the older one, whose
    pieces are taken over when they are met.
    """

    def __init__(self, path: str, memo_words: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.memo_words = memo_words
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.end = self.plain.token_to_id(END)
        self.vocabulary = self.plain.get_vocab_size(with_added_tokens=True)
        self.new, self.old = Half(), Half()
        probes = [self.plain.encode(p, add_special_tokens=False).ids for p in _PROBES]
        same = [form for form in (_kept, _lowered) if [[t.id for t in self.plain.model.tokenize(form(p))] for p in _PROBES] == probes]
        self.form = same[0] if same else None

    def _encoded(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pieces in some order, with their lengths and ids."""
        simple = [p for p in pieces if _WORD.fullmatch(p)] if self.form else []
        rest = [p for p in pieces if not _WORD.fullmatch(p)] if self.form else pieces
        tokenize, form = self.plain.model.tokenize, self.form
        found = [tokenize(form(p)) for p in simple]
        lengths = [np.fromiter(map(len, found), np.int64, len(found))]
        ids = [np.array([t.id for tokens in found for t in tokens], "<u4")]
        odd, plain = [p for p in rest if "<|" in p], [p for p in rest if "<|" not in p]
        for got in self.plain.encode_batch_fast(odd, add_special_tokens=False):
            lengths.append(np.array([len(got.ids)]))
            ids.append(np.array(got.ids, "<u4"))
        self.plain.encode_special_tokens = False
        for at in range(0, len(plain), GROUP * 256):
            part = plain[at : at + GROUP * 256]
            groups = [part[i : i + GROUP] for i in range(0, len(part), GROUP)]
            for got in self.plain.encode_batch_fast([END.join(g) for g in groups], add_special_tokens=False):
                own = np.array(got.ids, "<u4")
                marks = np.flatnonzero(own == self.end)
                lengths.append(np.diff(np.concatenate([[-1], marks, [len(own)]])) - 1)
                ids.append(own[own != self.end])
        self.plain.encode_special_tokens = True
        return simple + odd + plain, np.concatenate(lengths), np.concatenate(ids)

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the newer half of the memo has the words, after learning what it lacks."""
        at = np.fromiter(map(self.new.places.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        if self.new.places and len(self.new.places) + len(missing) > (self.memo_words or MEMO_WORDS):
            self.old, self.new = self.new, Half()
            return self._places(words)
        lacking = [words[i] for i in missing.tolist()]
        known = [w for w in lacking if w in self.old.places]
        if known:
            self.new.add(known, *self.old.take(np.fromiter(map(self.old.places.get, known), np.int64, len(known))))
        novel = [w for w in lacking if w not in self.old.places]
        if novel:
            self.new.add(*self._encoded(novel))
        at[missing] = np.fromiter(map(self.new.places.get, lacking), np.int64, len(lacking))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids begin (one more at the end)."""
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if bounds[-1] == bounds[0]:
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
        starts = _cuts(raw, bounds - bounds[0])
        edges = np.append(starts, len(raw)).astype(np.int32)  # a value of Spark has under 2 GB
        pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        places = self._places(pieces.dictionary.to_pylist())
        each, ids = self.new.take(places[pieces.indices.to_numpy()])
        before = np.concatenate([[0], np.cumsum(each)])
        return ids, before[np.searchsorted(starts, bounds - bounds[0])]


def _cuts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin: at texts, before white space after something else, and before
    punctuation after a letter A-Z, a-z."""
    space = (raw == 32) | (raw == 10) | (raw == 9) | (raw == 13)
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    at = np.flatnonzero(cut)
    last = raw[at - 1]  # of the first position any value will do: it begins a text
    odd = (last == 11) | (last == 12) | ((last >= 28) & (last <= 31))
    # The other white space of Unicode, by its first bytes; some more characters do no harm.
    two = (raw[at - 2] == 0xC2) & ((last == 0x85) | (last == 0xA0))
    a, b = raw[at - 3], raw[at - 2]
    three = (last >= 0x80) & (((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))
    cut[at[odd | two | three]] = False
    small = raw | 0x20
    cut[1:] |= _PUNCTUATION[raw[1:]] & (small[:-1] >= 97) & (small[:-1] <= 122)
    cut[bounds[:-1][bounds[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)


def encoder(path: str, memo_words: int | None = None) -> Encoder:
    """The worker's encoder of this file and memo."""
    known = process_cache("encoders")
    if (path, memo_words) not in known:
        known[path, memo_words] = Encoder(path, memo_words)
    return known[path, memo_words]


def encoded(
    batches: Iterator[pa.RecordBatch], path: str, slice_bytes: int = SLICE_BYTES, memo_words: int | None = None
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with a ``text`` column, with ids and where each text's begin."""
    enc = encoder(path, memo_words)
    for batch in batches:
        for part in slices(batch, "text", slice_bytes):
            yield part, *enc.encode(part.column(part.schema.get_field_index("text")))


def bits_for(vocabulary: int) -> int:
    """The bits that the largest id of a vocabulary takes."""
    return max(1, (vocabulary - 1).bit_length())


