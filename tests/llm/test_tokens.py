import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabsight.llm import bitpack, packing, tokens

from .edge import ROWS, documents


def ids_of(name):
    tok = Tokenizer.from_file(tokens.tokenizer_path(name))
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    import pyarrow as pa

    texts = [t or "" for _, t in ROWS] + [" ", "a", "", " \n x", "a \n b", "<|", "a  b"]
    enc, want = tokens.Encoder(tokens.tokenizer_path(name)), ids_of(name)
    for memo in (tokens.MEMO_WORDS, 3):
        monkeypatch.setattr(tokens, "MEMO_WORDS", memo)
        ids, begins = enc.encode(pa.array(["skipped", *texts]).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [want(t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_mixed_texts_equal_the_library(name, monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    parts = ["word", "Señor", "Ünï", "don't", "I'LL", "x'S", "İI", "Σίσυφος.", "ŉſ", "é", "e\u0301", "=\u0338", "a=\u0338", "日本", "1", "42", "A1b2", "_x_", "<|", "|>", "a|b", tokens.END]
    parts += [*" \n\t.,;:!?'\"()[]{}<>=+-*/#@&%$^~`|\\", "  ", "\r\n", "\u00a0", "\u2003", "\x0b", "\x1c", "\u00ad", "²", "½", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    enc, want = tokens.Encoder(tokens.tokenizer_path(name)), ids_of(name)
    assert enc.form is not None
    for memo in (tokens.MEMO_WORDS, 40):
        monkeypatch.setattr(tokens, "MEMO_WORDS", memo)
        for at in range(0, len(texts), 500):
            ids, begins = enc.encode(pa.array(texts[at : at + 500]))
            for t, a, b in zip(texts[at:], begins, begins[1:]):
                assert ids[a:b].tolist() == want(t), t


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 31])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype("<u4")
    data = bitpack.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (bitpack.unpack(data, bits, 1001) == ids).all()


def test_files_read_back(spark):
    manifest = bitpack.write_token_files(documents(spark, ROWS), tokens.tokenizer_path("byte_bpe_50k.json"), 0, block=64)
    got = sorted(map(tuple, bitpack.read_token_files(manifest).collect()), key=lambda r: (r[1], r[2]))
    want, at, encode = [], 0, ids_of("byte_bpe_50k.json")
    groups = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in groups:
        ids = [*encode(t), 0]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    for path in [r.path for r in manifest.collect()]:
        r = bitpack.Reader(path)
        for k in range(r.n_docs):
            text = [t for i, t in ROWS if i == (None if r.missing[k] else r.doc_ids[k])]
            assert r.document(k).tolist() in [[*encode(t), 0] for t in text]
        assert r.bits == 16


def test_no_documents(spark):
    empty = documents(spark, ROWS).limit(0)
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    assert bitpack.read_token_files(bitpack.write_token_files(empty, path, 0)).collect() == []
    assert packing.pack_documents(empty, tokens.tokenizer_path("word_bpe_49k.json"), 1).collect() == []


def test_cut_file_is_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"TIDB0001" + bytes(60))
    with pytest.raises(ValueError, match="cut short"):
        bitpack.Reader(str(tmp_path / "x"))


@pytest.mark.parametrize("capacity,bucket", [(2048, 65_536), (64, 5), (64, 10_000)])
def test_packing(spark, capacity, bucket):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    rows = packing.pack_documents(documents(spark, ROWS), path, 1, capacity, bucket).collect()
    encode = ids_of("word_bpe_49k.json")
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id, r.doc_tokens].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in ROWS:
        ids = [*encode(t), 1]
        for s in range(0, len(ids), capacity):
            want[i, len(ids)].append((s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])))
    assert {k: sorted((r.start, r.length, r.ids_crc32) for r in v) for k, v in docs.items()} == {k: sorted(v) for k, v in want.items()}
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = sorted(rng.integers(1, 65, 300).tolist(), reverse=True)
        window, offset = packing.best_fit(lengths, 64)
        rooms = []
        for n, w, o in zip(lengths, window, offset):
            fits = [r for r in rooms if r >= n]
            if not fits:
                assert w == len(rooms)
                rooms.append(64)
            else:
                assert rooms[w] == min(fits)
            assert o == 64 - rooms[w]
            rooms[w] -= n
