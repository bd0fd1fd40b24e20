import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.llm import infill

from .edge import ROWS, documents, prose

CASES = [
    *ROWS,
    (20, "a mark <P> inside"),
    (21, "half marks <P <S< <M"),
    (22, "<S<S<<M<P<"),
    (23, "é"),
    (24, "日本語 and \U0001f600\U0001f600 more É"),
    (25, "A"),
    (26, "line\r\nbreaks\x00 and\x7f controls ÀÿĀ"),
    *[(100 + i, "<" * (i % 5) + f"some {'é' * (i % 7)} Text{i}, 日{i}<S") for i in range(200)],
]


def plain(doc_id, text):
    """The contract, by Python's own code points."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(tokens)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_forms_equal_brute_force_and_restore(spark):
    docs = documents(spark, CASES)
    got = infill.fill_in_middle(docs).withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda row: tuple((v is None, v or 0) if not isinstance(v, str) else v for v in row)
    want = [(i, *plain(i, t), t or "") for i, t in CASES]
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_cuts_convert_both_ways():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Z", " ", "é", "日", "\U0001f600", "\x7f", "߿", "ࠀ", "￿"]) for _ in range(rng.randrange(30)))
        index = infill.Exceptions(np.frombuffer(text.encode(), np.uint8))
        cuts = np.arange(len(text) + 1)
        in_bytes = [len(text[:c].encode()) for c in cuts]
        assert index.bytes(cuts).tolist() == in_bytes
        assert index.chars(np.array(in_bytes)).tolist() == cuts.tolist()
        assert index.length == len(text)
        assert len(index.byte_at) == sum(ord(c) > 127 for c in text)  # nothing is kept for ASCII


@pytest.mark.parametrize("text", ["x" * 300_000, prose(60_000), "é" * 100_000])
def test_very_long_texts(text):
    for i in (1, 2, 3):
        n, form, prefix, middle, output = infill.infill(text.encode(), i)
        assert (n, form, prefix, middle, output.decode()) == plain(i, text)


def test_an_empty_table(spark):
    assert infill.fill_in_middle(documents(spark, CASES).limit(0)).collect() == []
