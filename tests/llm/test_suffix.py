import random
from collections import Counter

import numpy as np
import pytest

from tabsight.llm import queries, suffix

from .edge import ROWS, documents, prose


def plain(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs, at = [], 0
        while at < len(d):
            end = at
            while end < len(d) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                runs.append((at, end))
            at = end
        out.append((len(d), sum(gone), runs, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def passages(seed):
    """Texts that share passages of all lengths around the span, copies, runs and periods."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    shared = [fresh(rng.randrange(8, 60)) for _ in range(6)]
    rows = []
    for _ in range(40):
        rows.append("".join(rng.choice([rng.choice(shared), fresh(rng.randrange(1, 30))]) for _ in range(rng.randrange(1, 6))))
    whole = fresh(80)
    rows += [whole, whole, whole[:150] + "X" + whole[150:], "z" * 300, "ab" * 100 + fresh(9), whole * 2, fresh(4) + shared[0] + fresh(3) + shared[0]]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,chunk", [(1, suffix.CHUNK), (2, 64), (3, suffix.CHUNK)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    rows = passages(seed) + ROWS
    span = 64
    got = suffix.remove_repeats(documents(spark, rows), span=span, gram=17, cells=8).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    mine = sorted([(r.doc_id, r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got], key=key)
    want = sorted([(i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], span))], key=key)
    assert mine == want
    assert 0 < sum(r[2] for r in want) < sum(r[1] for r in want)


def test_at_the_contract_length(spark):
    a, b = prose(300, 1), prose(300, 50)
    rows = [(1, a), (2, b), (3, b[:500] + a[100:499] + b[:200]), (4, a[100:500] + "tail"), (5, "q" * 399), (6, "q" * 400)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffix.remove_repeats(documents(spark, rows)).collect()}
    assert got == {i: x for (i, _), x in zip(rows, plain([t for _, t in rows], 400))}


def test_passages_of_over_fifty_words_mark_their_documents(spark, tmp_path):
    """Documents that share 400 bytes or more are marked and lose them; those that share 399, or
    nothing, are left alone."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 12)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    rows, marked = [], set()
    for n in (75, 120, 200, 400):
        passage = fresh(n)
        assert len(passage) >= 400
        for _ in range(3):
            marked.add(len(rows))
            rows.append((len(rows), f"{fresh(rng.randrange(1, 90))}\n{passage}\n{fresh(rng.randrange(1, 90))}"))
    short = fresh(90)[:397]
    # A line break on both sides makes 399 bytes in common.
    rows += [(len(rows) + i, f"{fresh(40)}{i}\n{short}\n{i}{fresh(40)}") for i in range(3)]
    rows += [(len(rows) + i, fresh(rng.randrange(1, 300))) for i in range(20)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if r.has_repeat} == marked
    want = {i: gone for (i, _), (_, gone, _, _) in zip(rows, plain([t for _, t in rows], 400))}
    assert {r.doc_id: r.n_removed for r in got} == want


def test_an_empty_table(spark):
    assert suffix.remove_repeats(documents(spark, ROWS).limit(0)).collect() == []


def test_anchor_is_the_leftmost_least():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 6, 400).astype(np.uint64) << np.uint64(30)
    for window in (1, 7, 48):
        got = suffix.anchors(keys, window)
        assert got.tolist() == [i + int(np.argmin(keys[i : i + window])) for i in range(400 - window + 1)]
