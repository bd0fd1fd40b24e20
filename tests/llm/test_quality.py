import re
from collections import Counter

import numpy as np

from tabsight.llm import quality

from .edge import ROWS, documents, prose

WORDS = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    w = re.findall(WORDS, text)
    lines = [x for x in text.split("\n") if re.search(WORDS, x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    repeated = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated))


MORE = ["a b c a b c", "x x x x x", "l\nl\n \nl\n", "a b c d a b c d e f a b", "#*$%&|<>", "a b c x a b c y b c x"]


def test_counts_equal_a_plain_form():
    for text in [t for _, t in ROWS] + MORE:
        assert quality.text_counts(text or "")[:5] == plain(text)


def junk(i):
    return " ".join(f"{w}***" for w in prose(120, i).split())


def labelled(spark):
    rows = [(i, prose(120 + i, i)) for i in range(300)] + [(1000 + i, junk(i)) for i in range(40)]
    labels = [(i, int(i < 1000), 0) for i, _ in rows if i % 3]
    return rows, spark.createDataFrame(labels + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")


def test_verdicts(spark):
    rows, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.judge_quality(documents(spark, rows + [(5000, None), (5001, "x " * 60), (5002, junk(5))]), labels).collect()}
    assert not got[5000].kept and got[5000].base_failed and got[5001].base_failed
    fine = [i for i, _ in rows if i < 1000 and not got[i].base_failed]
    assert sum(got[i].kept for i in fine) >= 0.9 * len(fine)
    assert not any(got[i].kept for i in got if 1000 <= i < 2000 or i == 5002)


def test_edges(spark):
    rows, labels = labelled(spark)
    got = quality.judge_quality(documents(spark, ROWS), labels.limit(0)).collect()
    assert sorted((r.doc_id or 0, *(r[c] for c in quality.COUNTS[:5])) for r in got) == sorted((i or 0, *plain(t)) for i, t in ROWS)
    assert quality.judge_quality(documents(spark, ROWS).limit(0), labels).collect() == []


def test_paths_shorten_for_outliers():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), [[9.0, 9.0]]])
    s = quality.Forest(x).score(x)
    assert s[-1] == s.max() and 0 < s.min() < 0.5 < s.max() < 1
