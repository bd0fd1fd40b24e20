import random

import numpy as np
import pyarrow as pa

from tabsight.llm import latent

from .edge import ROWS, documents

COMMON = "the of and to in is that for on with".split()


def language(seed):
    rng = random.Random(seed)
    rare = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(3000)]
    return rng, lambda n: " ".join(rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n))


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(0, 40))] for _ in range(2))
        assert latent.common_length(a, b) == brute_common(a, b)


def corpus():
    rng, text = language(7)
    items = [(k, text(rng.randrange(18, 50)) + ". " + text(8) + ".") for k in range(30)]
    rows, want = [], set()
    for i in range(300):
        body = text(rng.randrange(5, 400))
        if i % 5 == 0:
            k = rng.randrange(30)
            words = items[k][1].split()
            if i % 10 == 0:  # a paraphrase: some words replaced, another case
                words = [text(1) if rng.random() < 0.12 else w.upper() for w in words]
            body = text(rng.randrange(0, 200)) + " " + " ".join(words) + " " + body
            want.add((i, k))
        rows.append((i, body))
    return rows, items, want


def test_planted_items_are_found_and_others_left_alone(spark):
    rows, items, want = corpus()
    bench = spark.createDataFrame([*items, (None, None), (77, ""), (3, "zzz later by text")], "item_id long, text string")
    docs = documents(spark, rows + [(1000 + i, t) for i, (_, t) in enumerate(ROWS)] + [(2000, None)])
    for block in (latent.BLOCK_ITEMS, 11):
        got = {(r.doc_id, r.item_id) for r in latent.find_leaks(docs, bench, block).collect()}
        assert got == want


def test_brute_force_decision(spark):
    """The candidate search misses nothing that the word-by-word decision would take."""
    rows, items, _ = corpus()
    want = set()
    for i, t in rows:
        words = pa.array(latent.words_of(t), pa.string())
        for k, item in items:
            for at in range(0, len(words), latent.STEP):
                if latent.leaked(words, at, latent.words_of(item), latent.answer_of(item)):
                    want.add((i, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in latent.find_leaks(documents(spark, rows), bench).collect()} == want


def test_equal_null_and_short_items(spark):
    rng, text = language(31)
    items = [(1, text(30)), (1, text(30)), (None, text(30)), (None, text(25)), (2, "paris france"), (3, "zyzzyva")]
    rows = [(100 + k, f"{text(50)} {t} {text(50)}") for k, (_, t) in enumerate(items)] + [(200 + k, text(120)) for k in range(40)] + [(300, "paris france"), (301, None), (302, "")]
    got = latent.find_leaks(documents(spark, rows), spark.createDataFrame([*items, (1, items[0][1])], "item_id long, text string")).collect()
    want = [(100 + k, i) for k, (i, _) in enumerate(items)] + [(300, 2)]
    assert sorted(((r.doc_id, r.item_id or 0) for r in got)) == sorted((d, i or 0) for d, i in want)


def test_empty_tables(spark):
    rows, items, _ = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert latent.find_leaks(documents(spark, rows), bench.limit(0)).collect() == []
    assert latent.find_leaks(documents(spark, rows).limit(0), bench).collect() == []


def test_basis_is_a_singular_basis(spark):
    rows, items, _ = corpus()
    block = latent.fit(documents(spark, rows).select("doc_id", "text"), items)
    matrix, index = [], {w: i for i, w in enumerate(block.vocabulary)}
    for _, t in rows:
        words = latent.words_of(t)
        for at in range(0, len(words), latent.STEP):
            ids = [index[w] for w in words[at : at + 2 * latent.STEP] if w in index]
            ids = [i for i in ids if block.telling[i]]
            if len(ids) >= latent.MIN_TERMS:
                matrix.append(block.basis[ids].sum(axis=0))
    got = np.array(matrix, float)
    queries = np.array([block.basis[[index[w] for w in ws if block.telling[index[w]]]].sum(axis=0) for _, ws, _ in block.items], float)
    gram = got.T @ got + queries.T @ queries
    off = gram - np.diag(np.diag(gram))
    assert np.abs(off).max() < 1e-3 * np.diag(gram).max()


def test_words():
    texts = ["A b-c. (D)\n\t!!! e***", "", "  ", "Ünï x"]
    words, bounds = latent.cut_words(pa.array(["skipped", *texts]).slice(1))
    assert words.to_pylist() == ["a", "b-c", "d", "e", "ünï", "x"] and bounds.tolist() == [0, 4, 4, 4, 6]
    assert latent.answer_of("One two. Three four?") == ["three", "four"] and latent.answer_of("a b c d") == ["c", "d"]
