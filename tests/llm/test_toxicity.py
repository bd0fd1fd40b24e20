import zlib

import numpy as np
import pyarrow as pa

from tabsight.llm import toxicity

from .edge import ROWS, documents, prose


def corpus(n=400):
    rows, labels = [], []
    for i in range(n):
        lines = prose(80, i).split("\n")
        if i % 8 == 0:
            lines[i % len(lines)] += f" you are a {('blockhead', 'numskull')[i // 8 % 2]} really."
        rows.append((i, "\n".join(lines)))
        labels.append((i, 1, int(i % 8 == 0)))
    return rows, labels


def test_learns_from_document_labels_and_locates_sentences(spark):
    rows, labels = corpus()
    docs = documents(spark, rows + [(None, None), (900, ""), (901, "plain " * 5000), (902, "plain. " * 5000 + "Such a Blockhead!")])
    labels = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    texts = dict(rows)
    for i, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == int(i % 8 == 0), i
        for s in got[i].offending:
            assert "blockhead" in texts[i][s.start : s.end] or "numskull" in texts[i][s.start : s.end]
        assert bool(got[i].offending) == (i % 8 == 0)
    assert not got[None].held_out and got[900].score == got[901].score == model.leak
    assert got[902].predicted == 1 and len(got[902].offending) == 1


def test_a_repeated_id_is_learned_from_once(spark):
    rows, labels = corpus(60)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learned = rows[next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1)][0]
    many = documents(spark, rows + [(learned, dict(rows)[learned])] * 50 + [(learned, "~ later text")] * 50)
    a, b = toxicity.train_toxicity(documents(spark, rows), labels), toxicity.train_toxicity(many, labels)
    assert a.weights == b.weights and a.leak == b.leak


def test_held_out_labels_are_not_learned_from(spark):
    rows, labels = corpus()
    kept = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    flipped = [x if x in kept else (x[0], 1, 1 - x[2]) for x in labels]
    schema, docs = "doc_id long, quality int, toxic int", documents(spark, rows)
    a, b = (toxicity.train_toxicity(docs, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert (a.weights, a.bias, a.leak) == (b.weights, b.bias, b.leak)


def test_without_labels(spark):
    docs = documents(spark, ROWS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, none)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(ROWS) and not any(r.predicted for r in got)
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


def test_gradient_follows_the_likelihood():
    rng = np.random.default_rng(0)
    bags = [(int(i % 3 == 0), [[0]] * (i % 3 == 0) + [[1]] * int(rng.integers(1, 3))) for i in range(300)] + [(0, [])] * 100
    labels, sentences = zip(*bags)
    weights, bias, leak = toxicity.fit_noisy_or(np.array(labels), pa.array(sentences, pa.list_(pa.list_(pa.int32()))), 2)
    p = 1 / (1 + np.exp(-(bias + weights)))
    assert p[0] > 0.9 and p[1] < 0.1 and leak < 0.05
