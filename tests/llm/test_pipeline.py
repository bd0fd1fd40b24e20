"""The stages against plain forms, one after the other, on planted documents."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
from tabsight.llm import simhash, stages, tokens

from .test_alike import plain, similarity
from .test_latent import language
from .test_simhash import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng, text = language(3)
    bench = [(k, text(30) + ". " + text(6) + ".") for k in range(8)]
    docs, labels, toxic, leaks = [], [], set(), set()
    for i in range(240):
        body = text(rng.randrange(60, 200))
        if i % 8 == 0:
            body += f". You {('blockhead', 'numskull')[i // 8 % 2]}, go."
            toxic.add(i)
        elif i % 9 == 0:
            body += " " + bench[i % 8][1]
            leaks.add(i)
        elif i % 7 == 0:
            body += f" write to user{i}@example.com or +1 (555) 010-{1000 + i}"
        docs.append((i, body))
        labels.append((i, 1, int(i in toxic)))
    docs += [(300, docs[1][1]), (301, docs[2][1]), (302, docs[1][1]), (303, None), (304, ""), (303, None), (None, "no id")]
    # Some words changed: alike or not by five-word shingles.
    for i, changes in ((10, 1), (11, 2), (13, 4), (15, 9), (20, 1), (22, 2), (23, 3), (25, 6)):
        words = docs[i][1].split()
        for j in rng.sample(range(len(words)), changes):
            words[j] = text(1)
        docs.append((400 + i, " ".join(words)))
    # Without an id, or with that of another document: judged like others.
    docs += [(None, docs[1][1]), (None, text(50) + " " + bench[3][1]), (5, text(50) + " " + bench[4][1])]
    return docs, labels, bench, toxic, leaks


def test_stages(spark, tmp_path):
    docs, labels, bench, toxic, leaks = planted()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, texts = [], dict(docs)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(now)
        if k < 4:
            assert now.schema == before.schema
    found = [sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in d.collect())) for d in kept[:4]]
    shown = lambda rows: sorted((i is None, i or 0, t or "") for i, t in rows)
    want = [(i, t) for i, t in docs if i not in toxic and i != 303] + [(303, None)]
    assert sorted(set(found[0])) == shown(want) and len(found[0]) == len(want) + 1
    sets = [plain(t) for _, t in want]
    links = [(a, b) for a in range(len(want)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
    groups = brute_components(links, range(len(want)))
    first = {}
    for k in sorted(range(len(want)), key=lambda k: (want[k][0] is None, want[k][0] or 0)):
        first.setdefault(groups[k], k)
    want = [want[k] for k in first.values()]
    assert found[1] == shown(want)
    assert {300, 301, 302, 304, 410}.isdisjoint(i for i, _ in want) and 303 in dict(want)
    leaking = [t for _, t in want if t and any(item in t for _, item in bench)]
    assert len(leaking) > len(leaks) // 2
    want = [(i, t) for i, t in want if t not in leaking]
    assert found[2] == shown(want)
    assert [r[:2] for r in found[3]] == [r[:2] for r in found[2]]
    texts = dict(want)
    for r in kept[3].collect():
        text = texts[r.doc_id]
        clean = re.sub(r"user\d+@example\.com", "[EMAIL]", re.sub(r"\+1 \(555\) 010-\d{4}", "[PHONE]", text)) if text else text
        assert r.text == clean and r.n_chars == len(clean or "")
    final = {r.doc_id: r for r in kept[3].collect()}
    encode = tokens.Encoder(tokens.tokenizer_path("word_bpe_49k.json")).plain.encode
    for r in kept[4].collect():
        ids_ = [*encode(final[r.doc_id].text or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids_))
    assert sum(r.length for r in kept[4].where("doc_id = 1").collect()) == kept[4].where("doc_id = 1").first().doc_tokens


def test_run_gives_the_last_stage(spark, tmp_path):
    docs, labels, bench, _, _ = planted()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows[:60], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[-2:] == ["sequence_id", "offset"] and got.count() > 0


def test_near_duplicates_by_fingerprint_or_by_shingles(spark):
    """A link of 3 bits that the shingles do not show, and one that only they show, by steps."""
    rng, text = language(5)
    common = [text(1) for _ in range(12)]
    found = None
    # A long repetitive text hardly moves its fingerprint when rare words come in.
    for _ in range(40):
        base = " ".join(common) + " "
        one = base * 40 + " ".join(text(1) for _ in range(60))
        other = base * 40 + " ".join(text(1) for _ in range(60))
        bits = bin(simhash.fingerprint(one) ^ simhash.fingerprint(other)).count("1")
        if bits <= 3 and similarity(plain(one), plain(other)) < 0.8:
            found = (one, other)
            break
    assert found
    words = text(200).split()
    near = words.copy()
    near[100] = "changed"
    rows = [(1, found[0]), (2, found[1]), (3, " ".join(words)), (4, " ".join(near)), (5, text(120))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in stages.drop_near_duplicates(spark, docs, "").collect()) == [1, 3, 5]


def test_what_the_packing_stage_leaves_in_a_worker_is_small(spark, monkeypatch):
    # Twelve slices of words that occur once: op8's own memo would hold them all.
    asked = {}
    monkeypatch.setattr(stages.packing, "pack_documents", lambda docs, path, **limits: asked.update(limits, path=path))
    stages.pack(spark, None, "")
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{k}x{j}" for j in range(25_000)) for k in range(12)]})
    limits = asked["path"], asked["slice_bytes"], asked["memo_words"]
    parts = list(tokens.encoded(iter([batch]), *limits))
    enc = tokens.encoder(asked["path"], asked["memo_words"])
    assert len(enc.new.places) <= 100_000 and len(enc.old.places) <= 100_000
    whole = list(tokens.encoded(iter([batch]), asked["path"]))
    assert len(tokens.encoder(asked["path"]).new.places) >= 300_000
    assert len(parts) > len(whole)
    assert np.concatenate([ids for _, ids, _ in parts]).tolist() == np.concatenate([ids for _, ids, _ in whole]).tolist()
