import hashlib
import math
import re
import zlib

import pytest

from tabsight.llm import resampling

from .edge import ROWS, documents, prose

TARGET = ["the quick brown fox jumps over the lazy dog", None, "", "İI straße 日本語 watch from the Stone-bridge", "geese, geese; GEESE!", "a1 b2 c3"]
DOCS = [
    *ROWS,
    *[(100 + i, prose(15 + i % 40, seed=i + 1)) for i in range(150)],
    *[(100 + i, prose(15 + i % 40, seed=i + 1)) for i in range(5)],
    *[(400 + i, prose(30, seed=7)) for i in range(30)],
    (500, "one"),
    (501, "one two"),
    (502, "One, TWO-three_four`five^six[seven] {eight} ~nine\x7ften é"),
    (503, prose(25) + "İSTANBUL Éa"),
]


def features(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n=3, buckets=10_000, share=(5, 100)):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, n)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    total_s, total_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, found = features(text, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    late = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for rank, r in enumerate(late[: len(late) * share[0] // share[1]]):
        r[5] = rank + 1
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.mark.parametrize("n,buckets,share", [(3, 10_000, (5, 100)), (1, 50, (1, 2)), (4, 65_536, (1, 1))])
def test_weights_and_ranks_equal_brute_force(spark, n, buckets, share):
    target = documents(spark, [(None, t) for t in TARGET])
    got = resampling.resample(documents(spark, DOCS).repartition(5), target, share=share, n=n, buckets=buckets).collect()
    assert ordered(got) == ordered(brute(DOCS, TARGET, n, buckets, share))
    assert sum(r["rank"] is not None for r in got) > 5


def test_spans_of_a_text(monkeypatch):
    for chunk in (resampling.CHUNK, 7):
        monkeypatch.setattr(resampling, "CHUNK", chunk)
        for _, text in DOCS:
            words, found = features(text)
            n, got = resampling.feature_buckets((text or "").encode(), resampling.scanner())
            assert n == len(words) and sorted(got.tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in found)


def test_texts_like_the_target_are_drawn(spark):
    like = [(i, " ".join(TARGET[0].split()[(i + k) % 9] for k in range(40))) for i in range(1000, 1010)]
    other = [(i, " ".join(f"w{(i * 7 + k * 13) % 400}" for k in range(40))) for i in range(200)]
    got = resampling.resample(documents(spark, other + like), documents(spark, [(i, TARGET[0]) for i in range(300)]))
    assert {r.doc_id for r in got.where("rank IS NOT NULL").collect()} == {i for i, _ in like}


def test_empty_tables(spark):
    docs, none = documents(spark, DOCS), documents(spark, DOCS).limit(0)
    assert resampling.resample(none, docs).collect() == []
    got = resampling.resample(docs, none).collect()
    assert ordered(got) == ordered(brute(DOCS, []))


def test_too_many_buckets(spark):
    with pytest.raises(ValueError):
        resampling.features(documents(spark, DOCS), buckets=1 << 17)
