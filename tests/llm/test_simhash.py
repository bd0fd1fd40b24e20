import random
from itertools import combinations

import pytest
import xxhash

from tabsight.llm import simhash
from tabsight.llm.components import connected_components

from .edge import ROWS, documents, prose


def plain(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [words] if len(words) < k else [words[i : i + k] for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprints_equal_a_plain_form(monkeypatch):
    for chunk in (simhash.CHUNK_WORDS, 7):
        monkeypatch.setattr(simhash, "CHUNK_WORDS", chunk)
        for _, text in ROWS:
            assert simhash.fingerprint(text or "") == plain(text)
    assert simhash.fingerprint("a b c d e", 5) == plain("a b c d e", 5)


def test_tree_finds_all_within_the_radius():
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = [s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for s in seeds for _ in range(15)]
    tree = simhash.Tree()
    for i, v in enumerate(values):
        assert sorted(tree.add(v, 3)) == [j for j in range(i) if (values[j] ^ v).bit_count() <= 3]


@pytest.mark.parametrize("size", [2048, 30])
def test_components_equal_brute_force(spark, size):
    text = prose(400, 9).split()
    rows = list(ROWS)
    for i in range(60):
        near = list(text)
        for j in range(i % 4):
            near[(i * 37 + j * 101) % 400] = f"new{i}"
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, prose(50, i)) for i in range(20)]
    got = simhash.near_duplicates(documents(spark, rows), tree_size=size).collect()
    fp = {i: plain(t) for i, t in rows if i is not None}
    want = brute_components([(a, b) for a, b in combinations(sorted(fp), 2) if (fp[a] ^ fp[b]).bit_count() <= 3], fp)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert len(set(want.values())) < len(want) - 50


def test_an_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, ROWS).limit(0)).collect() == []


def test_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(3, 3), (900, 901), (901, 900)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in brute_components(links, {n for x in links for n in x}).items() if k != 3}
