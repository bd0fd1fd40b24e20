import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tabsight.llm import linking, sketches

from .edge import ROWS, documents
from .test_latent import language
from .test_simhash import brute_components


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < 2:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:]))


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def edited():
    """Texts of 5 to 400 words with copies some of which fall below 0.8, a chain of texts each
    of which is alike only to its neighbours, and one large group around a text that is
    no member itself."""
    rng, text = language(21)
    rows = [*ROWS, (30, "word"), (31, "Word "), (32, "word word"), (33, "two words"), (34, "TWO\twords")]
    for i in range(50):
        words = text(rng.choice([5, 40, 100, 400])).split()
        rows.append((100 + 10 * i, " ".join(words)))
        for k in range(4):
            near = list(words)
            for j in rng.sample(range(len(near)), rng.randrange(0, 2 + len(near) // 14)):
                near[j] = text(1)
            rows.append((101 + 10 * i + k, " ".join(near)))
    chain = text(100).split()
    for k in range(30):
        rows.append((2000 - k if k % 2 else 3000 + k, " ".join(chain)))
        for _ in range(2):
            chain[rng.randrange(100)] = text(1)
    hub = text(150).split()
    for k in range(60):
        near = list(hub)
        for j in rng.sample(range(150), 6):
            near[j] = text(1)
        rows.append((4000 + k, " ".join(near)))
    return rows


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(plain(t))
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if any(alike(x, y) for x in sets[a] for y in sets[b])]
    found = brute_components(links, sets)
    return [(i, len(plain(t)), None if i is None else found[i] if plain(t) else i, i is None or not plain(t) or found[i] == i) for i, t in rows]


@pytest.mark.parametrize("group,hub_share,family,ids", [(*linking.linked_sets.__defaults__, linking.BROADCAST_IDS), (900, 1500, 2000, 0), (900, 1500, 0, 0)])
def test_rows_equal_brute_force(spark, monkeypatch, group, hub_share, family, ids):
    monkeypatch.setattr(linking.linked_sets, "__defaults__", (group, hub_share, family))
    monkeypatch.setattr(linking, "BROADCAST_IDS", ids)
    rows = edited()
    got = sketches.near_duplicates(documents(spark, rows), group=group).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)
    assert 100 < sum(not r.kept for r in got)


def test_every_coordinate_fills_and_estimates_the_similarity():
    rng = np.random.default_rng(5)
    members = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for size in (1, 2, 7, 60, 3000):
        for similarity in (0.5, 0.8):
            shared = round(2 * size * similarity / (1 + similarity))
            a, b = members[:size], np.concatenate([members[:shared], members[size : 2 * size - shared]]) if size < 2000 else (members[:size])
            got = sketches.sketch([a, b, np.zeros(0, np.uint64)], 512)
            empty = np.uint64((1 << 64) - 1)
            assert (got[:2] != empty).all() and (got[2] == empty).all()
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs((got[0] == got[1]).mean() - truth) < 0.1


def test_chunks_do_not_change_a_sketch(monkeypatch):
    sets = sketches.shingle_sets(pa.array([t or "" for _, t in ROWS]))
    want = sketches.sketch(sets)
    monkeypatch.setattr(sketches, "CHUNK", 13)
    assert (sketches.sketch(sets) == want).all()
    for text, found in zip((t for _, t in ROWS), sets):
        assert len(found) == len(plain(text))


def test_links_of_a_group_with_labels():
    rng = random.Random(8)
    for _ in range(60):
        base = [rng.sample(range(60), 40) for _ in range(3)]
        sets = [np.array(sorted({*rng.choice(base)[rng.randrange(4) :], *rng.sample(range(60), rng.randrange(6))}), np.uint64) for _ in range(25)]
        names = rng.sample(range(1000), 25)
        pairs = [(i, j) for i, j in combinations(range(25), 2) if alike(set(sets[i].tolist()), set(sets[j].tolist()))]
        links = [(names[i], names[j]) for i, j in pairs]
        want = brute_components(links, names)
        known = brute_components([p for p in pairs if rng.random() < 0.3], range(25))
        got = linking.group_links(sets, names, [known[i] for i in range(25)])
        assert brute_components(got, names) == want


def test_an_empty_table(spark):
    assert sketches.near_duplicates(documents(spark, ROWS).limit(0)).collect() == []
