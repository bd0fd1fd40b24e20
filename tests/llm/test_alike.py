import random
from itertools import combinations

import numpy as np
import pytest

from tabsight.llm import alike, stages

from .edge import ROWS, documents
from .test_latent import language
from .test_simhash import brute_components


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited():
    """Texts of 100 to 500 words with copies of up to so many changed words that some
    fall below a similarity of 0.8."""
    rng, text = language(21)
    rows, pairs = list(ROWS), 0
    for i in range(60):
        words = text(rng.choice([100, 200, 500])).split()
        rows.append((100 + 10 * i, " ".join(words)))
        for k in range(3):
            near = list(words)
            for j in rng.sample(range(len(near)), rng.randrange(1, 1 + len(near) // 40)):
                near[j] = text(1)
            rows.append((101 + 10 * i + k, " ".join(near)))
    return rows


def brute(rows):
    sets = {i: plain(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if similarity(sets[a], sets[b]) >= 0.8]
    return links, brute_components(links, sets)


@pytest.mark.parametrize("group", [alike.GROUP, 700])
def test_components_equal_brute_force(spark, group):
    rows = edited()
    links, want = brute(rows)
    assert len([1 for a, b in links if b - a < 4]) > 60
    got = alike.alike_groups(documents(spark, rows), group).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(want.items())


def test_the_stage_drops_planted_edits(spark):
    rows = edited()
    _, want = brute(rows)
    got = {r.doc_id for r in stages.drop_near_duplicates(spark, documents(spark, rows), "").collect()}
    assert got - {None} == {i for i, c in want.items() if i == c}


def test_links_of_a_group():
    rng = random.Random(8)
    for _ in range(30):
        base = [rng.sample(range(60), 40) for _ in range(3)]
        sets = [np.array(sorted({*rng.choice(base)[rng.randrange(4) :], *rng.sample(range(60), rng.randrange(6))}), np.uint64) for _ in range(25)]
        names = rng.sample(range(1000), 25)
        links = [(names[i], names[j]) for i, j in combinations(range(25), 2) if similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
        got = brute_components(alike.group_links(sets, names), names)
        assert got == brute_components(links, names)


def test_an_empty_table(spark):
    assert alike.alike_groups(documents(spark, ROWS).limit(0)).collect() == []
