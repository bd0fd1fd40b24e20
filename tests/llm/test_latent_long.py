import pytest

from tabsight.llm import latent

from .edge import documents
from .test_latent import language


def long_items():
    """Items of 250 and 600 words, verbatim and with words replaced, deep in documents."""
    rng, text = language(31)
    items = [(k, text((250, 600)[k % 2] - 8) + ". " + text(8) + ".") for k in range(8)]
    items += [(100 + k, text(30) + ". " + text(6) + ".") for k in range(4)]
    rows, want = [], set()
    for i in range(80):
        body = text(rng.randrange(5, 300))
        if i % 2 == 0:
            k, item = items[(i // 2) % 12]
            words = item.split()
            share = (0, 0.12, 0.3)[i // 2 % 3] if k < 100 else 0
            kept = len(words) - 8 if share == 0.3 else len(words)
            words = [text(1) if j < kept and rng.random() < share else w for j, w in enumerate(words)]
            body = text(rng.randrange(0, 700)) + " " + " ".join(words) + " " + body
            want.add((i, k))
        rows.append((i, body))
    return rows, items, want


@pytest.mark.parametrize("block", [latent.BLOCK_ITEMS, 20])
def test_items_longer_than_a_passage_are_found(spark, block):
    rows, items, want = long_items()
    got = latent.find_leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want)
    sizes = dict((k, len(latent.words_of(t))) for k, t in items)
    assert all(r.item_words == sizes[r.item_id] and r.from_word < r.to_word for r in got)


def test_pieces_cover_an_item():
    for n in (1, 63, 64, 65, 96, 97, 250, 600):
        places = latent.places_of(["w"] * n)
        held = {j for at in places for j in range(at, min(n, at + 2 * latent.STEP))}
        assert held == set(range(n)) and (n > 64 or places == [0])
