import random

from tabsight.llm.preference import preference_examples, preference_segments, swapped_replies

TURNS = "pair_id long, side string, turn long, role string, text string, part string, fork int"


def rows_of(pairs):
    return [(p, side, t, *m, "x", 1) for p, sides in pairs.items() for side, talk in sides.items() for t, m in enumerate(talk)]


def render(message):
    return f"<|{message[0]}|>\n{message[1]}<|end|>\n"


def brute(chosen, rejected):
    """The pair by plain Python: shared prompt, both completions, and their trained spans."""
    same = next((i for i, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))
    out = ["".join(map(render, chosen[:same]))]
    for talk in (chosen[same:], rejected[same:]):
        spans, at = [], 0
        for role, text in talk:
            whole = render((role, text))
            if role == "assistant":
                spans.append((at + len(f"<|{role}|>\n"), at + len(whole)))
            at += len(whole)
        out += ["".join(map(render, talk)), spans]
    return out


def examples(spark, rows):
    made = preference_examples(preference_segments(spark.createDataFrame(rows, TURNS).repartition(4)))
    return {
        r["pair_id"]: [r["prompt"], r["chosen"], [tuple(s) for s in r["chosen_loss"]], r["rejected"], [tuple(s) for s in r["rejected_loss"]]]
        for r in made.collect()
    }


def test_pairs_equal_brute_force(spark):
    rng, pairs = random.Random(4), {}
    for p in range(60):
        talk = [(("user", "assistant")[t % 2], rng.choice(["yes", "no é😀", "", "a\nb"])) for t in range(rng.randrange(1, 9))]
        fork = rng.randrange(len(talk) + 1)
        other = talk[:fork] + [(role, text + rng.choice(["", "!", "?"])) for role, text in talk[fork:]][: rng.randrange(9)]
        pairs[p] = {"chosen": talk, "rejected": other}
    got = examples(spark, rows_of(pairs))
    assert got == {p: brute(s["chosen"], s["rejected"]) for p, s in pairs.items()}


def test_the_prompt_stops_at_the_first_difference(spark):
    """Turns that agree again after the fork are rendered for each side."""
    talk = [("user", "q"), ("assistant", "one"), ("user", "more"), ("assistant", "end")]
    other = [("user", "q"), ("assistant", "two"), ("user", "more"), ("assistant", "end")]
    got = examples(spark, rows_of({1: {"chosen": talk, "rejected": other}}))[1]
    assert got == brute(talk, other) and got[0] == render(("user", "q")) and got[1].endswith(render(("assistant", "end")))


def test_nulls_repeats_and_odd_rows(spark):
    rows = [
        (1, "chosen", 0, None, None), (1, "rejected", 0, "user", ""),
        (1, "chosen", 1, "assistant", "a"), (1, "chosen", 1, "assistant", "a"), (1, "rejected", 1, "assistant", "b"),
        (2, "chosen", None, "user", "first"), (2, "chosen", 0, "assistant", "x" * 100_000),
        (None, "chosen", 0, "user", "no pair"), (3, "neither", 0, "user", "no side"),
    ]
    got = examples(spark, [(*r, None, None) for r in rows])
    assert got[1] == brute([("user", ""), ("assistant", "a")], [("user", ""), ("assistant", "b")])
    assert got[2] == brute([("user", "first"), ("assistant", "x" * 100_000)], [])
    assert set(got) == {1, 2}
    assert preference_segments(spark.createDataFrame([], TURNS)).count() == 0


def test_swapped_replies(spark):
    talk = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "alone"), (None, 0, "user", "x")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preference_examples(preference_segments(swapped_replies(df))).collect()}
    assert got[0]["prompt"] == render(("user", "q0"))
    assert (got[0]["chosen"], got[0]["rejected"]) == (render(("assistant", "a0")), render(("assistant", "a1")))
    assert (got[2]["prompt"], got[2]["chosen"], got[2]["rejected"]) == (render(("user", "alone")), "", "")
    assert set(got) == {0, 1, 2}
