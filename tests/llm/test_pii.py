import hashlib
import re

from tabsight.llm import pii

from .edge import ROWS, documents


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


TRICKY = [
    "mail a.b+c@x-y.co.uk, d@e and f@g.h_i@j.kl@m.no",
    "a@b.c_d@e.f@g.h..i@j.k",
    "ééé x@y.zz \U0001f600 1.2.3.4.5.6.7.8 300.1.1.1 0001.002.03.255 256.1.1.1 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111 7",
    "call +1 (017) 555-7713 or +49 30 1234567 12 +1 2 +123456789012345678 ++33 1 23 45 67 89.",
    "+1 23.4.5.6 5500005555555559 x@1.2.3.4",
    "0" * 400 + "@" + "1" * 300 + ".5",
    "reach me: jane [at] mail [dot] example [dot] com or (555) 123-4567",
    "phone 555-123-4567 and call 555-987-6543; order 555-000-1111",
]
CASES = ROWS + [(100 + i, t) for i, t in enumerate(TRICKY)]


def parsed(s):
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]


def test_base_spans_equal_a_plain_search(spark):
    got = pii.span_digest(pii.find_personal_data(documents(spark, CASES))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, str(r[1:]))
    want = []
    for i, t in CASES:
        base = plain(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *(sum(x[0] == k for x in base) for k in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(want, key=key)
    texts = dict(CASES)
    for r in got:
        spans = parsed(r.spans)
        base = plain(texts[r.doc_id])
        assert set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1], s[2]))
        for s in set(spans) - set(base):
            assert all(s[2] <= o[1] or o[2] <= s[1] for o in spans if o != s)


def test_an_empty_table(spark):
    assert pii.find_personal_data(documents(spark, ROWS).limit(0)).collect() == []


def test_votes_are_weighed():
    good, bad, odd = (1, 1, 1, 1, 1), (-1, -1, 0, -1, -1), (0, 1, 1, 1, 1)
    patterns = [("phone", good, 50), ("phone", bad, 80), ("phone", odd, 5)]
    truth = pii.reliabilities(patterns)
    assert truth[0] > 0.99 and truth[1] < 0.01 and truth[2] > 0.9
    w = pii.train_classifier(patterns, truth)
    assert w["edges=1"] > 0 > w["edges=-1"]


def test_redaction(spark):
    docs = documents(spark, CASES)
    found = pii.find_personal_data(docs)
    out = pii.redact(docs, found)
    assert out.columns == docs.columns and out.count() == len(CASES)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] is None and got[12] == dict(CASES)[12]
    assert got[102] == "ééé [EMAIL] \U0001f600 [IP].[IP] 300.1.1.1 [IP] 256.1.1.1 1.2.3"
    # The leftmost match of a card is "6 5500005555555559", which fails, and is not retried.
    assert got[105] == "+1 [IP] 5500005555555559 [EMAIL]"
