"""Personal data: regex, gazetteer and context labelers vote on candidate spans;
expectation-maximisation weighs them, and a classifier trained on its answer decides.

Everything over rows is DataFrame expressions; only counts of vote patterns, whose number
is bounded by the labelers, come to the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import texts

# Kinds in the contract's order, and their patterns. The possessive
# quantifiers and the look behind change no match: they only keep the search linear, as a
# run that has failed at its beginning fails everywhere.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider candidates of the method, of kinds as above.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
# A text without this has no match that could pass.
NEEDS = {
    ("base", "email"): r"@",
    ("base", "ip"): r"[0-9]\.[0-9]",
    ("base", "card"): r"(?:[0-9][\x20-]?){12}[0-9]",
    ("base", "phone"): r"\+[0-9]",
    ("wide", "email"): r"[\[(]at[\])]",
    ("wide", "ip"): r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    ("wide", "phone"): r"[0-9][.-][0-9]{4}",
}
# Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|us|ca|mx|br|jp|cn|in|au"
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "3|4|5|6|2[2-7]"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail to|mailto|contact|write to|reach|address)\W*$",
    "ip": r"(?i)(?:\bip|host|server|address|client|login from|addr)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment|pan)(?: (?:no|number|nr))?\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|dial|whatsapp)\W*$",
}
AGAINST = r"(?i)(?:version|\bv|release|order|invoice|isbn|issn|serial|build|section|\bid|\bno|#)\W{0,2}$"
BEFORE, AFTER = 32, 4
ADD_FROM = 0.95
ROUNDS, STEPS = 50, 300
LABELERS = ("regex", "gazetteer", "context", "shape", "edges")


def _candidate(origin: str, kind: str, between: str):
    """A match with its place among those of its pattern and what stands around it."""

    def one(x: Column, i: Column) -> Column:
        gap = F.get(F.col(between), i)
        return F.struct(
            F.lit(origin).alias("origin"),
            F.lit(kind).alias("kind"),
            i.alias("place"),
            F.length(gap).cast("long").alias("gap"),
            x.alias("match"),
            F.right(gap, F.lit(BEFORE)).alias("before"),
            F.left(F.get(F.col(between), i + 1), F.lit(AFTER)).alias("after"),
        )

    return one


def _candidates(text: Column) -> tuple[dict[str, Column], Column]:
    """Matches and the texts between them for each pattern, and the candidates of both."""
    pieces, lists = {}, []
    for origin, patterns in (("base", BASE), ("wide", WIDE)):
        for kind, pattern in patterns.items():
            m, p = f"{origin}_{kind}", f"{origin}_{kind}_between"
            some = text.rlike(NEEDS[origin, kind])
            none = F.array().cast("array<string>")
            pieces[m] = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
            pieces[p] = F.when(some, F.split(text, pattern, -1)).otherwise(none)

            lists.append(F.transform(F.col(m), _candidate(origin, kind, p)))
    return pieces, F.concat(*lists)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 13 to 19 digits pass Luhn's check; false for others."""
    value = lambda i: F.substring(F.reverse(number), i, 1).try_cast("int")
    total = reduce(
        lambda a, b: a + b,
        [F.coalesce(value(i) if i % 2 else F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2), F.lit(0)) for i in range(1, 20)],
    )
    return F.length(number).between(13, 19) & (total % 10 == 0)


def passes(kind: Column, match: Column) -> Column:
    """The contract's conditions on a match of a base pattern."""
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (
        F.when(kind == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", luhn(digits(match)))
        .when(kind == "phone", F.length(digits(match)).between(9, 15))
        .otherwise(True)
    )


def located(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts without any candidate, and the candidates as (row, origin, kind, start, end, match, before, after, base)
   

    Matches of a pattern and the texts between them alternate, so a running sum of their
    lengths gives the places, in code points.
    """
    pieces, all_ = _candidates(F.col("text"))
    own = texts(docs).withColumns({"row": F.monotonically_increasing_id(), "text_hash": F.xxhash64("text")})
    found = own.withColumns(pieces).withColumn("found", all_).select("row", "doc_id", "text_hash", F.explode_outer("found").alias("c"))
    saved = materialise(found.select("row", "doc_id", "text_hash", "c.*"), "pii")
    # All windows and groups below need a text's rows together: one exchange serves them.
    dealt = saved.where(F.col("kind").isNotNull()).repartition("row")
    run = Window.partitionBy("row", "origin", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(run)
    cut = dealt.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    cut = cut.withColumn("base", (F.col("origin") == "base") & passes(F.col("kind"), F.col("match")))
    return saved.where(F.col("kind").isNull()).select("row", "doc_id", "text_hash"), cut


def votes() -> dict[str, Column]:
    """What each labeler says of a candidate: 1 personal, -1 not, 0 nothing."""
    kind, match, before, after = (F.col(c) for c in ("kind", "match", "before", "after"))
    number = digits(match)
    gazetteer = (
        F.when(kind == "email", F.when(F.lower(match).rlike(rf"(?:\.|dot[\])] ?)(?:{DOMAINS})$"), 1).otherwise(-1))
        .when(kind == "card", F.when(number.rlike(rf"^(?:{ISSUERS})"), 1).otherwise(-1))
        .when(kind == "phone", F.when(match.rlike(rf"^\+(?:{CALLING_CODES})"), 1).otherwise(0))
        .otherwise(F.when(match.rlike(r"^(?:0|127|255)\."), -1).otherwise(0))
    )
    near = reduce(lambda a, k: a.when(kind == k, before.rlike(CONTEXT[k])), KINDS[1:], F.when(kind == KINDS[0], before.rlike(CONTEXT[KINDS[0]])))
    shape = (
        F.when(kind == "card", F.when(match.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$"), 1).otherwise(-1))
        .when(kind == "phone", F.when(match.rlike(r"[0-9]{3}[ .)-]+[0-9]{3,4}"), 1).otherwise(0))
        .when(kind == "email", F.when(F.length(match) <= 64, 1).otherwise(-1))
        .otherwise(0)
    )
    return {
        "regex": F.when(F.col("base"), 1).when(F.col("origin") == "base", -1).otherwise(0),
        "gazetteer": gazetteer,
        "context": F.when(near, 1).when(before.rlike(AGAINST), -1).otherwise(0),
        "shape": shape,
        "edges": F.when(before.rlike(r"[\p{L}\p{N}_.]$") | after.rlike(r"^(?:[\p{L}\p{N}_]|\.[0-9])"), -1).otherwise(1),
    }


Pattern = tuple[str, tuple[int, ...], int]


def reliabilities(patterns: list[Pattern]) -> list[float]:
    """Expectation-maximisation over vote patterns (kind, votes, how often): the chance
    that a span of each pattern is personal. The share of personal spans is learned for
    each kind, and for each labeler how often it votes what, given the truth."""
    q = [1 / (1 + math.exp(-1.0 * sum(v))) for _, v, _ in patterns]
    for _ in range(ROUNDS):
        said = [{(t, s): 0.5 for t in (0, 1) for s in (-1, 0, 1)} for _ in LABELERS]
        share = {k: [0.5, 0.5] for k in KINDS}
        for (kind, vote, n), p in zip(patterns, q):
            share[kind][1] += n * p
            share[kind][0] += n * (1 - p)
            for table, s in zip(said, vote):
                table[1, s] += n * p
                table[0, s] += n * (1 - p)
        sums = [{t: sum(table[t, s] for s in (-1, 0, 1)) for t in (0, 1)} for table in said]
        new = []
        for kind, vote, _ in patterns:
            log = [math.log(share[kind][t]) + sum(math.log(table[t, s] / total[t]) for table, total, s in zip(said, sums, vote)) for t in (0, 1)]
            new.append(1 / (1 + math.exp(min(700.0, log[0] - log[1]))))
        q = new
    return q


def train_classifier(patterns: list[Pattern], truth: list[float]) -> dict[str, float]:
    """Logistic weights of kinds and votes, fitted to the chances that EM has found."""
    names = [*(f"kind={k}" for k in KINDS), *(f"{x}={s}" for x in LABELERS for s in (-1, 1))]
    at = {n: i for i, n in enumerate(names)}
    rows = [([at[f"kind={k}"], *(at[f"{x}={s}"] for x, s in zip(LABELERS, v) if s)], n, p) for (k, v, n), p in zip(patterns, truth)]
    weights, total = [0.0] * len(names), sum(n for _, n, _ in rows) or 1
    for _ in range(STEPS):
        slope = [0.001 * w for w in weights]
        for active, n, p in rows:
            miss = 1 / (1 + math.exp(-sum(weights[i] for i in active))) - p
            for i in active:
                slope[i] += miss * n / total
        weights = [w - 2.0 * g for w, g in zip(weights, slope)]
    return dict(zip(names, weights))


def find_personal_data(docs: DataFrame, add_from: float = ADD_FROM) -> DataFrame:
    """All personal data of every whole text: (row, doc_id, text_hash, spans), a row for
    each input row; spans are structs (kind number, start, end, base) by kind and start.

    Base spans are the passing matches of the base patterns. On them, on the failing
    ones and on matches of wider patterns labelers vote; EM over the counts of vote
    patterns (at most 4 * 3**5) finds how far to trust each, and a logistic classifier is
    trained on that. Wider matches from ``add_from`` on are added where they overlap no
    base span and no added one before them; failing matches never are.

    Null text is empty, null ids stay, repeated rows are found alike, an empty table
    gives no rows.
    """
    without, cut = located(docs)
    voted = materialise(cut.withColumns(votes()), "votes")
    counts = voted.groupBy("kind", *LABELERS).count().collect()
    patterns = sorted((r["kind"], tuple(r[x] for x in LABELERS), r["count"]) for r in counts)
    weights = train_classifier(patterns, reliabilities(patterns)) if patterns else {}
    z = reduce(
        lambda a, x: a + sum(F.when(F.col(x) == s, weights.get(f"{x}={s}", 0.0)).otherwise(0.0) for s in (-1, 1)),
        LABELERS,
        reduce(lambda a, k: a.when(F.col("kind") == k, weights.get(f"kind={k}", 0.0)), KINDS[1:], F.when(F.col("kind") == KINDS[0], weights.get(f"kind={KINDS[0]}", 0.0))),
    )
    likely = voted.where(F.col("base") | ((F.col("origin") == "wide") & (z > math.log(add_from / (1 - add_from))))).repartition("row")
    # Base spans first count alone; an added one must end before the next begins and begin
    # after all before it have ended.
    rows = Window.partitionBy("row").orderBy("start", F.desc("base"), "end", "kind")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(rows.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(rows.rowsBetween(1, Window.unboundedFollowing))
    clear = likely.withColumns({"ended": F.coalesce(ended, F.lit(0)), "begins": begins}).where(
        F.col("base") | ((F.col("start") >= F.col("ended")) & F.coalesce(F.col("end") <= F.col("begins"), F.lit(True)))
    )
    added = F.max(F.when(~F.col("base"), F.col("end"))).over(rows.rowsBetween(Window.unboundedPreceding, -1))
    kept = clear.withColumn("added", F.coalesce(added, F.lit(0))).where(F.col("base") | (F.col("start") >= F.col("added")))
    number = reduce(lambda a, i: a.when(F.col("kind") == KINDS[i], i), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0))
    span = F.struct(number.alias("kind"), F.col("start"), F.col("end"), F.col("base"))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    # Texts whose candidates all fell: with those that never had one, without spans.
    had = voted.select("row", "doc_id", "text_hash").distinct()
    none = F.array().cast(spans.schema["spans"].dataType)
    some = had.join(spans, "row", "left").select("row", "doc_id", "text_hash", F.coalesce("spans", none).alias("spans"))
    return some.unionByName(without.withColumn("spans", none))


def span_string(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _is(number: int):
    return lambda kind: kind == number


def span_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the base spans, and all spans as a string."""
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, _is(i)), False)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are
    replaced once, by the first of them. Texts without span and all other columns stay."""
    # By start; then those that begin inside an earlier one are merged into it.
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    span_type = "array<struct<start:bigint,end:bigint,kind:int>>"
    last = lambda a: F.get(a, F.size(a) - 1)
    grown = lambda a, s: F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"), last(a)["kind"].alias("kind"))))
    merged = F.aggregate(
        by_start,
        F.array().cast(span_type),
        lambda a, s: F.when((F.size(a) > 0) & (s["start"] < F.coalesce(last(a)["end"], F.lit(0))), grown(a, s)).otherwise(F.concat(a, F.array(s))),
    )
    marked = (
        found.where(F.size("spans") > 0)
        .groupBy(F.col("doc_id").alias("_pii_id"), F.col("text_hash").alias("_pii_hash"))
        .agg(F.first("spans").alias("spans"))
        .select("_pii_id", "_pii_hash", merged.alias("_pii_spans"))
    )
    text = docs[text_col]
    joined = docs.join(marked, docs[id_col].eqNullSafe(F.col("_pii_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_pii_hash")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    cuts = F.col("_pii_spans")
    before = lambda s, i: F.substring(text, F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0)).cast("int") + 1, (s["start"] - F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))).cast("int"))
    pieces = F.transform(cuts, lambda s, i: F.concat(before(s, i), F.get(names, s["kind"])))
    rest = F.substring(text, last(cuts)["end"].cast("int") + 1, F.length(text))
    clean = F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return joined.select(*[clean.alias(c) if c == text_col else docs[c] for c in docs.columns])
