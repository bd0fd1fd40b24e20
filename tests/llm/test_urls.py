import random

from tabsight.llm.urls import RULE_SCHEMA, judge_urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
PAGES = "page_id long, url string, host int, rule int, verdict int"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    return lower(rest[:end]), path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]


def brute(url, rules, default="allow"):
    """Every rule tried on the url; the longest wins, of equal length the blocking, then the first."""
    host, path = parts(url)
    fits = []
    for rule, verdict in rules:
        rule_host, slash, rule_path = rule.partition("/")
        if host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rule_path):
            fits.append((-len(rule), verdict != "block", rule, verdict))
    return (host, path, min(fits)[2], min(fits)[3]) if fits else (host, path, None, default)


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, 1, 2, 3) for i, u in enumerate(urls)], PAGES).repartition(4)
    got = judge_urls(pages, spark.createDataFrame(rules, RULE_SCHEMA), **options)
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got.orderBy("page_id").collect()]


def test_urls_equal_brute_force(spark):
    rng = random.Random(10)
    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "notexample.org", "org", "x.com", "com", "shop.de", "x.com:80", "ÄB.org", "org.", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/a", "/de/?x=/fr/", "#/de/", "?/es/", "/DE/", "/de/\nb"]
    urls = [f"{rng.choice(['http', 'https', 'HTTP', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(600)]
    urls += [None, "", "example.org/es/", "http:/example.org/es/", "a://b://example.org/es/", "http://example.org/es/" + "z" * 100_000]
    assert judged(spark, urls, RULES) == [brute(u, RULES) for u in urls]


def test_ties_repeats_and_wrong_rules(spark):
    rules = [("a.org/x", "allow"), ("a.org/x", "block"), ("A.ORG/y", "block"), ("b.a.org/", "allow"), ("a.org/zz", "block"),
             (None, "block"), ("", "block"), ("c.org/", "perhaps"), ("c.org/", None)]
    known = [("a.org/x", "block"), ("a.org/y", "block"), ("b.a.org/", "allow"), ("a.org/zz", "block")]
    urls = ["http://a.org/x", "http://a.org/x", "http://a.org/y1", "http://b.a.org/zz", "http://c.org/", "http://A.org/x"]
    assert judged(spark, urls, rules) == [brute(u, known) for u in urls]


def test_without_rules_or_pages(spark):
    assert judged(spark, ["http://a.org/x", None], [], default="block") == [("a.org", "/x", None, "block"), ("", "", None, "block")]
    assert judged(spark, [], RULES) == []


def test_a_hot_host(spark):
    """One url fills most of the table: all of its rows are answered."""
    urls = ["http://www.example.org/es/1"] * 3000 + ["http://y.com/de/2"]
    got = judged(spark, urls, RULES)
    assert got == [("www.example.org", "/es/1", "example.org/es/", "block")] * 3000 + [("y.com", "/de/2", "com/de/", "block")]
