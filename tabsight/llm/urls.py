"""URL filters: host-suffix and path-prefix expressions matched by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

RULE_SCHEMA = "rule string, verdict string"
# Hex digits of a digest that the join uses; the whole digest confirms.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rules(rules: DataFrame) -> DataFrame:
    """Rules as (rule, verdict, host labels, path length, digest); a rule is ``host/path``.

    Null and empty rules and verdicts other than allow and block are no rules. Of equal
    rules the blocking one holds.
    """
    named = rules.select(
        F.concat(ascii_lower(F.regexp_extract("rule", r"^[^/]*", 0)), F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)).alias("rule"),
        F.col("verdict"),
    ).where((F.col("rule") != "") & F.col("verdict").isin("allow", "block"))
    host = F.regexp_extract("rule", r"^[^/]*", 0)
    return (
        named.groupBy("rule")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(
            "rule",
            "rule_verdict",
            F.size(F.split(host, r"\.")).alias("labels"),
            (F.length("rule") - F.length(host)).alias("path_length"),
            F.sha2("rule", 256).alias("digest"),
        )
    )


def expressions(labels: list[int], path_lengths: list[int]) -> Column:
    """All host-suffix and path-prefix expressions of a (host, path) that a rule could equal."""
    parts = F.split("host", r"\.")
    n = F.size(parts)
    suffixes = [F.when(n >= k, F.array_join(F.slice(parts, n - k + 1, k), ".")) for k in labels]
    prefixes = [F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in path_lengths]
    return F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes]))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url by the longest rule that fits.

    A rule ``host/path`` fits its host and all subdomains, if the path of the url starts
    with the rule's. Each distinct (host, path) is expanded once into the expressions
    whose number of labels and path length occur in the rules. An equi-join on the first
    digits of their SHA-256 finds candidates, the whole digest confirms them, and the
    longest rule wins (of equal length the blocking, then the first one). Urls that no
    rule fits get ``default``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and get
    the default. Every row is answered, repeated ones too; null ids stay null; without
    rules all get the default. Returns id, host, path, rule (null without one), verdict.
    """
    own = pages.select(pages[id_col].alias(id_col), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"))
    known = split_rules(rules)
    # Bounded: numbers of labels in a host name, and lengths of a rule's path.
    shapes = known.agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("path_length"))).first()
    if not shapes[0]:
        return own.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    short = F.substring("digest", 1, PREFIX_DIGITS).alias("short")
    wanted = (
        own.where(F.col("host") != "")
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(F.array_distinct(expressions(shapes[0], shapes[1]))).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("digest"))
        .select("host", "path", "digest", short)
    )
    found = wanted.join(known.select("rule", "rule_verdict", F.col("digest").alias("rule_digest"), short), "short").where(
        F.col("digest") == F.col("rule_digest")
    )
    best = found.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("n"), (F.col("rule_verdict") == "allow").alias("allows"), "rule")).alias("best")
    )
    won = best.select("host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.allows"), "allow").otherwise("block").alias("won"))
    return own.join(won, ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("won", F.lit(default)).alias("verdict"))
