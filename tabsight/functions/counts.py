"""Value counts of many columns at once, and cardinality gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .columns import AGGREGATES_PER_SCAN, col, union_all

# A sketch estimate this many times over the gate cannot belong to a column that passes
# it (relative error 5 % standard deviation); nearer columns are counted exactly.
GATE_MARGIN = 2.0
# Longer texts are grouped by head and digest, so counting them does not shuffle them.
LONG_TEXT_BYTES = 64


def text(name: str) -> Column:
    return col(name).cast("string")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, digest, count)`` over non-null values, value as text.

    Every type family is counted in its own type, so 1.0 and 1.00 are one value and no
    number is formatted before it is counted. Counting combines on the map side, so a
    value that fills a third of a column crosses the network once per task. Of a long
    text only the head and a SHA-256 digest are grouped and shuffled; ``with_full_text``
    brings back the few texts that are shown.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(_family(types[c]), []).append(c)
    frames = []
    for target, members in families.items():
        long = df.select(*[col(c).cast(target).alias(c) for c in members]).unpivot(
            [], [col(c) for c in members], "column", "value"
        )
        long = long.where(F.col("value").isNotNull())
        if target == "string":
            long = _shortened(long)
        else:
            long = long.withColumn("digest", F.lit(None).cast("string"))
        frames.append(
            long.groupBy("column", "value", "digest")
            .agg(F.count("*").alias("count"))
            .select("column", F.col("value").cast("string").alias("value"), "digest", "count")
        )
    return union_all(frames)


def _shortened(long: DataFrame) -> DataFrame:
    """Long texts as head and digest. Heads sort as their texts do unless they are equal."""
    is_long = F.octet_length("value") > LONG_TEXT_BYTES
    return long.select(
        "column",
        F.when(is_long, F.substring("value", 1, LONG_TEXT_BYTES)).otherwise(F.col("value")).alias("value"),
        F.when(is_long, F.sha2("value", 256)).alias("digest"),
    )


def _long_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, text, head)`` of the long values of text columns."""
    return (
        df.select(*[text(c).alias(c) for c in columns])
        .unpivot([], [col(c) for c in columns], "column", "text")
        .where(F.octet_length("text") > LONG_TEXT_BYTES)
        .withColumn("head", F.substring("text", 1, LONG_TEXT_BYTES))
    )


def with_full_text(df: DataFrame, selected: DataFrame) -> DataFrame:
    """Replace heads by whole texts in a (usually small) selection of ``value_counts``.

    The selection is saved; where it names no long text the data is not read again.
    Otherwise only texts with a selected digest leave their task, one copy each.
    """
    saved = materialise(selected, "selected")
    wanted = saved.where(F.col("digest").isNotNull()).select("column", "digest").distinct()
    size = wanted.count()
    if not size:
        return saved.drop("digest")
    columns = [r["column"] for r in wanted.select("column").distinct().collect()]
    texts = (
        _long_texts(df, columns)
        .withColumn("digest", F.sha2("text", 256))
        .join(wanted, ["column", "digest"], "left_semi")
        .dropDuplicates(["column", "digest"])
        .select("column", "digest", "text")
    )
    return saved.join(texts, ["column", "digest"], "left").select(
        "column",
        F.coalesce("text", "value").alias("value"),
        *[c for c in saved.columns if c not in ("column", "value", "digest")],
    )


def _family(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
        return t.simpleString()
    return "string"


def column_modes(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Per column: values, distinct values, smallest of the most frequent, its count.

    One row per column, decided at once. Where the leading values are long texts, the
    digests with the top count are known, and the smallest of their texts is a minimum
    that combines on the map side; a column of which every value occurs once needs no digests.
    """
    found = (
        counts.groupBy("column")
        .agg(
            F.sum("count").alias("non_null"),
            F.count("*").alias("cardinality"),
            F.max("count").alias("mode_frequency"),
            F.min(F.struct(-F.col("count"), F.col("value"), F.col("digest"))).alias("best"),
        )
        .collect()
    )
    modes = {r["column"]: r["best"]["value"] for r in found}
    unsure = [r for r in found if r["best"]["digest"] is not None]
    single = [r["column"] for r in unsure if r["mode_frequency"] == 1]
    if single:
        least = df.agg(*[F.min(text(c)).alias(f"m{i}") for i, c in enumerate(single)]).first()
        modes.update({c: least[f"m{i}"] for i, c in enumerate(single)})
    several = [(r["column"], r["best"]["value"], r["mode_frequency"]) for r in unsure if r["mode_frequency"] > 1]
    if several:
        lead = df.sparkSession.createDataFrame(several, "column string, value string, count bigint")
        # The smallest text has the smallest head, so only digests with that head count.
        wanted = counts.join(F.broadcast(lead), ["column", "value", "count"]).select("column", "digest")
        whole = (
            _long_texts(df, [c for c, _, _ in several])
            .join(F.broadcast(lead.select("column", F.col("value").alias("head"))), ["column", "head"])
            .withColumn("digest", F.sha2("text", 256))
            .join(wanted, ["column", "digest"], "left_semi")
            .groupBy("column")
            .agg(F.min("text").alias("mode"))
        )
        modes.update({r["column"]: r["mode"] for r in whole.collect()})
    rows = [
        (r["column"], r["non_null"], r["cardinality"], modes[r["column"]], r["mode_frequency"]) for r in found
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, non_null bigint, cardinality bigint, mode string, mode_frequency bigint"
    )


def top_ranked(df: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """``(column, rank, value, count)``: the ``n`` most frequent values, ties by the first
    bytes of the value and, for long texts with one head, by digest.

    That order is total, so exactly ``n`` rows pass for each column, and only their texts
    are looked up. The rank filter becomes a limit inside each task before the exchange, so
    a column with billions of distinct values sends only the leading rows of each task.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"), F.asc("digest"))
    leading = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return with_full_text(df, leading).select("column", "rank", "value", "count")


def distinct_estimates(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Sketched distinct counts: one scan, nothing of data size is shuffled."""
    out: dict[str, int] = {}
    for start in range(0, len(columns), AGGREGATES_PER_SCAN):
        part = columns[start : start + AGGREGATES_PER_SCAN]
        row = df.agg(
            *[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(part)]
        ).first()
        out.update({c: row[f"d{i}"] for i, c in enumerate(part)})
    return out


def small_domains(
    df: DataFrame, columns: Sequence[str], max_distinct: int
) -> dict[str, dict[str, int]]:
    """Columns with at most ``max_distinct`` values, each with its exact value counts.

    The sketch first rules out columns that are far above the gate, so key-like columns
    are never shuffled; what is counted exactly and brought back is bounded by the gate.
    """
    if not columns:
        return {}
    near = [
        c
        for c, n in distinct_estimates(df, columns).items()
        if n <= max_distinct * GATE_MARGIN + 8
    ]
    if not near:
        return {}
    found: dict[str, dict[str, int]] = {c: {} for c in near}
    # Few values per column: whole texts may be grouped, they combine on the map side.
    long = df.select(*[text(c).alias(c) for c in near]).unpivot([], [col(c) for c in near], "column", "value")
    counted = long.where(F.col("value").isNotNull()).groupBy("column", "value")
    for r in counted.agg(F.count("*").alias("count")).collect():
        found[r["column"]][r["value"]] = r["count"]
    return {
        c: dict(sorted(found[c].items())) for c in columns if c in found and len(found[c]) <= max_distinct
    }


def gate(
    df: DataFrame, columns: Sequence[str], max_distinct: int, domains: dict[str, dict[str, int]] | None = None
) -> dict[str, dict[str, int]]:
    """``small_domains``, from those of a gate at least as wide if they are known."""
    if domains is None:
        return small_domains(df, columns, max_distinct)
    return {c: domains[c] for c in columns if c in domains and len(domains[c]) <= max_distinct}
