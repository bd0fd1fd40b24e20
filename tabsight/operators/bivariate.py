"""Relationships between pairs of columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    AGGREGATES_PER_SCAN,
    classify_columns,
    col,
    guarded_corr,
    missing_as_null,
    rounded,
    union_all,
)
from ..functions.comoments import correlation, pair_moments
from ..functions.contingency import pair_counts
from ..functions.counts import gate, text
from ..functions.order import dense_position
from ..functions.quantiles import exact_quantiles
from .univariate import numeric_frame

STRONG = 0.7
GROUPED_MAX_DISTINCT = 50
GROUPED_MAX_PAIRS = 20
ASSOCIATION_MAX_DISTINCT = 30
ASSOCIATION_MAX_PAIRS = 15
_PAIR_AGGREGATES = 3


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """``(i, j, a, b, r)`` for every pair i < j, over rows where both are present."""
    columns = list(classify_columns(df).numeric if columns is None else columns)
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "i int, j int, a string, b string, r double")
    if method == "pearson":
        values = numeric_frame(df, columns)
        if len(pairs) > AGGREGATES_PER_SCAN // _PAIR_AGGREGATES:
            names = F.array(*map(F.lit, columns))
            named = [F.element_at(names, F.col(k) + 1).alias(name) for k, name in (("i", "a"), ("j", "b"))]
            return correlation(pair_moments(values, columns)).select("i", "j", *named, "r")
        return _pair_table(
            values, columns, {(i, j): guarded_corr(col(columns[i]), col(columns[j])) for i, j in pairs}
        )
    if method == "spearman":
        return union_all([_spearman(df, columns, i, j) for i, j in pairs])
    raise ValueError(f"unknown correlation method: {method}")


def _pair_table(values: DataFrame, columns, expressions: dict[tuple[int, int], Column]) -> DataFrame:
    """A few pairs by aggregates of one scan."""
    row = values.agg(*[expr.alias(f"r{i}_{j}") for (i, j), expr in expressions.items()])
    structs = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.lit(columns[i]).alias("a"),
            F.lit(columns[j]).alias("b"),
            F.col(f"r{i}_{j}").alias("r"),
        )
        for i, j in expressions
    ]
    return row.select(F.inline(F.array(*structs)))


def _spearman(df: DataFrame, columns: Sequence[str], i: int, j: int) -> DataFrame:
    """Pearson of average ranks among the complete pairs.

    Equal pairs are combined first and ranks are looked up by distinct value, so a value
    that fills a third of the column is one row of the rank table.
    """
    a, b = columns[i], columns[j]
    both = numeric_frame(df, [a, b]).toDF("_x", "_y").where("_x IS NOT NULL AND _y IS NOT NULL")
    cells = both.groupBy("_x", "_y").agg(F.count("*").alias("_c"))

    def ranks(side: str) -> DataFrame:
        per_value = both.groupBy(side).agg(F.count("*").alias("_n"))
        placed = dense_position(per_value, [side], weight="_n")
        middle = F.col("pos_total") - F.col("_n") + (F.col("_n") + 1) / 2.0
        return placed.select(F.col(side), middle.alias(f"r{side}"))

    ranked = cells.join(ranks("_x"), "_x").join(ranks("_y"), "_y")
    # Weighted moments of the distinct pairs equal plain moments of all pairs, and average
    # ranks of n values have the mean (n + 1) / 2 on both sides.
    w = F.col("_c").cast("double")
    mean = F.lit((both.count() + 1) / 2)
    dx, dy = F.col("r_x") - mean, F.col("r_y") - mean
    return ranked.agg(
        F.try_divide(
            F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy))
        ).alias("r")
    ).select(
        F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a).alias("a"), F.lit(b).alias("b"), "r"
    )


def strong_correlations(
    correlations: DataFrame, threshold: float = STRONG, ndigits: int | None = 4
) -> DataFrame:
    """Pairs with \\|r\\| at or above the threshold, strongest first, with their sign."""
    r = F.col("r")
    return (
        correlations.where(r.isNotNull() & (F.abs(r) >= threshold))
        .select(
            "a",
            "b",
            F.when(r > 0, F.lit("positive")).otherwise("negative").alias("direction"),
            rounded(r, ndigits).alias("correlation"),
            "i",
            "j",
        )
        .orderBy(F.desc(F.abs("correlation")), "i", "j")
        .drop("i", "j")
    )


def grouped_values(
    df: DataFrame, categories: Sequence[str], numbers: Sequence[str]
) -> DataFrame:
    """Rows ``(category, group, <numbers>)``: one copy of the numbers per category column."""
    tags = [F.struct(F.lit(c).alias("category"), text(c).alias("group")) for c in categories]
    return missing_as_null(
        df.select(
            F.explode(F.array(*tags)).alias("_tag"),
            *[col(n).cast("double").alias(n) for n in numbers],
        ).select("_tag.category", "_tag.group", *[col(n) for n in numbers])
    ).where(F.col("group").isNotNull())


def group_table(
    df: DataFrame,
    categories: Sequence[str],
    numbers: Sequence[str],
    with_median: bool = True,
) -> DataFrame:
    """``(category, number, group, mean, median, std, count)`` for gated categories.

    Groups are combined on the map side, so a group that holds a third of the rows costs
    no more than any other. The result has at most categories x groups x numbers rows.
    """
    long = grouped_values(df, categories, numbers)
    frames = []
    step = max(1, AGGREGATES_PER_SCAN // 3)
    for start in range(0, len(numbers), step):
        part = list(numbers[start : start + step])
        aggs = []
        for k, n in enumerate(part):
            aggs += [
                F.avg(col(n)).alias(f"m{k}"),
                F.stddev_samp(col(n)).alias(f"s{k}"),
                F.count(col(n)).alias(f"c{k}"),
            ]
        structs = [
            F.struct(
                F.lit(start + k).alias("number_position"),
                F.lit(n).alias("number"),
                F.col(f"m{k}").alias("mean"),
                F.col(f"s{k}").alias("std"),
                F.col(f"c{k}").alias("count"),
            )
            for k, n in enumerate(part)
        ]
        frames.append(
            long.groupBy("category", "group")
            .agg(*aggs)
            .select("category", "group", F.inline(F.array(*structs)))
        )
    out = union_all(frames)
    if not with_median:
        return out
    medians = [
        (c, g, n, row[k][0])
        for (c, g), (_, row) in exact_quantiles(
            long, list(numbers), [0.5], keys=["category", "group"]
        ).items()
        for k, n in enumerate(numbers)
    ]
    small = df.sparkSession.createDataFrame(
        medians, "category string, group string, number string, median double"
    )
    return out.join(F.broadcast(small), ["category", "group", "number"], "left")


def grouped_statistics(
    df: DataFrame,
    categories: Sequence[str] | None = None,
    numbers: Sequence[str] | None = None,
    max_pairs: int = GROUPED_MAX_PAIRS,
    max_distinct: int = GROUPED_MAX_DISTINCT,
    ndigits: int | None = 4,
    groups: DataFrame | None = None,
    domains: dict[str, dict[str, int]] | None = None,
) -> DataFrame:
    """Mean, median, std and count per group for the pairs whose group means vary most.

    Groups with a missing statistic (single values) are left out; a pair left with one
    group has no variance and sorts last. ``groups`` and ``domains`` may pass a ready
    ``group_table`` and a ``small_domains`` of a gate at least as wide.
    """
    classes = classify_columns(df)
    categories = list(classes.categorical if categories is None else categories)
    numbers = list(classes.numeric if numbers is None else numbers)
    gated = list(gate(df, categories, max_distinct, domains))
    schema = (
        "pair_rank int, categorical string, numeric string, mean_variance double, "
        "group string, mean double, median double, std double, count bigint"
    )
    if not gated or not numbers:
        return df.sparkSession.createDataFrame([], schema)
    if groups is None:
        groups = group_table(df, gated, numbers)
    kept = groups.where(F.col("category").isin(gated)).dropna(subset=["mean", "median", "std"])
    order = {c: i for i, c in enumerate(categories)}
    position = F.element_at(
        F.create_map(*[F.lit(v) for c in categories for v in (c, order[c])]), F.col("category")
    )
    pairs = kept.groupBy("category", "number").agg(
        rounded(F.var_samp("mean"), ndigits).alias("mean_variance"),
        F.min(position).alias("_c"),
        F.min("number_position").alias("_n"),
    )
    # A report of the top pairs: at most ``max_pairs`` rows, numbered on one row set.
    best = (
        pairs.orderBy(F.col("mean_variance").desc_nulls_last(), "_c", "_n")
        .limit(max_pairs)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (-F.coalesce("mean_variance", F.lit(-1.0))).alias("o"),
                        "_c",
                        "_n",
                        "category",
                        "number",
                        "mean_variance",
                    )
                )
            ).alias("best")
        )
        .select(F.posexplode("best").alias("pair", "b"))
        .select((F.col("pair") + 1).alias("pair_rank"), "b.category", "b.number", "b.mean_variance")
    )
    return kept.join(F.broadcast(best), ["category", "number"]).select(
        "pair_rank",
        F.col("category").alias("categorical"),
        F.col("number").alias("numeric"),
        "mean_variance",
        "group",
        rounded(F.col("mean"), ndigits).alias("mean"),
        rounded(F.col("median"), ndigits).alias("median"),
        rounded(F.col("std"), ndigits).alias("std"),
        "count",
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts ``(a, b, count)`` of rows where both are present."""
    return (
        df.select(text(a).alias("a"), text(b).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL")
        .groupBy("a", "b")
        .agg(F.count("*").alias("count"))
    )


def association(cells: DataFrame) -> DataFrame:
    """Cramér's V per pair ``p`` from its non-empty cells ``(p, a, b, count)``.

    Chi-square over all cells equals n (sum O^2 / (R C) - 1) over the non-empty ones. A
    2 x 2 table takes the continuity correction: all four |O - E| are equal there, and
    the sum of 1/E is n^3 / (R1 R2 C1 C2).
    """
    rows = cells.groupBy("p", "a").agg(F.sum("count").alias("row_total"))
    cols = cells.groupBy("p", "b").agg(F.sum("count").alias("col_total"))
    total = rows.groupBy("p").agg(
        F.sum("row_total").alias("n"),
        F.count("*").alias("n_rows"),
        F.product(F.col("row_total").cast("double")).alias("row_product"),
    )
    width = cols.groupBy("p").agg(
        F.count("*").alias("n_cols"),
        F.product(F.col("col_total").cast("double")).alias("col_product"),
    )
    o = F.col("count").cast("double")
    parts = (
        cells.join(rows, ["p", "a"])
        .join(cols, ["p", "b"])
        .join(total, "p")
        .groupBy("p")
        .agg(
            F.sum(o * o / (F.col("row_total").cast("double") * F.col("col_total"))).alias("share"),
            F.max(
                F.abs(o - F.col("row_total").cast("double") * F.col("col_total") / F.col("n"))
            ).alias("gap"),
        )
    )
    n = F.col("n").cast("double")
    plain = n * (F.col("share") - 1)
    shrunk = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    yates = shrunk * shrunk * n * n * n / (F.col("row_product") * F.col("col_product"))
    two_by_two = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    chi2 = F.when(two_by_two, yates).otherwise(F.greatest(plain, F.lit(0.0)))
    freedom = F.least("n_rows", "n_cols") - 1
    return (
        total.join(width, "p")
        .join(parts, "p")
        .select(
            "p",
            "n",
            "n_rows",
            "n_cols",
            F.coalesce(
                F.sqrt(F.try_divide(F.when(freedom > 0, chi2), n * freedom)), F.lit(0.0)
            ).alias("v"),
        )
    )


def cramers_v(df: DataFrame, a: str, b: str, ndigits: int | None = 4) -> DataFrame:
    """One row: Cramér's V of two columns and the shape of their table."""
    cells = crosstab(df, a, b).select(F.lit(0).alias("p"), "a", "b", "count")
    return association(cells).select(
        F.lit(a).alias("a"),
        F.lit(b).alias("b"),
        rounded(F.col("v"), ndigits).alias("cramers_v"),
        "n",
        "n_rows",
        "n_cols",
    )


def categorical_associations(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_pairs: int = ASSOCIATION_MAX_PAIRS,
    max_distinct: int = ASSOCIATION_MAX_DISTINCT,
    ndigits: int | None = 4,
    domains: dict[str, dict[str, int]] | None = None,
) -> DataFrame:
    """Cramér's V of every pair of low-cardinality columns, strongest pairs first. One scan
    counts the cells of all pairs."""
    columns = list(classify_columns(df).categorical if columns is None else columns)
    eligible = list(gate(df, columns, max_distinct, domains))
    pairs = list(combinations(eligible, 2))
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame(
            [], "a string, b string, cramers_v double, n_rows bigint, n_cols bigint"
        )
    names = spark.createDataFrame([(p, a, b) for p, (a, b) in enumerate(pairs)], "p int, a string, b string")
    return (
        association(pair_counts(df, pairs))
        .join(F.broadcast(names), "p")
        .withColumn("cramers_v", rounded(F.col("v"), ndigits))
        .orderBy(F.desc("cramers_v"), "p")
        .limit(max_pairs)
        .select("a", "b", "cramers_v", "n_rows", "n_cols")
    )
