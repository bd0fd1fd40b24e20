"""Trend and seasonality of numeric columns along a time axis."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import classify_columns, col, missing_as_null, rounded
from ..functions.order import ascending, counts_before, with_halo
from ..session import materialise, ship_functions_of

ship_functions_of(__name__)

MAX_LAG = 60
PEAK = 0.2
TOP_PEAKS = 5
FLAT_SLOPE = 1e-10
MIN_TREND = 3
MIN_SERIES = 5
INSUFFICIENT = "insufficient_data"


def positioned_series(
    df: DataFrame, order_by: Sequence[str], numbers: Sequence[str], by_values: bool = False
) -> DataFrame:
    """``(column, pos, value)``: each number's non-null values in time order, 0-based.

    ``order_by`` starts with the time column and ends with a unique tiebreaker; with
    ``by_values`` rows that tie there go by the numbers themselves, in the order given, so
    the series do not depend on how the rows are stored. All columns share one sort of
    whole rows; each task counts the values before a row as it writes them, and a row a task
    gives what earlier tasks hold, so positions, which differ by column as gaps do, need no
    second sort.
    """
    numbers = list(numbers)
    if not numbers:
        return df.sparkSession.createDataFrame([], "column string, pos bigint, value double")
    keys, values = [f"_o{i}" for i in range(len(order_by))], [f"_v{i}" for i in range(len(numbers))]
    wide = missing_as_null(
        df.select(
            *[col(c).alias(k) for k, c in zip(keys, order_by)],
            *[col(c).cast("double").alias(v) for v, c in zip(values, numbers)],
        )
    )
    placed = materialise(counts_before(wide.orderBy(*ascending(keys + values if by_values else keys)), values), "sorted")
    tasks = placed.groupBy("_task").agg(*[F.count(v).alias(v) for v in values])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("_task", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_b{i}") for i, v in enumerate(values)])
    cells = [
        F.struct(F.lit(n).alias("column"), (F.col(f"_b{i}") + F.col(f"_p{i}")).alias("pos"), F.col(values[i]).alias("value"))
        for i, n in enumerate(numbers)
    ]
    return placed.join(F.broadcast(offsets), "_task").select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def detect_trend(series: DataFrame, ndigits: int | None = 4, slope_digits: int | None = 6) -> DataFrame:
    """Least-squares line of each series over its positions."""
    y, x = F.col("value"), F.col("pos").cast("double")
    fit = series.groupBy("column").agg(
        F.count("*").alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        (F.min("value") == F.max("value")).alias("constant"),
        F.min("value").alias("level"),
    )
    enough = F.col("n") >= MIN_TREND
    slope = F.when(F.col("constant"), F.lit(0.0)).otherwise(F.col("slope"))
    direction = (
        F.when(~enough, INSUFFICIENT)
        .when(F.abs(slope) < FLAT_SLOPE, "flat")
        .when(slope > 0, "upward")
        .otherwise("downward")
    )
    return fit.select(
        "column",
        "n",
        direction.alias("trend"),
        F.when(enough, rounded(slope, slope_digits)).alias("slope"),
        F.when(
            enough, rounded(F.when(F.col("constant"), F.lit(0.0)).otherwise(F.col("r2")), ndigits)
        ).alias("r_squared"),
        F.when(
            enough,
            rounded(F.when(F.col("constant"), F.col("level")).otherwise(F.col("intercept")), ndigits),
        ).alias("intercept"),
    )


def autocorrelation(
    series: DataFrame, max_lag: int = MAX_LAG, block_rows: int | None = None
) -> DataFrame:
    """``(column, lag, r)``: correlation of each series with itself ``lag`` rows earlier.

    Only the products of neighbours need the order: they are summed inside blocks that
    borrow the ``max_lag`` rows before them. Sums over the two overlapping parts are the
    totals less the first or last ``lag`` values, which at most 2 x max_lag rows give.
    """
    stats = series.groupBy("column").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        (F.min("value") == F.max("value")).alias("constant"),
    )
    centred = series.join(F.broadcast(stats), "column").select(
        "column", "pos", "n", (F.col("value") - F.col("mean")).alias("c")
    )
    blocks = with_halo(centred, max_lag, block_rows=block_rows).select("column", "_block", "pos", "c", "_halo")
    names = ["column", "s", "ss", *[f"p{k}" for k in range(1, max_lag + 1)]]

    def products(block: pa.Table) -> pa.Table:
        """The sums of a block's own values, their squares and their products with those of each lag before."""
        block = block.sort_by("pos")
        c, own = block["c"].to_numpy(), int(block["_halo"].to_numpy().sum())
        pairs = ((c[max(own, k) :], c[max(own, k) - k : len(c) - k]) for k in range(1, max_lag + 1))
        sums = [c[own:].sum(), c[own:] @ c[own:], *[float(x @ y) if len(x) else 0.0 for x, y in pairs]]
        return pa.table([[block["column"][0].as_py()], *[[v] for v in sums]], names)

    kinds = "column string, " + ", ".join(f"{n} double" for n in names[1:])
    # One row a block.
    sums = (
        blocks.groupBy("column", "_block")
        .applyInArrow(products, kinds)
        .groupBy("column")
        .agg(*[F.sum(n).alias(n) for n in names[1:]])
        .select(
            "column",
            "s",
            "ss",
            F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"p{k}").alias("sxy")) for k in range(1, max_lag + 1)])),
        )
    )
    edges = centred.where((F.col("pos") < max_lag) | (F.col("pos") >= F.col("n") - max_lag)).select(
        "column", "c", "pos", "n", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag")
    )
    head, tail = F.col("pos") < F.col("lag"), F.col("pos") >= F.col("n") - F.col("lag")
    cut = edges.groupBy("column", "lag").agg(
        F.sum(F.when(head, F.col("c"))).alias("h"),
        F.sum(F.when(head, F.col("c") * F.col("c"))).alias("hh"),
        F.sum(F.when(tail, F.col("c"))).alias("t"),
        F.sum(F.when(tail, F.col("c") * F.col("c"))).alias("tt"),
    )
    m = (F.col("n") - F.col("lag")).cast("double")
    sx, sy = F.col("s") - F.col("h"), F.col("s") - F.col("t")
    vx = F.greatest(F.col("ss") - F.col("hh") - sx * sx / m, F.lit(0.0))
    vy = F.greatest(F.col("ss") - F.col("tt") - sy * sy / m, F.lit(0.0))
    limit = F.when(F.col("n") < max_lag, F.floor(F.col("n") / 2)).otherwise(F.lit(max_lag))
    return (
        sums.join(F.broadcast(cut), ["column", "lag"])
        .join(F.broadcast(stats), "column")
        .where((F.col("lag") <= limit) & (limit >= 2) & (F.col("n") > F.col("lag")))
        .select(
            "column",
            "lag",
            F.when(
                ~F.col("constant"), F.try_divide(F.col("sxy") - sx * sy / m, F.sqrt(vx * vy))
            ).alias("r"),
        )
    )


def seasonal_peaks(acf: DataFrame, ndigits: int | None = 4) -> DataFrame:
    """Interior strict maxima of the autocorrelation above 0.2, strongest first."""
    order = Window.partitionBy("column").orderBy("lag")
    r = F.col("r")
    peaks = (
        acf.withColumn("_left", F.lag("r").over(order))
        .withColumn("_right", F.lead("r").over(order))
        .where((r > F.col("_left")) & (r > F.col("_right")) & (r > PEAK))
        .select("column", "lag", rounded(r, ndigits).alias("acf"))
    )
    strength = Window.partitionBy("column").orderBy(F.desc("acf"), "lag")
    return (
        peaks.withColumn("rank", F.row_number().over(strength))
        .where(F.col("rank") <= TOP_PEAKS)
        .select("column", "rank", "lag", "acf")
    )


def detect_seasonality(
    series: DataFrame, max_lag: int = MAX_LAG, ndigits: int | None = 4
) -> DataFrame:
    """Per series: whether autocorrelation peaks exist, and the dominant lag."""
    peaks = seasonal_peaks(autocorrelation(series, max_lag), ndigits).where("rank = 1")
    sizes = series.groupBy("column").agg(F.count("*").alias("n"))
    limit = F.when(F.col("n") < max_lag, F.floor(F.col("n") / 2)).otherwise(F.lit(max_lag))
    return sizes.join(F.broadcast(peaks), "column", "left").select(
        "column",
        F.when(limit < 2, INSUFFICIENT)
        .when(F.col("lag").isNotNull(), "detected")
        .otherwise("not_detected")
        .alias("seasonality"),
        F.col("lag").alias("dominant_period_lag"),
        F.col("acf").alias("acf_at_dominant"),
    )


def time_series_analysis(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    numbers: Sequence[str] | None = None,
    ndigits: int | None = 4,
) -> DataFrame:
    """Trend and seasonality of every numeric column along the first datetime column.

    Without ``order_by`` rows of equal times go by the numbers, so the answer is the same
    however the rows are stored.
    """
    classes = classify_columns(df)
    numbers = list(classes.numeric if numbers is None else numbers)
    if order_by is None and not classes.datetime:
        raise ValueError("no datetime column")
    series = positioned_series(df, order_by or [classes.datetime[0]], numbers, by_values=not order_by)
    names = df.sparkSession.createDataFrame(list(enumerate(numbers)), "position int, column string")
    trend, season = detect_trend(series, ndigits), detect_seasonality(series, ndigits=ndigits)
    enough = F.coalesce(F.col("n"), F.lit(0)) >= MIN_SERIES

    def shown(name: str):
        return F.when(enough, F.col(name)).alias(name)

    return (
        names.join(trend, "column", "left")
        .join(season, "column", "left")
        .select(
            "position",
            "column",
            F.when(enough, F.lit("ok")).otherwise(INSUFFICIENT).alias("status"),
            *[shown(c) for c in ("trend", "slope", "r_squared", "intercept")],
            *[shown(c) for c in ("seasonality", "dominant_period_lag", "acf_at_dominant")],
        )
    )
