"""Preparing a table for model fitting, one DataFrame step at a time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import classify_columns, col, missing_as_null, per_column
from ..functions.counts import LONG_TEXT_BYTES, column_modes, distinct_estimates, small_domains, text, value_counts
from ..functions.order import dense_position, neighbours, with_halo
from ..functions.quantiles import column_quantiles
from ..session import materialise
from .problem import Problem

ONE_HOT_MAX = 15
LAGS = (1, 3, 7)
WINDOWS = (3, 7)
NO_MODE = "MISSING"
ROW = "pos"
TIE = "row digest"


def time_ordered(df: DataFrame, order_by: Sequence[str], name: str = ROW) -> DataFrame:
    """Number rows by time (missing times last); ``order_by`` ends in a unique column."""
    return dense_position(df, order_by, name=name)


def numbered_rows(df: DataFrame, name: str = ROW) -> DataFrame:
    """Give rows of a table without an order a number that stays the same from here on."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def calendar_features(df: DataFrame, time_column: str) -> DataFrame:
    """Month, day of week (Monday 0), day of month and quarter, as doubles."""
    t = col(time_column)
    return df.withColumns(
        {
            "month": F.month(t).cast("double"),
            "day_of_week": F.weekday(t).cast("double"),
            "day_of_month": F.dayofmonth(t).cast("double"),
            "quarter": F.quarter(t).cast("double"),
        }
    )


def _looking_back(df: DataFrame, width: int, made: dict[str, Column], pos: str, block_rows) -> DataFrame:
    blocks = with_halo(df, width, pos, block_rows).withColumns(made)
    return blocks.where(~F.col("_halo")).drop("_halo", "_block")


def lag_features(
    df: DataFrame, target: str, lags: Sequence[int] = LAGS, pos: str = ROW, block_rows: int | None = None
) -> DataFrame:
    """Values of ``target`` some rows earlier, as ``<target>_lag<k>``."""
    order = neighbours(pos=pos)
    made = {f"{target}_lag{k}": F.lag(col(target), k).over(order).cast("double") for k in lags}
    return _looking_back(df, max(lags), made, pos, block_rows)


def _rolling(target: str, window: int, order: Window, exclude_current: bool) -> Column:
    last = -1 if exclude_current else 0
    return F.avg(col(target)).over(order.rowsBetween(last - window + 1, last))


def rolling_mean(
    df: DataFrame,
    target: str,
    windows: Sequence[int] = WINDOWS,
    pos: str = ROW,
    exclude_current: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Trailing means of ``target`` as ``<target>_roll<w>``, missing values passed over.

    The current row takes part unless ``exclude_current``: with it the feature contains
    the value to be predicted.
    """
    order = neighbours(pos=pos)
    made = {f"{target}_roll{w}": _rolling(target, w, order, exclude_current) for w in windows}
    return _looking_back(df, max(windows), made, pos, block_rows)


def history_features(
    df: DataFrame, target: str, pos: str = ROW, exclude_current: bool = False
) -> tuple[DataFrame, list[str]]:
    """Lags and rolling means in one pass over the blocks."""
    order = neighbours(pos=pos)
    made = {f"{target}_lag{k}": F.lag(col(target), k).over(order).cast("double") for k in LAGS}
    made |= {f"{target}_roll{w}": _rolling(target, w, order, exclude_current) for w in WINDOWS}
    return _looking_back(df, max(*LAGS, *WINDOWS), made, pos, None), list(made)


def _with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    rows = per_column(df, columns, lambda c: {"missing": F.count_if(col(c).isNull())}).collect()
    return [r["column"] for r in rows if r["missing"]]


def fill_median(
    df: DataFrame, columns: Sequence[str] | None = None, log: list | None = None
) -> DataFrame:
    """Missing numbers become the exact median of their column."""
    df = missing_as_null(df)
    columns = list(classify_columns(df).numeric if columns is None else columns)
    gaps = _with_gaps(df, columns)
    medians = {c: q[0] for c, (_, q) in column_quantiles(df, gaps, [0.5]).items()}
    medians = {c: m for c, m in medians.items() if m is not None}
    for c, m in medians.items():
        _note(log, "fill_median", c, m)
    return df.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(m)) for c, m in medians.items()})


def fill_mode(
    df: DataFrame, columns: Sequence[str] | None = None, log: list | None = None
) -> DataFrame:
    """Missing categories become the smallest of the most frequent values."""
    columns = list(classify_columns(df).categorical if columns is None else columns)
    gaps = _with_gaps(df, columns)
    if not gaps:
        return df
    modes = {r["column"]: r["mode"] for r in column_modes(df, value_counts(df, gaps)).collect()}
    for c in gaps:
        _note(log, "fill_mode", c, modes.get(c, NO_MODE))
    return df.withColumns({c: F.coalesce(text(c), F.lit(modes.get(c, NO_MODE))) for c in gaps})


def one_hot(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_distinct: int = ONE_HOT_MAX,
    log: list | None = None,
) -> tuple[DataFrame, list[str]]:
    """0/1 columns per value but the first of each low-cardinality column.

    A name that another column has already gets the next free number as suffix.
    """
    columns = list(classify_columns(df).categorical if columns is None else columns)
    made, kept, taken = {}, {}, set(df.columns)
    for c, values in small_domains(df, columns, max_distinct).items():
        kept[c] = []
        for v in list(values)[1:]:
            name, k = f"{c}_{v}", 1
            while name in taken:
                k += 1
                name = f"{c}_{v}_{k}"
            if k > 1:
                _note(log, "one_hot_renamed", c, name)
            taken.add(name)
            kept[c].append(name)
            made[name] = F.when(text(c) == F.lit(v), 1.0).otherwise(0.0)
        _note(log, "one_hot", c, len(kept[c]))
    return df.withColumns(made).drop(*[f"`{c}`" if "." in c else c for c in kept]), list(made)


def _code_key(column: str) -> Column:
    """Short values as they are, long ones by digest, so codes never carry whole texts."""
    value = text(column)
    long = F.octet_length(value) > LONG_TEXT_BYTES
    return F.when(long, F.concat(F.lit("#"), F.sha2(value, 256))).otherwise(F.concat(F.lit("="), value))


def first_seen_codes(df: DataFrame, column: str, pos: str = ROW) -> DataFrame:
    """``(_key, first_seen, code)``: distinct values numbered by their first position."""
    firsts = (
        df.select(_code_key(column).alias("_key"), col(pos).alias("_p"))
        .where("_key IS NOT NULL")
        .groupBy("_key")
        .agg(F.min("_p").alias("first_seen"))
    )
    return dense_position(firsts, ["first_seen"], name="code")


def factorize(df: DataFrame, column: str, pos: str = ROW, codes: DataFrame | None = None) -> DataFrame:
    """Replace a high-cardinality category by its order of first appearance."""
    codes = first_seen_codes(df, column, pos) if codes is None else codes
    joined = df.withColumn("_key", _code_key(column)).join(codes.select("_key", "code"), "_key", "left")
    coded = F.coalesce(F.col("code"), F.lit(-1)).cast("double")
    return joined.select(*[coded.alias(c) if c == column else col(c) for c in df.columns])


def encode_target(df: DataFrame, target: str, pos: str = ROW) -> tuple[DataFrame, DataFrame]:
    """Class labels as numbers in order of first appearance, with the mapping."""
    codes = first_seen_codes(df, target, pos)
    named = df.select(col(pos).alias("first_seen"), text(target).alias("value"))
    return factorize(df, target, pos, codes), named.join(codes, "first_seen").select("value", "code")


def standard_scale(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    fit_on: DataFrame | None = None,
    log: list | None = None,
) -> DataFrame:
    """Centre and scale by the sample deviation; columns that do not vary stay as is.

    The statistics come from all rows, or from ``fit_on`` (say, the training rows).
    """
    columns = list(classify_columns(df).numeric if columns is None else columns)
    if not columns:
        return df
    source = missing_as_null((df if fit_on is None else fit_on).select(*[col(c).cast("double").alias(c) for c in columns]))
    rows = per_column(
        source, columns, lambda c: {"mean": F.avg(col(c)), "std": F.stddev_samp(col(c))}
    ).collect()
    made = {}
    for r in rows:
        if r["std"] and r["std"] > 0:
            c = r["column"]
            made[c] = (col(c).cast("double") - F.lit(r["mean"])) / F.lit(r["std"])
            _note(log, "standard_scale", c, r["std"])
    return df.withColumns(made)


def model_matrix(
    df: DataFrame, features: Sequence[str], target: str | None, pos: str | None = None
) -> DataFrame:
    """Numeric features, target and row number; rows with a missing cell are dropped."""
    numeric = set(classify_columns(df).numeric)
    kept = [c for c in features if c in numeric]
    extra = [col(target).cast("double").alias(target)] if target else []
    row = [col(pos)] if pos else []
    used = kept + ([target] if target else [])
    matrix = missing_as_null(
        df.select(*row, *[col(c).cast("double").alias(c) for c in kept], *extra)
    )
    return matrix.dropna(how="any", subset=[f"`{c}`" if "." in c else c for c in used])


def _note(log: list | None, action: str, column: str, value) -> None:
    if log is not None:
        log.append((len(log), action, column, str(value)))


@dataclass
class Features:
    """The prepared table (saved), its feature names and what was done."""

    matrix: DataFrame
    names: list[str]
    target: str | None
    transformations: DataFrame
    target_mapping: DataFrame | None = None
    log: list = field(default_factory=list)


def engineer_features(
    df: DataFrame,
    problem: Problem,
    order_by: Sequence[str] | None = None,
    exclude_current: bool = False,
    fill_target: bool = True,
    scale: bool = True,
) -> Features:
    """All preparation steps in order; ``matrix`` holds features, target and ``pos``.

    Rows are numbered by ``order_by`` (time first, unique last), by the time column and, where
    times are equal, a digest of the whole row, or, for a table without order, arbitrarily
    but once and for all.
    """
    log: list = []
    classes = classify_columns(df)
    target, time_column = problem.target, problem.time_column
    order = list(order_by or ([time_column] if time_column else []))
    work = missing_as_null(df)
    if order:
        hashed = [col(f.name) for f in work.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        tied = work if order_by else work.withColumn(TIE, F.xxhash64(*hashed))
        work = time_ordered(tied, order if order_by else [*order, TIE])
        _note(log, "sort_by_time", order[0], "")
    else:
        work = numbered_rows(work)
    features = [c for c in problem.features if c in df.columns]
    numeric = [c for c in features if c in classes.numeric]
    categorical = [c for c in features if c in classes.categorical]
    if problem.problem_type == "time_series" and time_column:
        work = calendar_features(work, time_column)
        made = ["month", "day_of_week", "day_of_month", "quarter"]
        if target:
            work, history = history_features(work, target, exclude_current=exclude_current)
            made += history
        numeric += made
        _note(log, "time_features", time_column, ",".join(made))
    keep = [ROW, *numeric, *categorical, *([target] if target else [])]
    # Later steps decide on values they see, so the look-back columns are saved once.
    work = materialise(work.select(*[col(c) for c in dict.fromkeys(keep)]), "features")
    fill_numeric = numeric + ([target] if target in classes.numeric and fill_target else [])
    fill_text = categorical + ([target] if target in classes.categorical and fill_target else [])
    work = fill_median(work, fill_numeric, log)
    work = fill_mode(work, fill_text, log)
    names = list(numeric)
    low = [c for c, n in distinct_estimates(work, categorical).items() if n <= 4 * ONE_HOT_MAX] if categorical else []
    work, dummies = one_hot(work, low, log=log)
    names += dummies
    coded = work  # all codes come from here, so no join is repeated for the next column
    for c in categorical:
        if c in work.columns:
            work = factorize(work, c, codes=first_seen_codes(coded, c))
            names.append(c)
            _note(log, "label_encode", c, "")
    mapping = None
    if target and problem.problem_type == "classification" and target in classes.categorical:
        work, mapping = encode_target(work, target)
        _note(log, "encode_target", target, "")
    if any(c in names for c in categorical) or mapping is not None:
        # Scaling reads all values before the matrix does: the joins with the codes run once.
        work = materialise(work, "coded")
    if scale:
        work = standard_scale(work, names, log=log)
    matrix = materialise(model_matrix(work, names, target, ROW), "matrix")
    table = df.sparkSession.createDataFrame(
        log, "step int, action string, column string, value string"
    )
    return Features(matrix, names, target, table, mapping, log)
