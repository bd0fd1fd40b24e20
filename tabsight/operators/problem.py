"""Which modelling problem a table poses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import classify_columns, col, missing_as_null, per_column
from ..functions.counts import value_counts
from ..functions.order import steps_taken

MAX_CLASSES = 20
MAX_CLASS_RATIO = 0.2
MIN_ROWS = 30
ID_RATIO = 0.95
MONOTONIC_RATIO = 0.8
# A distinct-count sketch (5 % standard error) this far under a ratio settles it.
SKETCH_MARGIN = 0.7
# Name parts of identifiers, of columns never guessed as target, and of
# forecast targets in order of preference.
ID_WORDS = ["id", "uuid", "guid", "key", "code", "token"]
NOT_TARGET_WORDS = ["_id", "id_", "index", "unnamed"]
TARGET_WORDS = ["sales", "revenue", "value", "price", "amount", "total", "count"]


@dataclass
class Problem:
    problem_type: str
    target: str | None
    features: list[str] = field(default_factory=list)
    time_column: str | None = None

    def table(self, df: DataFrame) -> DataFrame:
        row = (self.problem_type, self.target, self.time_column, ",".join(self.features))
        return df.sparkSession.createDataFrame(
            [row], "problem_type string, target string, time_column string, features string"
        )


@dataclass
class ColumnFacts:
    """What the rules ask of a column. ``distinct`` and ``least`` (the smallest class) are
    exact where a rule needs them, else the sketch and nothing."""

    kind: str | None
    non_null: int
    distinct: int
    least: int | None
    whole: bool
    identifier: bool

    @property
    def labels(self) -> bool:
        """Whether the values are class labels."""
        few = self.whole and self.distinct <= MAX_CLASSES and self.distinct <= MAX_CLASS_RATIO * self.non_null
        return self.kind == "categorical" or few


def name_is_identifier(column: str) -> bool:
    return any(w in column.lower() for w in ID_WORDS)


def monotonic(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> dict[str, bool]:
    """Whether the non-null values of each column never fall, or never rise, in the given row
    order; one sort for all columns."""
    return {c: not (falls and rises) for c, (falls, rises) in steps_taken(missing_as_null(df), order_by, columns).items()}


def column_facts(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str] | None = None,
    classes: bool = False,
) -> dict[str, ColumnFacts]:
    """Facts of all columns: sketches from a few scans, then one exact count of the values
    of those columns that a sketch leaves open, together.

    A column is identifier-like if it is named like a key, is nearly unique, or is numeric,
    mostly unique and monotonic in the row order (which needs ``order_by``). With
    ``classes`` label-like columns are counted exactly too.
    """
    found = classify_columns(df)
    numeric = set(found.numeric)
    clean = missing_as_null(df)

    def stats(c: str):
        number = col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        return {
            "n": F.count(col(c)),
            "estimate": F.approx_count_distinct(col(c)),
            "whole": F.coalesce(F.bool_and(F.round(number) == number), F.lit(False)),
        }

    scanned = {r["column"]: r for r in per_column(clean, list(columns), stats).collect()}

    def floor(c: str) -> float:
        return MONOTONIC_RATIO if c in numeric and order_by else ID_RATIO

    def undecided(c: str) -> bool:
        n, estimate = scanned[c]["n"], scanned[c]["estimate"]
        unique = not name_is_identifier(c) and estimate >= floor(c) * SKETCH_MARGIN * n
        return n > 0 and (unique or classes and (c not in numeric or estimate <= 2 * MAX_CLASSES))

    exact = {}
    if wanted := [c for c in columns if undecided(c)]:
        counts = value_counts(clean.select(*[col(c) for c in wanted]), wanted)
        summed = counts.groupBy("column").agg(F.count("*").alias("d"), F.min("count").alias("least"))
        exact = {r["column"]: (r["d"], r["least"]) for r in summed.collect()}

    def mostly_unique(c: str, ratio: float) -> bool:
        # A sketch that settles the question stands below every floor.
        return scanned[c]["n"] > 0 and exact.get(c, (0, None))[0] >= ratio * scanned[c]["n"]

    keys = {c for c in columns if name_is_identifier(c) or mostly_unique(c, ID_RATIO)}
    # Only what uniqueness leaves open is asked for its order.
    steady = monotonic(df, [c for c in columns if c not in keys and mostly_unique(c, floor(c))], order_by or [])

    facts = {}
    for c in columns:
        r = scanned[c]
        distinct, least = exact.get(c, (r["estimate"], None))
        facts[c] = ColumnFacts(found.of(c), r["n"], distinct, least, r["whole"], c in keys or steady.get(c, False))
    return facts


def identifier_like(df: DataFrame, column: str, order_by: Sequence[str] | None = None) -> bool:
    return column_facts(df, [column], order_by)[column].identifier


def identifier_table(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """``(column, identifier_like)`` for every analysed column."""
    classes = classify_columns(df)
    facts = column_facts(df, [c for c in df.columns if classes.of(c)], order_by)
    rows = [(c, f.identifier) for c, f in facts.items()]
    return df.sparkSession.createDataFrame(rows, "column string, identifier_like boolean")


def integer_like(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, integer_like)``: whether all present values are whole numbers."""
    columns = list(classify_columns(df).numeric if columns is None else columns)
    values = missing_as_null(df.select(*[col(c) for c in columns]))
    out = per_column(
        values,
        columns,
        lambda c: {"whole": F.bool_and(F.round(col(c).cast("double")) == col(c).cast("double"))},
    )
    return out.select("column", F.coalesce("whole", F.lit(False)).alias("integer_like"))


def forecast_target(numeric: Sequence[str]) -> str | None:
    """The column whose name has the most telling word; the last one if none has any."""
    told = [(rank, place) for place, c in enumerate(numeric) for rank, w in enumerate(TARGET_WORDS) if w in c.lower()]
    place = min(told)[1] if told else len(numeric) - 1
    return numeric[place] if numeric else None


def guess_target(df: DataFrame, order_by: Sequence[str] | None = None) -> str | None:
    """Last column that does not look like a key or index."""
    classes = classify_columns(df)
    usable = {*classes.numeric, *classes.categorical}
    named = [c for c in df.columns if c in usable and not any(w in c.lower() for w in NOT_TARGET_WORDS)]
    facts = column_facts(df, [c for c in named if not name_is_identifier(c)], order_by) if named else {}
    return next((c for c in reversed(list(facts)) if not facts[c].identifier), None)


# What a target makes of a table: the first rule that holds decides.
TARGET_RULES = (
    ("empty", lambda f: f.non_null == 0),
    ("clustering", lambda f: f.identifier),
    ("classification", lambda f: f.labels and f.least >= 2),
    ("clustering", lambda f: f.labels),
    ("regression", lambda f: f.kind == "numeric"),
    ("clustering", lambda f: True),
)


def classify_target(df: DataFrame, target: str, order_by: Sequence[str] | None = None) -> Problem:
    """Regression, classification or (when the target will not do) clustering.

    A target that will not do joins the features, unless it is empty.
    """
    classes = classify_columns(df)
    facts = column_facts(df, [target], order_by, classes=True)[target]
    verdict = next(kind for kind, holds in TARGET_RULES if holds(facts))
    predicted = verdict in ("classification", "regression")
    others = [c for c in (*classes.numeric, *classes.categorical) if c != target]
    return Problem(
        "clustering" if verdict == "empty" else verdict,
        target if predicted else None,
        others if predicted or verdict == "empty" else [*others, target],
        next(iter(classes.datetime), None),
    )


def clustering(df: DataFrame, target: str | None = None) -> Problem:
    """The clustering of all columns; a target comes last among the features."""
    classes = classify_columns(df)
    columns = [*classes.numeric, *classes.categorical]
    last = [target] if target in columns else []
    return Problem("clustering", None, [c for c in columns if c not in last] + last, next(iter(classes.datetime), None))


def detect_problem(
    df: DataFrame,
    target_hint: str | None = None,
    order_by: Sequence[str] | None = None,
    row_count: int | None = None,
) -> Problem:
    """The problem type, target and features of a table.

    Enough rows and a hint, or a date next to a number, or a guessed target, in this
    order, make a supervised problem; otherwise rows are clustered.
    """
    classes = classify_columns(df)
    columns = [*classes.numeric, *classes.categorical]
    enough = (df.limit(MIN_ROWS).count() if row_count is None else row_count) >= MIN_ROWS
    hinted = target_hint if target_hint in df.columns else None
    if enough and hinted is None and classes.datetime and classes.numeric:
        target = forecast_target(classes.numeric)
        return Problem("time_series", target, [c for c in columns if c != target], classes.datetime[0])
    target = (hinted or guess_target(df, order_by)) if enough else None
    return classify_target(df, target, order_by) if target else Problem("clustering", None, columns)
