"""Splitting tables and fitting the candidate models with ``pyspark.ml``."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boosting, forest
from ..functions.cells import OnBins, cells, cut_points, packed_cells
from ..functions.columns import col, union_all
from ..functions.lloyd import Fit, Rows, assign, fit_all
from ..functions.order import dense_position
from ..functions.quantiles import ranked_values
from ..session import materialise, spread
from .evaluate import silhouette

log = logging.getLogger(__name__)

# Shares, seeds and settings of the candidates.
TEST_SHARE = 0.2
SEED = 42
RIDGE_ALPHA = 1.0
FOREST = dict(numTrees=100, maxDepth=10)
BOOSTING = dict(maxIter=150, maxDepth=5, stepSize=0.1)
LOGISTIC_ITERATIONS = 500
# Cells of a task: a tree of a round is little work, so few cells are not worth many tasks.
CELLS_LEAST = 65_536
MAX_K = 8
KMEANS_STARTS = 10


# --- splits -----------------------------------------------------------------------------


def _hash(key: Sequence[str], seed: int):
    return F.xxhash64(*[col(k) for k in key], F.lit(seed))


def random_split(
    df: DataFrame, key: Sequence[str], test_share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add ``split``: exactly ceil(share x n) test rows, those with the lowest key hash.

    The cut is an exact order statistic of the hash, found by scans alone: no sort, and
    the same rows whatever the partitioning. ``key`` is unique.
    """
    hashed = df.select(_hash(key, seed).alias("h"))
    last = lambda p, n: (max(math.ceil(p * n) - 1, 0),) * 2
    found = ranked_values(hashed, ["h"], [test_share], last)
    (n,), values = found[()]
    test = _hash(key, seed) <= F.lit(values[0][0][0]) if n else F.lit(False)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def chronological_split(df: DataFrame, pos: str = "pos", test_share: float = TEST_SHARE) -> DataFrame:
    """Add ``split``: the first int(n x (1 - share)) rows in position order train.

    Positions may have gaps (dropped rows), so the cut is an exact order statistic.
    """
    first_test = lambda p, n: (min(int(n * p), n - 1),) * 2
    found = ranked_values(df.select(col(pos).cast("bigint").alias("p")), ["p"], [1 - test_share], first_test)
    (n,), values = found[()]
    train = col(pos) < F.lit(values[0][0][0]) if n else F.lit(False)
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def class_shares(df: DataFrame, label: str, test_share: float) -> DataFrame:
    """``(_k, _n, _test)``: per class, its rows and how many of them test.

    Training places go to the classes in proportion by largest remainder (equal ones by
    label). Classes stay in a table of their own, however many there are.
    """
    sizes = df.groupBy(col(label).alias("_k")).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0]
    wanted = total - math.ceil(test_share * total)
    exact = F.col("_n") * wanted / F.lit(total)
    shared = materialise(
        sizes.withColumns({"_floor": F.floor(exact), "_behind": F.floor(exact) - exact, "_text": F.col("_k").cast("string")}),
        "classes",
    )
    left = wanted - shared.agg(F.sum("_floor")).first()[0]
    placed = dense_position(shared, ["_behind", "_text"], name="_place")
    train = F.col("_floor") + (F.col("_place") < left).cast("bigint")
    return placed.select("_k", "_n", (F.col("_n") - train).alias("_test"))


def stratified_split(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    test_share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` keeping class shares: per class, the rows with the lowest hash test.

    Falls back to ``random_split`` with a single class or a class of one row. Only labels
    and hashes are sorted, over the whole table at once, so a class with a third of the
    rows is spread over tasks; its cut is the hash at its last test place.
    """
    bounds = df.groupBy(col(label).alias("k")).agg(F.count("*").alias("n")).agg(F.count("*").alias("classes"), F.min("n").alias("least")).first()
    if bounds["classes"] < 2 or bounds["least"] < 2:
        return random_split(df, key, test_share, seed)
    shares = materialise(class_shares(df, label, test_share), "shares")
    # A null label is a class too; the position restarts for each label, so it gets a name.
    named = F.coalesce(F.concat(F.lit("="), col(label).cast("string")), F.lit("null"))
    hashed = df.select(named.alias("_c"), _hash(key, seed).alias("_h"))
    placed = dense_position(hashed, ["_h"], within=["_c"], name="_place")
    of = shares.select(F.coalesce(F.concat(F.lit("="), F.col("_k").cast("string")), F.lit("null")).alias("_c"), "_test")
    cuts = placed.join(of, "_c").where(F.col("_place") == F.col("_test") - 1).select("_c", F.col("_h").alias("_cut"))
    joined = df.withColumn("_c", named).join(cuts, "_c", "left")
    is_test = F.coalesce(_hash(key, seed) <= F.col("_cut"), F.lit(False))
    return joined.withColumn("split", F.when(is_test, "test").otherwise("train")).select(*[col(c) for c in df.columns], "split")


# --- candidates -------------------------------------------------------------------------


def assemble(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """Rows with a ``features`` vector and, if there is a target, a double ``label``."""
    safe = [f"f{i}" for i in range(len(features))]
    keep = [c for c in ("pos", "split") if c in df.columns]
    rows = df.select(
        *keep,
        *[col(f).cast("double").alias(s) for f, s in zip(features, safe)],
        *([col(target).cast("double").alias("label")] if target else []),
    )
    out = VectorAssembler(inputCols=safe, outputCol="features").transform(rows)
    return out.drop(*safe)


def linear_regression(train: DataFrame):
    """Ordinary least squares."""
    return LinearRegression(regParam=0.0, solver="normal").fit(train)


def ridge_regression(train: DataFrame, alpha: float = RIDGE_ALPHA):
    """Least squares plus alpha times the squared coefficients (intercept free).

    The library minimises the mean error of the label scaled by its deviation; the
    penalty is rescaled accordingly.
    """
    row = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("s")).first()
    penalty = alpha * (row["s"] or 0.0) / max(row["n"], 1)
    return LinearRegression(
        regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal"
    ).fit(train)


def _by_label(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, of about so many, over all cores; those of a task in the order of their labels.

    Trees send rows of like labels to the same nodes, so a task adds up neighbouring histograms one after
    the other; and a row's draws, which go by its place in the task, do not hang on how rows are stored.
    """
    named = "pos" in rows.columns
    return spread(rows, n, "pos" if named else None).sortWithinPartitions("label", *(["pos"] if named else []))


def _dealt(train: DataFrame) -> DataFrame:
    """Training rows over all cores; cached ones are taken to lie so."""
    return train if train.is_cached else _by_label(train, train.count())


_cuts: WeakKeyDictionary[DataFrame, list] = WeakKeyDictionary()


def _cut_points(train: DataFrame) -> list:
    """Those of a cached table are found once for all candidates."""
    if not train.is_cached:
        return cut_points(train)
    if train not in _cuts:
        _cuts[train] = cut_points(train)
    return _cuts[train]


def random_forest_regressor(train: DataFrame, **settings):
    """A forest by squared error on bins (see ``functions.forest``); Spark's own for settings that only it has."""
    options = dict(FOREST, featureSubsetStrategy="all", seed=SEED) | settings
    if set(settings) - {"numTrees", "maxDepth", "seed"}:
        return RandomForestRegressor(**options).fit(_dealt(train))
    return forest.forest(_dealt(train), _cut_points(train), options["numTrees"], options["maxDepth"], options["seed"])


def _boosted(trees, train: DataFrame, by_label: bool) -> OnBins:
    """Spark's boosting of ``train``, on the cells of its bins."""
    cuts = cut_points(train)
    found = materialise(cells(train, cuts, by_label), "cells")
    rows = spread(found, found.count(), least=CELLS_LEAST).persist()
    try:
        return OnBins(trees.fit(rows), cuts)
    finally:
        rows.unpersist()


def boosted_regressor(train: DataFrame, **settings):
    """Boosted trees by squared error, fitted on weighted cells (see ``functions.cells``); by Spark's own
    for settings that only it has."""
    if set(settings) - {"maxIter", "maxDepth", "stepSize", "seed"}:
        return _boosted(GBTRegressor(**(dict(BOOSTING, seed=SEED, weightCol="weight") | settings)), train, False)
    chosen, cuts = BOOSTING | settings, _cut_points(train)
    found = materialise(packed_cells(train, cuts), "cells")
    rows = spread(found, found.count(), least=CELLS_LEAST)
    return forest.boosted(forest.packed_bins(rows, len(cuts)), cuts, chosen["maxIter"], chosen["maxDepth"], chosen["stepSize"])


def logistic_regression(train: DataFrame):
    """Logistic regression with unit L2 strength on the sum of losses."""
    n = train.count()
    return LogisticRegression(
        regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=LOGISTIC_ITERATIONS
    ).fit(train)


def random_forest_classifier(train: DataFrame, **settings):
    options = dict(FOREST, featureSubsetStrategy="sqrt", seed=SEED) | settings
    return RandomForestClassifier(**options).fit(_dealt(train))


def boosted_classifier(train: DataFrame, **settings):
    """Boosted trees; with more than two classes a tree for each class a round, on the
    multinomial log-loss (settings ``maxIter``, ``maxDepth``, ``stepSize``)."""
    top = train.agg(F.max("label")).first()[0]
    if top is None or top <= 1:
        return _boosted(GBTClassifier(**(dict(BOOSTING, seed=SEED, weightCol="weight") | settings)), train, True)
    chosen = BOOSTING | settings
    return boosting.fit(train, chosen["maxIter"], chosen["maxDepth"], chosen["stepSize"])


REGRESSION: dict[str, Callable] = {
    "Linear Regression": linear_regression,
    "Ridge Regression": ridge_regression,
    "Random Forest": random_forest_regressor,
    "Gradient Boosting": boosted_regressor,
}
CLASSIFICATION: dict[str, Callable] = {
    "Logistic Regression": logistic_regression,
    "Random Forest": random_forest_classifier,
    "Gradient Boosting": boosted_classifier,
}


def importances(model) -> list[float]:
    """Tree importances or absolute coefficients (first class of a multiclass model)."""
    if hasattr(model, "featureImportances"):
        return list(model.featureImportances.toArray())
    if getattr(model, "numClasses", 2) > 2:
        return list(abs(model.coefficientMatrix.toArray()[0]))
    return list(abs(model.coefficients.toArray()))


@dataclass
class Trained:
    models: dict[str, object]
    predictions: DataFrame | None
    split_info: dict
    failed: dict[str, str] = field(default_factory=dict)


def fit_candidates(
    split: DataFrame,
    features: Sequence[str],
    target: str,
    candidates: dict[str, Callable],
    settings: dict[str, dict] | None = None,
) -> Trained:
    """Fit every candidate on the training rows and predict the test rows.

    A candidate that fails is logged and passed over. ``predictions`` has one row per
    model and test row: ``(model, candidate, pos, actual, predicted)``.
    """
    rows = assemble(split, features, target)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    train = _by_label(rows.where("split = 'train'"), sizes.get("train", 0)).persist()
    test = rows.where("split = 'test'")
    models, frames, failed = {}, [], {}
    try:
        for i, (name, fit) in enumerate(candidates.items()):
            try:
                models[name] = fit(train, **(settings or {}).get(name, {}))
            except Exception as error:  # noqa: BLE001 - any failing candidate is skipped
                log.warning("candidate %s failed: %s", name, error)
                failed[name] = str(error)
                continue
            frames.append(
                models[name]
                .transform(test)
                .select(
                    F.lit(name).alias("model"),
                    F.lit(i).alias("candidate"),
                    "pos",
                    F.col("label").alias("actual"),
                    F.col("prediction").alias("predicted"),
                )
            )
    finally:
        train.unpersist()
    return Trained(models, union_all(frames) if frames else None, sizes, failed)


@dataclass
class Clustered:
    scores: DataFrame
    best_k: int
    model: Fit
    assigned: DataFrame
    centres: DataFrame


def kmeans_sweep(
    df: DataFrame,
    features: Sequence[str],
    max_k: int = MAX_K,
    starts: int = KMEANS_STARTS,
    seed: int = SEED,
    max_iter: int = 300,
) -> Clustered:
    """K-means for k = 2..8, best of several starts each, scored by silhouette.

    All models move in the same scans of the saved table, so the sweep takes about as many
    passes as its slowest model has rounds. Rows with a missing or infinite value are an error.
    """
    spark = df.sparkSession
    n = df.limit(max_k + 1).count()
    ks = list(range(2, min(max_k + 1, n)))
    if not ks:
        raise ValueError("too few rows to cluster")
    safe = [f"f{i}" for i in range(len(features))]
    numbers = df.select(
        *[col(c) for c in ("pos",) if c in df.columns],
        *[col(f).cast("double").alias(s) for f, s in zip(features, safe)],
        F.monotonically_increasing_id().alias("_row"),
    )
    # Numbered before the rows are dealt out: a number names the row, whichever task reads it.
    saved = materialise(spread(numbers, df.count(), "_row"), "clustered")
    rows = Rows(saved, safe, "_row")
    try:
        fitted = fit_all(rows, ks, starts, seed, max_iter)
    finally:
        rows.release()
    least = {k: min((fitted[k, s] for s in range(starts)), key=lambda m: m.cost) for k in ks}
    placed = materialise(assign(saved, safe, {f"_k{k}": m.centres for k, m in least.items()}), "assigned")
    results, best = [], None
    for k, model in least.items():
        score = silhouette(placed, safe, f"_k{k}", ndigits=None).first()["silhouette"]
        if score is None:
            continue
        results.append((k, f"KMeans (k={k})", float(score), model.cost))
        if best is None or score > best[0]:
            best = (score, k, model)
    if best is None:
        raise ValueError("too few rows to cluster")
    scores = spark.createDataFrame(results, "k int, model string, silhouette double, cost double")
    centres = spark.createDataFrame(
        [tuple(float(v) for v in c) for c in best[2].centres], ", ".join(f"`{f}` double" for f in features)
    )
    assigned = placed.select(
        *[col(c) for c in ("pos",) if c in df.columns],
        *[F.col(s).alias(f) for f, s in zip(features, safe)],
        F.col(f"_k{best[1]}").alias("cluster"),
    )
    return Clustered(
        scores.withColumn("silhouette", F.round("silhouette", 4)), best[1], best[2], assigned, centres
    )
