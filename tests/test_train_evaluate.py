import math

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsight.functions import boosting, lloyd
from tabsight.operators import evaluate, train


@pytest.mark.parametrize("n", [1, 5, 10, 101, 4001])
def test_random_split_sizes(spark, n):
    df = spark.range(n)
    a = train.random_split(df, ["id"])
    assert a.where("split = 'test'").count() == math.ceil(0.2 * n)
    b = train.random_split(df.repartition(7), ["id"])
    assert a.exceptAll(b.select(a.columns)).count() == 0


@pytest.mark.parametrize("n", [10, 55, 4003])
def test_chronological_split(spark, n):
    df = spark.range(n).select((F.col("id") * 3).alias("pos"))
    got = train.chronological_split(df)
    assert got.where("split = 'train'").count() == int(n * 0.8)
    assert got.where("split = 'train'").agg(F.max("pos")).first()[0] == (int(n * 0.8) - 1) * 3


def test_stratified_split(spark):
    df = spark.range(5003).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").when(F.col("id").isin(2, 4), "two").otherwise("rest").alias("y")
    )
    got = {(r["y"], r["split"]): r["count"] for r in train.stratified_split(df, "y", ["id"]).groupBy("y", "split").count().collect()}
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    wanted = 5003 - math.ceil(0.2 * 5003)
    exact = {k: n * wanted / 5003 for k, n in sizes.items()}
    fit = {k: math.floor(v) for k, v in exact.items()}
    for k in sorted(sizes, key=lambda k: (fit[k] - exact[k], k))[: wanted - sum(fit.values())]:
        fit[k] += 1
    assert {k: got.get((k, "train"), 0) for k in sizes} == fit
    assert sum(v for (_, s), v in got.items() if s == "test") == 1001


def regression_rows(spark, n=400):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2]
    y = x @ [2.0, -1.0, 4.0] + 7 + rng.normal(size=n)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "pos bigint, a double, b double, c double, y double")


def test_linear_and_ridge_closed_form(spark):
    x, y, df = regression_rows(spark)
    rows = train.assemble(df, ["a", "b", "c"], "y")
    xc, yc = x - x.mean(0), y - y.mean()
    for fitted, alpha in ((train.linear_regression(rows), 0.0), (train.ridge_regression(rows), 1.0)):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        assert list(fitted.coefficients) == pytest.approx(list(want), abs=1e-6)


def test_logistic_gradient(spark):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.5, -2.0] + rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double")
    fitted = train.logistic_regression(train.assemble(df, ["a", "b"], "y"))
    w = np.array(fitted.coefficients)
    p = 1 / (1 + np.exp(-(x @ w + fitted.intercept)))
    assert np.abs(x.T @ (p - y) + w).max() < 0.02


def test_candidates_failures_and_importances(spark):
    _, _, df = regression_rows(spark)
    split = train.random_split(df, ["pos"])

    def broken(rows):
        raise ValueError("no")

    tried = {
        "Linear Regression": train.linear_regression,
        "Broken": broken,
        "Random Forest": lambda rows: train.random_forest_regressor(rows, numTrees=3, maxDepth=3),
        "Gradient Boosting": lambda rows: train.boosted_regressor(rows, maxIter=2),
    }
    done = train.fit_candidates(split, ["a", "b", "c"], "y", tried)
    assert list(done.failed) == ["Broken"] and done.split_info == {"test": 80, "train": 320}
    scores = {r["model"]: r for r in evaluate.regression_metrics(done.predictions).collect()}
    assert scores["Linear Regression"]["r2"] > 0.9 and scores["Random Forest"]["test_rows"] == 80
    table = evaluate.feature_importance(spark, ["a", "b", "c"], train.importances(done.models["Random Forest"])).collect()
    assert table[0]["importance"] == 1.0 and all(0 <= r["importance"] <= 1 for r in table)


def three_classes(seed, rows):
    """Classes by which of three noisy sums of two numbers is the largest; the third number is noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 3))
    scores = np.column_stack([x[:, 0], x[:, 1], -x[:, 0] - x[:, 1]]) + rng.normal(scale=0.3, size=(rows, 3))
    return [(*map(float, v), float(k)) for v, k in zip(x, scores.argmax(axis=1))]


def log_loss(rows):
    return -sum(math.log(max(r["probability"][int(r["label"])], 1e-12)) for r in rows) / len(rows)


def test_multinomial_boosting_beats_one_against_the_rest(spark):
    df = spark.createDataFrame(three_classes(5, 900), "a double, b double, c double, y double").repartition(3)
    held = spark.createDataFrame(three_classes(6, 600), "a double, b double, c double, y double")
    rows, test = (train.assemble(t, ["a", "b", "c"], "y") for t in (df, held))
    # Ten steps of 0.1 would leave every model near its start, from which the binary one sets off with a whole step.
    settings = dict(maxIter=10, maxDepth=3, stepSize=0.4)
    fitted = train.boosted_classifier(rows, **settings)
    assert fitted.numClasses == 3 and len(fitted.rounds) == 10
    assert all(b < a for a, b in zip(fitted.deviance, fitted.deviance[1:]))
    got = fitted.transform(test).select("label", "prediction", "probability").collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == np.argmax(r["probability"]) for r in got)
    assert sum(r["prediction"] == r["label"] for r in got) / len(got) > 0.75
    shares = train.importances(fitted)
    assert abs(sum(shares) - 1) < 1e-9 and shares[2] == min(shares)
    # The same depth and rounds, a model for each class, its probabilities scaled to one.
    alone = []
    for k in range(3):
        own = rows.withColumn("label", (F.col("label") == k).cast("double"))
        one = train.boosted_classifier(own, **settings)
        alone.append([r["probability"][1] for r in one.transform(test).select("probability").collect()])
    parts = np.array(alone).T
    parts /= parts.sum(axis=1, keepdims=True)
    against = [dict(label=r["label"], probability=p) for r, p in zip(got, parts)]
    assert log_loss(got) < log_loss(against)


@pytest.mark.parametrize("cells,save", [(1 << 22, 8), (1, 1)])
def test_multinomial_boosting_against_numpy(spark, monkeypatch, cells, save):
    """Trees, scores and deviance against a plain greedy search over all rows, with ties, a class
    that no row has, a constant column, and histograms or scores in several scans."""
    monkeypatch.setattr(boosting, "CELLS", cells)
    monkeypatch.setattr(boosting, "SAVE_ROUNDS", save)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 6, 120), rng.integers(0, 4, 120), np.ones(120)]).astype(float)
    y = np.where(x[:, 0] > 3, 3, np.where(x[:, 1] > rng.uniform(0, 3, 120), 1, 0))
    df = spark.createDataFrame([(*map(float, r), float(k)) for r, k in zip(x, y)], "a double, b double, c double, y double").repartition(4)
    fitted = boosting.fit(train.assemble(df, ["a", "b", "c"], "y"), 3, 2, 0.5)

    shares = np.array([max(np.mean(y == k), 1e-12) for k in range(4)])
    scores, losses = np.tile(np.log(shares), (120, 1)), []

    def grow(at, g, h, depth):
        best = (1e-9, None)
        for f in range(3):
            for cut in np.unique(x[at, f])[:-1]:
                left, right = at[x[at, f] <= cut], at[x[at, f] > cut]
                gain = len(left) * len(right) / len(at) * (g[left].mean() - g[right].mean()) ** 2
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (left, right))
        if not depth or best[1] is None:
            step[at] = 0.5 * 0.75 * g[at].sum() / h[at].sum() if h[at].sum() > 1e-150 else 0.0
            return
        for side in best[1]:
            grow(side, g, h, depth - 1)

    for _ in range(3):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(120), y]).mean())
        for k in range(4):
            step = np.zeros(120)
            grow(np.arange(120), (y == k) - p[:, k], p[:, k] * (1 - p[:, k]), 2)
            scores[:, k] += step
    p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
    losses.append(-np.log(p[np.arange(120), y]).mean())
    assert np.allclose(fitted.deviance, losses, rtol=1e-9)
    got = {tuple(r["features"]): r["probability"] for r in fitted.transform(train.assemble(df, ["a", "b", "c"], "y")).collect()}
    assert all(np.allclose(got[tuple(r)], q, atol=1e-9) for r, q in zip(x, p))


def test_multinomial_boosting_without_rows(spark):
    none = train.assemble(spark.createDataFrame([], "a double, y double"), ["a"], "y")
    with pytest.raises(ValueError, match="no training rows"):
        boosting.fit(none, 2, 2, 0.1)


def test_regression_metrics_edges(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0), ("m", 2.0, 1.0), ("flat", 3.0, 3.0), ("flat", 3.0, 3.0), ("zero", 0.0, 1.0)], "model string, actual double, predicted double")
    got = {r["model"]: r for r in evaluate.regression_metrics(df).collect()}
    assert (got["m"]["mae"], got["m"]["rmse"], got["m"]["r2"], got["m"]["mape"]) == (1.0, 1.0, 0.0, 50.0)
    assert got["flat"]["r2"] == 1.0 and got["zero"]["mape"] is None and got["zero"]["r2"] == 0.0


def test_classification_metrics_edges(spark):
    df = spark.createDataFrame([("m", 1, 0), ("m", 1, 1), ("m", 0, 0), ("none", 1, 0)], "model string, actual int, predicted int")
    got = {r["model"]: r for r in evaluate.classification_metrics(df).collect()}
    assert (got["m"]["precision"], got["m"]["recall"], got["m"]["f1"]) == (1.0, 0.5, 0.6667)
    assert (got["none"]["accuracy"], got["none"]["precision"], got["none"]["f1"]) == (0.0, 0.0, 0.0)
    macro = spark.createDataFrame([("m", "a", "a"), ("m", "b", "d"), ("m", "c", "c")], "model string, actual string, predicted string")
    assert evaluate.classification_metrics(macro).first()["f1"] == 0.5


def brute_silhouette(x, c):
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    scores = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = apart[i][own].sum() / (own.sum() - 1)
        b = min(apart[i][c == k].mean() for k in set(c) - {c[i]})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette(spark):
    rng = np.random.default_rng(24)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(5, 1, (40, 2)), [[30.0, 30.0]]])
    c = np.array([0] * 60 + [1] * 40 + [2])
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, c)], "x double, y double, cluster int").repartition(4)
    got = {tuple(evaluate.silhouette(df.repartition(k), ["x", "y"], "cluster", ndigits=9).first()) for k in (1, 4, 7)}
    assert len(got) == 1 and got.pop() == (pytest.approx(brute_silhouette(x, c)), 101)
    named = df.withColumn("cluster", F.concat(F.lit("c"), "cluster"))
    assert evaluate.silhouette(named, ["x", "y"], "cluster", ndigits=None).first()[0] == pytest.approx(brute_silhouette(x, c))
    assert evaluate.silhouette(df.where("cluster = 0"), ["x", "y"], "cluster").first()["silhouette"] is None


def test_labels_are_numbers_only_where_they_are(spark):
    rows = [("m", "v1", "v1.0"), ("m", "v1.0", "v1"), ("m", "v1", "v1"), ("m", "v2", "v2")]
    text = spark.createDataFrame(rows, "model string, actual string, predicted string")
    assert evaluate.classification_metrics(text).first()["accuracy"] == 0.5
    mixed = spark.createDataFrame([("m", 1, 1.0), ("m", 0, 0.0)], "model string, actual int, predicted double")
    assert evaluate.classification_metrics(mixed).first()["accuracy"] == 1.0


def test_many_classes_are_split_by_share(spark):
    df = spark.range(180_000).select("id", (F.col("id") % 60_000).alias("y"))
    split = train.stratified_split(df, "y", ["id"])
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 144_000, "test": 36_000}
    assert split.groupBy("y").agg(F.count_if(F.col("split") == "test").alias("t")).agg(F.max("t")).first()[0] == 1


def test_kmeans_sweep(spark):
    rng = np.random.default_rng(25)
    rows = [(float(rng.normal(k * 10)), float(rng.normal(k * 10))) for k in range(3) for _ in range(30)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = train.kmeans_sweep(df, ["a", "b"], max_k=4, starts=2)
    assert found.best_k == 3 and found.centres.count() == 3
    assert evaluate.cluster_spread(found.centres, ["a", "b"]).count() == 2


def plain_lloyd(x, centres):
    for rounds in range(1, 301):
        near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if ((moved - centres) ** 2).sum(axis=1).max() <= lloyd.TOLERANCE**2:
            break
        centres = moved
    return moved, ((x[:, None] - moved) ** 2).sum(axis=2).min(axis=1).sum(), rounds


def test_joint_rounds_equal_single_fits(spark):
    """Every model ends where it ends alone, and all of them share the slowest one's passes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3)) + rng.integers(0, 4, (2000, 1)) * 4 + [1e5, 0, -50]
    saved = spark.createDataFrame([(*map(float, v), i) for i, v in enumerate(x)], "a double, b double, c double, n bigint").repartition(5)
    rows = lloyd.Rows(saved, ["a", "b", "c"], "n")
    first = [x[rng.choice(2000, k, replace=False)] for k in (2, 3, 4, 5, 8)]
    fits = lloyd.lloyd(rows, [f - rows.shift for f in first], 300)
    alone = [plain_lloyd(x, f) for f in first]
    for fit, (centres, cost, rounds) in zip(fits, alone):
        assert fit.centres == pytest.approx(centres, abs=1e-3) and fit.cost == pytest.approx(cost, rel=1e-6)
        assert abs(fit.rounds - rounds) <= 1
    assert rows.passes == max(f.rounds for f in fits) + 1


@pytest.mark.parametrize("at_once,block_bytes", [(1 << 24, 1 << 18), (1, 100)])
def test_a_pass_is_one_job_on_kept_blocks(spark, monkeypatch, at_once, block_bytes):
    """a pass reads no table and plans no query; its sums are those of plain numpy, and of
    equally near centres the first counts."""
    monkeypatch.setattr(lloyd, "SENT_AT_ONCE", at_once, raising=False)
    monkeypatch.setattr(lloyd, "BLOCK_BYTES", block_bytes, raising=False)
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(700, 3)), 1)
    table = spark.createDataFrame([(*map(float, v), i) for i, v in enumerate(x)], "a double, b double, c double, n bigint")
    saved = train.materialise(table.repartition(6), "rows")
    rows = lloyd.Rows(saved, ["a", "b", "c"], "n")
    groups = [x[:2], np.concatenate([x[:1]] * 3), x[5:8], x[:5]]
    rows.sums([g - rows.shift for g in groups])
    spark.sparkContext.setJobGroup(f"pass {at_once}", "")
    found = rows.sums([g - rows.shift for g in groups])
    spark.sparkContext.setJobGroup("others", "")
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup(f"pass {at_once}")
    assert len(jobs) == 1 and len(tracker.getJobInfo(jobs[0]).stageIds) == (2 if at_once == 1 else 1)
    rows.release()
    for g, (n, total, cost) in zip(groups, found):
        d = ((x[:, None] - g) ** 2).sum(axis=2)
        assert cost == pytest.approx(d.min(axis=1).sum())
        assert n.sum() == len(x) and total.sum(axis=0) == pytest.approx((x - rows.shift).sum(axis=0), abs=1e-9)
    assert found[1][0].tolist() == [len(x), 0, 0]


def test_joint_fits_cost_no_more_than_single_ones(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 4)) + 6 * rng.normal(size=4) for _ in range(6)])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double")
    costs = {r["k"]: r["cost"] for r in train.kmeans_sweep(df, list("abcd"), max_k=6, starts=4).scores.collect()}
    vectors = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    for k in (3, 6):
        assert costs[k] <= min(KMeans(k=k, seed=s).fit(vectors).summary.trainingCost for s in range(4)) * 1.001


def test_kmeans_of_equal_and_missing_rows(spark):
    with pytest.raises(ValueError):
        train.kmeans_sweep(spark.createDataFrame([(1.0,)] * 20, "a double"), ["a"], max_k=3, starts=2)
    with pytest.raises(ValueError):
        train.kmeans_sweep(spark.createDataFrame([(1.0,), (None,), (3.0,), (4.0,)], "a double"), ["a"], max_k=3, starts=2)
    with pytest.raises(ValueError):
        train.kmeans_sweep(spark.createDataFrame([], "a double"), ["a"])


def test_best_and_drivers(spark):
    scores = spark.createDataFrame([("x", 1, 0.5), ("y", 0, 0.5), ("z", 2, 0.1)], "model string, candidate int, r2 double")
    assert evaluate.best_model(scores, "r2").first()["model"] == "y"
    assert [r["rank"] for r in evaluate.model_comparison(scores, "r2").collect()] == [1, 2, 3]
    table = evaluate.feature_importance(spark, ["a", "b"], [0.0, 0.0])
    assert evaluate.top_drivers(table).count() == 2


def test_forests_do_not_hang_on_how_rows_are_stored(spark):
    rng = np.random.default_rng(31)
    rows = [(i, *map(float, v), float(v[0] + v[1] ** 2)) for i, v in enumerate(rng.normal(size=(400, 2)))]
    grown = []
    for seed in (1, 2):
        df = spark.createDataFrame([rows[i] for i in np.random.default_rng(seed).permutation(400)], "pos long, a double, b double, y double")
        grown.append(train.random_forest_regressor(train.assemble(df, ["a", "b"], "y"), numTrees=5, maxDepth=4).toDebugString.split("\n", 1)[1])
    assert grown[0] == grown[1]
