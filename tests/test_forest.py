import uuid

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tabsight.functions import cells, forest
from tabsight.operators import train


def rows_of(spark, n, seed=4, parts=3):
    """Numbers with many values, a flag, a few days and a constant; a fifth of the labels repeat."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.exponential(size=n), rng.integers(0, 2, n), rng.integers(0, 7, n), np.ones(n)])
    y = np.where(rng.random(n) < 0.2, 1000.0, 1000 + 3 * x[:, 0] + x[:, 1] ** 2 * (x[:, 2] + 1) + (x[:, 3] > 4) + rng.normal(size=n))
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], "pos long, a double, b double, c double, d double, e double, y double")
    return train.assemble(df.repartition(parts), list("abcde"), "y")


def grown(bins, y, w, depth):
    """Predictions of a tree by plain search over all splits of all rows."""
    out = np.full(len(y), np.average(y, weights=w) if w.sum() else 0.0)
    if depth:
        best = (1e-7, None)
        mean = np.average(y, weights=w)
        for f in range(bins.shape[1]):
            for b in range(bins[:, f].max()):
                left = bins[:, f] <= b
                if w[left].sum() and w[~left].sum():
                    gain = sum(w[s].sum() * (np.average(y[s], weights=w[s]) - mean) ** 2 for s in (left, ~left))
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, left)
        if best[1] is not None:
            for side in (best[1], ~best[1]):
                out[side] = grown(bins[side], y[side], w[side], depth - 1)
    return out


def jobs(spark, run):
    """What ``run`` returns and how many jobs it took."""
    group = f"counted-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("least", [train.CELLS_LEAST, 64])
def test_boosting_takes_sparks_splits(spark, monkeypatch, least):
    """In one task and in several, with blocks of few rows."""
    monkeypatch.setattr(train, "CELLS_LEAST", least)
    rows = rows_of(spark, 3000).persist()
    mine = train.boosted_regressor(rows, maxIter=12, maxDepth=4)
    theirs = train._boosted(GBTRegressor(maxIter=12, maxDepth=4, stepSize=0.1, seed=train.SEED, weightCol="weight"), rows, False)
    both = mine.transform(rows).select("pos", F.col("prediction").alias("p")).join(theirs.transform(rows), "pos")
    assert both.count() == 3000 and both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-6
    assert np.abs(mine.featureImportances.toArray() - theirs.featureImportances.toArray()).max() < 1e-6
    assert mine.getNumTrees == 12 and max(t.depth for t in mine.trees) == 4
    rows.unpersist()


def test_boosting_of_a_task_is_one_job(spark):
    rows = rows_of(spark, 500).persist()
    train.boosted_regressor(rows, maxIter=1)  # later ones know the cut points
    few, before = jobs(spark, lambda: train.boosted_regressor(rows, maxIter=2))
    many, after = jobs(spark, lambda: train.boosted_regressor(rows, maxIter=40))
    assert few.getNumTrees == 2 and many.getNumTrees == 40 and after == before
    rows.unpersist()


@pytest.mark.parametrize("nodes,table", [(forest.NODES, forest.TABLE), (3, 1)])
def test_forest_against_plain_search(spark, monkeypatch, nodes, table):
    """Every tree on its own draw of the rows, also where nodes are added up a few at a time."""
    monkeypatch.setattr(forest, "NODES", nodes)
    monkeypatch.setattr(forest, "TABLE", table)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 100)
    rows = train._by_label(rows_of(spark, 700), 700).persist()
    cuts = cells.cut_points(rows)
    mine = forest.forest(rows, cuts, 6, 5, 7)
    held = rows.collect()
    x = forest._bins(np.array([r["features"].toArray() for r in held]), cuts)
    y = np.array([r["label"] for r in held])
    assert rows.rdd.getNumPartitions() == 1
    drawn = []
    for t, tree in enumerate(mine.trees):
        bits = forest._bits(np.arange(700, dtype=np.uint64), 7 * 1_000_003 + t // 4)
        w = forest._poisson()[(bits >> np.uint64(16 * (t % 4))) & np.uint64(0xFFFF)].astype(float)
        drawn.append(w)
        want = grown(x.T[w > 0], y[w > 0], w[w > 0], 5)
        assert np.abs(tree.value[tree.places(x, np.flatnonzero(w))] - want).max() < 1e-6
    assert len({tuple(w) for w in drawn}) == 6 and abs(np.mean(drawn) - 1) < 0.1 and abs(np.var(drawn) - 1) < 0.1
    got = {r["pos"]: r["prediction"] for r in mine.transform(rows).collect()}
    assert np.abs(np.array([got[r["pos"]] for r in held]) - mine.predicted(x)).max() < 1e-9
    assert mine.featureImportances[4] == 0 and abs(sum(mine.featureImportances) - 1) < 1e-9
    rows.unpersist()


def test_forest_takes_a_job_a_level(spark):
    rows = rows_of(spark, 600).persist()
    train.random_forest_regressor(rows, numTrees=1)  # later ones know the cut points
    counts = [jobs(spark, lambda trees=trees: train.random_forest_regressor(rows, numTrees=trees, maxDepth=6)) for trees in (4, 150)]
    assert [m.getNumTrees for m, _ in counts] == [4, 150] and counts[0][1] == counts[1][1]
    rows.unpersist()


def test_trees_of_odd_labels(spark):
    same = rows_of(spark, 60).withColumn("label", F.lit(3.5)).persist()
    for model in (train.random_forest_regressor(same, numTrees=3), train.boosted_regressor(same, maxIter=3)):
        assert {r["prediction"] for r in model.transform(same).collect()} == {3.5} and sum(model.featureImportances) == 0
        assert [t.depth for t in model.trees] == [0, 0, 0]
    missing = same.withColumn("label", F.when(F.col("pos") > 9, 1.0))
    with pytest.raises(Exception, match="label is missing"):
        train.random_forest_regressor(missing, numTrees=2)
    for fit in (train.random_forest_regressor, train.boosted_regressor):
        with pytest.raises(ValueError):
            fit(same.where("pos < 0"))
    same.unpersist()


def test_settings_of_spark_alone(spark):
    rows = rows_of(spark, 200).persist()
    assert not isinstance(train.random_forest_regressor(rows, numTrees=2, subsamplingRate=0.5), forest.BinnedTrees)
    assert not isinstance(train.boosted_regressor(rows, maxIter=2, minInstancesPerNode=5), forest.BinnedTrees)
    rows.unpersist()
