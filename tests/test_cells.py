import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tabsight.functions import cells
from tabsight.operators import train
from tabsight.session import spread


def rows_of(spark, two_classes):
    """3,000 rows of 12 x 5 different features."""
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 12, 3000) / 4, rng.integers(0, 5, 3000) * 10.0
    y = a * 3 + np.where(b > 20, 4, 0) + rng.normal(0, 2, 3000)
    y = (y > 7).astype(float) if two_classes else y
    made = [(i, Vectors.dense(p, q), float(v)) for i, (p, q, v) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(made, ["pos", "features", "label"])


def test_cells_hold_all_rows(spark):
    rows = rows_of(spark, True)
    found = cells.cells(rows, cells.cut_points(rows), by_label=True)
    assert found.count() <= 120 and found.agg(F.sum("weight")).first()[0] == 3000
    ones = found.where("label = 1").agg(F.sum("weight")).first()[0]
    assert ones == rows.where("label = 1").count()


def test_boosting_on_cells_predicts_as_on_rows(spark):
    settings = dict(maxIter=5, maxDepth=3, stepSize=0.1, seed=train.SEED)
    for fit, own, two in ((train.boosted_regressor, GBTRegressor, False), (train.boosted_classifier, GBTClassifier, True)):
        rows = rows_of(spark, two).persist()
        mine = fit(rows, maxIter=5, maxDepth=3)
        assert isinstance(mine, cells.OnBins) and mine.getNumTrees == 5 and len(mine.trees) == 5
        both = mine.transform(rows).select("pos", F.col("prediction").alias("p")).join(own(**settings).fit(rows).transform(rows), "pos")
        assert both.count() == 3000 and both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-6
        assert abs(sum(train.importances(mine)) - 1) < 1e-9
        assert mine.transform(rows).columns[:3] == rows.columns
        rows.unpersist()


def test_forest_rows_are_dealt_over_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(cores * 5000).coalesce(1).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"), F.lit("train").alias("split"))
    seen = []

    def fit(rows):
        seen.append(rows.rdd.getNumPartitions())
        return train.linear_regression(rows)

    train.fit_candidates(one, ["a"], "y", {"x": fit})
    assert seen == [cores]
    assert train._dealt(train.assemble(one, ["a"], "y")).rdd.getNumPartitions() == cores
    assert spread(spark.range(10), 10).rdd.getNumPartitions() == 1
