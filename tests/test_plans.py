from pyspark.sql import functions as F

from tabsight.plans import analyze, explore, model

FAST = {"Random Forest": dict(numTrees=3, maxDepth=3), "Gradient Boosting": dict(maxIter=2)}


def sales(spark, folder):
    """A small sales file with gaps, written as text."""
    path = str(folder / "sales_csv")
    spark.range(120).select(
        F.col("id").alias("order_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("order_date"),
        F.element_at(F.array(*map(F.lit, ("ann", "bob", "cy"))), (F.col("id") % 3 + 1).cast("int")).alias("rep"),
        F.when(F.col("id") % 10 != 0, (F.col("id") * 37) % 50 + F.col("id") % 3 * 40).alias("unit_price"),
        ((F.col("id") * 13) % 11).alias("quantity"),
    ).coalesce(1).write.csv(path, header=True)
    return path


def test_analyze_saves_every_table(spark, tmp_path):
    out = str(tmp_path / "out")
    done = analyze(spark, sales(spark, tmp_path), order_by=["order_date", "order_id"], settings=FAST, save_to=out, source_type="csv")
    assert done.ingested.metadata.first()["total_missing_cells"] == 12
    assert done.modeled.problem.problem_type == "time_series" and done.modeled.problem.target == "unit_price"
    assert done.modeled.scores.count() == 4
    assert {r["subject"] for r in done.explored.insights.where("category = 'potential_driver'").collect()} == {"rep -> unit_price"}
    for name, df in done.tables().items():
        assert spark.read.parquet(f"{out}/{name}").count() == df.count(), name


def test_text_only_table(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")] * 20, "p string, q string")
    found = explore(df)
    assert found.numeric is None and found.associations.first()["cramers_v"] is not None
    assert found.recommendations.count() == 2


def test_classification_and_clustering(spark):
    df = spark.range(90).select(
        (F.col("id") % 2 * 5 + F.rand(1)).alias("signal"), F.when(F.col("id") % 2 == 0, "no").otherwise("yes").alias("answer")
    )
    done = model(df, target="answer", settings=FAST)
    assert done.problem.problem_type == "classification" and done.scores.first()["f1"] == 1.0
    assert done.features.target_mapping.count() == 2 and done.split_info["method"] == "stratified_random"
    clustered = model(df.limit(25))
    assert clustered.problem.problem_type == "clustering" and clustered.clusters.count() == 25


def test_too_few_rows(spark):
    done = model(spark.range(5).select((F.col("id") * 1.5).alias("a")))
    assert done.scores is None


def test_clusters_on_request_where_the_target_repeats(spark):
    df = spark.range(900).select(F.col("id").alias("key"), (F.col("id") % 15 * 1.5).alias("balance"))
    assert model(df.limit(60), target="balance", settings=FAST).problem.problem_type == "regression"
    done = model(df, target="balance", cluster=True)
    assert done.problem.problem_type == "clustering" and done.problem.features == ["key", "balance"]
    assert done.clusters.count() == 900 and [r["k"] for r in done.scores.orderBy("k").collect()] == list(range(2, 9))
