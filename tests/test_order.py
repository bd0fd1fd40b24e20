import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions import order
from tabsight.functions.order import dense_position, neighbours, with_halo


def hot_times(spark, parts):
    """A third of all rows share one time; some times are missing."""
    return (
        spark.range(3000)
        .select(
            "id",
            F.when(F.col("id") % 3 == 0, F.lit(50))
            .when(F.col("id") % 101 == 0, F.lit(None))
            .otherwise((F.col("id") * 7919) % 1000)
            .alias("t"),
        )
        .repartition(parts)
    )


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_position_with_hot_time(spark, parts):
    got = dense_position(hot_times(spark, parts), ["t", "id"]).toPandas().sort_values("pos")
    want = got.sort_values(["t", "id"], na_position="last")
    assert list(got["pos"]) == list(range(3000))
    assert list(want["pos"]) == list(range(3000))


def test_position_within_groups_and_running_total(spark):
    df = hot_times(spark, 4).where("t is not null").withColumn("g", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    got = dense_position(df.withColumn("w", F.col("id") % 5), ["t", "id"], within=["g"], weight="w").toPandas()
    for _, part in got.sort_values(["t", "id"]).groupby("g"):
        assert list(part["pos"]) == list(range(len(part)))
        assert list(part["pos_total"]) == list(part["w"].cumsum())


@pytest.mark.parametrize("block", [7, 50, 5000])
def test_halo_sees_earlier_rows(spark, block):
    df = spark.range(500).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("v")).repartition(6)
    got = (
        with_halo(df, 7, block_rows=block)
        .withColumn("before", F.lag("v", 7).over(neighbours()))
        .where("not _halo")
        .toPandas()
        .sort_values("pos")
    )
    want = pd.Series(range(0, 1500, 3)).shift(7)
    assert len(got) == 500
    assert got["before"].reset_index(drop=True).fillna(-1).tolist() == want.fillna(-1).tolist()


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_steps_of_many_columns_share_a_sort(spark, parts):
    df = spark.range(4000).repartition(parts).select(
        "id",
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("up"),
        (-F.col("id")).cast("decimal(20,2)").alias("down"),
        F.when(F.col("id") == 2500, 0).otherwise(F.col("id")).alias("dips"),
        F.lit(5).alias("still"),
        F.lit(None).cast("double").alias("gone"),
    )
    assert order.steps_taken(df, ["id"], df.columns[1:]) == {
        "up": (False, True), "down": (True, False), "dips": (True, True), "still": (False, False), "gone": (False, False)
    }
    assert order.steps_taken(df.limit(0), ["id"], ["up"]) == {"up": (False, False)}
    assert order.steps_taken(df, ["id"], []) == {}


def test_a_fall_between_two_sort_tasks_is_seen(spark):
    """Values that rise inside every stretch of rows and fall where the stretches meet."""
    for cut in range(100, 4000, 450):
        df = spark.range(4000).select("id", F.when(F.col("id") < cut, F.col("id") + 4000).otherwise(F.col("id")).alias("v"))
        assert order.steps_taken(df.repartition(6), ["id"], ["v"]) == {"v": (True, True)}
