"""The input tables of the registered queries, and the gaps injected into them.

Each ``*_gaps`` function has its SQL twin in ``SQL``: the same rows for the checker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _gap(key: str, every: int, column: str):
    return F.when(F.col(key) % every != 0, F.col(column))


def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_quantity": _gap("l_orderkey", 17, "l_quantity"),
            "l_extendedprice": _gap("l_partkey", 13, "l_extendedprice"),
            "l_returnflag": _gap("l_suppkey", 11, "l_returnflag"),
        }
    )


def orders_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumns(
        {
            "o_totalprice": _gap("o_orderkey", 17, "o_totalprice"),
            "o_orderpriority": _gap("o_orderkey", 19, "o_orderpriority"),
            "o_orderdate": _gap("o_orderkey", 23, "o_orderdate"),
        }
    )


def events_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("value", _gap("event_id", 17, "value"))


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with derived amounts that depend on each other and on the return flag."""
    price = F.col("l_extendedprice")
    return lineitem_gaps(spark, sf_dir).select(
        "l_orderkey",
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
        price.alias("list_price"),
        (price * (1 + F.col("l_tax"))).alias("taxed_price"),
        (F.lit(200000.0) - price).alias("headroom"),
        (price + F.when(F.col("l_returnflag") == "A", 40000.0).otherwise(0.0)).alias("flagged_price"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a weekly wave, a correlated copy and a lopsided category."""
    value = F.col("value")
    return events_gaps(spark, sf_dir).select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.when(F.col("event_id") % 10 < 7, "web").otherwise("app").alias("channel"),
        "value",
        (value * 2 + F.col("user_id") * 0.01).alias("amount"),
        (value + F.when(F.col("event_type") == "error", 60.0).otherwise(0.0)).alias("penalty"),
        (F.lit(100.0) * F.sin(2 * F.pi() * F.col("event_id") / 7) + F.coalesce(value, F.lit(0.0)) / 10).alias("wave"),
    )


def regression_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction table of three formulas; every tenth actual is zero."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("actual"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("cust"),
    )
    models = F.array(
        F.struct(F.lit("scaled").alias("model"), F.lit(0).alias("candidate"), (F.col("price") * 0.9 + 1000).alias("predicted")),
        F.struct(F.lit("shifted").alias("model"), F.lit(1).alias("candidate"), (F.col("price") + F.col("cust")).alias("predicted")),
        F.struct(F.lit("flat").alias("model"), F.lit(2).alias("candidate"), F.lit(250000.0).alias("predicted")),
    )
    return o.select("pos", "actual", F.explode(models).alias("m")).select("pos", "actual", "m.*")


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class predictions; one model names a label that never occurs."""
    o = table(spark, sf_dir, "orders")
    models = F.array(
        F.struct(
            F.lit("often").alias("model"),
            F.lit(0).alias("candidate"),
            F.when(F.col("o_orderkey") % 5 == 0, "P").otherwise(F.col("o_orderstatus")).alias("predicted"),
        ),
        F.struct(
            F.lit("novel").alias("model"),
            F.lit(1).alias("candidate"),
            F.when(F.col("o_custkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("predicted"),
        ),
    )
    return o.select(F.col("o_orderstatus").alias("actual"), F.explode(models).alias("m")).select("actual", "m.*")


SQL = {
    "lineitem_gaps": """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
        CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
        l_discount, l_tax,
        CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
        l_linestatus, l_shipdate FROM lineitem)""",
    "orders_gaps": """(SELECT o_orderkey, o_custkey, o_orderstatus,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
        CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders)""",
    "events_gaps": """(SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, props FROM events)""",
}
SQL["priced_lines"] = f"""(SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity,
        l_extendedprice AS list_price, l_extendedprice * (1 + l_tax) AS taxed_price,
        200000.0::DOUBLE - l_extendedprice AS headroom,
        l_extendedprice + CASE WHEN l_returnflag = 'A' THEN 40000.0::DOUBLE ELSE 0.0::DOUBLE END AS flagged_price
        FROM {SQL['lineitem_gaps']})"""
SQL["signals"] = f"""(SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 10 < 7 THEN 'web' ELSE 'app' END AS channel, value,
        value * 2 + user_id * 0.01::DOUBLE AS amount,
        value + CASE WHEN event_type = 'error' THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END AS penalty,
        100.0::DOUBLE * sin(2 * pi() * event_id / 7) + coalesce(value, 0.0) / 10 AS wave
        FROM {SQL['events_gaps']})"""
SQL["regression_predictions"] = """(SELECT o_orderkey AS pos,
        CASE WHEN o_orderkey % 10 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS actual,
        m.model, m.candidate,
        CASE m.model WHEN 'scaled' THEN o_totalprice * 0.9::DOUBLE + 1000
             WHEN 'shifted' THEN o_totalprice + o_custkey ELSE 250000.0::DOUBLE END AS predicted
        FROM orders, (VALUES ('scaled', 0), ('shifted', 1), ('flat', 2)) m(model, candidate))"""
SQL["class_predictions"] = """(SELECT o_orderstatus AS actual, m.model, m.candidate,
        CASE WHEN m.model = 'often' AND o_orderkey % 5 = 0 THEN 'P'
             WHEN m.model = 'novel' AND o_custkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS predicted
        FROM orders, (VALUES ('often', 0), ('novel', 1)) m(model, candidate))"""
