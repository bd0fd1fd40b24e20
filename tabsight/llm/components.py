"""Connected components of a graph that no single task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (a, b) between long ids: (node, component), the smallest id reachable.

    Alternating large-star and small-star rounds: every node's larger neighbours, then its
    smaller ones, are linked to the least id it knows, until nothing changes; the number of
    rounds grows with the logarithm of the largest component. A node's neighbours are never
    gathered: minima combine on the map side, and the joins are of many rows to one, whose
    hot keys adaptive execution splits. Each round is a written table.
    """
    below = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current, seen = materialise(below.distinct(), "edges"), None
    while True:
        both = current.select(F.col("u").alias("n"), F.col("v").alias("x")).union(current.select("v", "u"))
        least = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
        large = both.where(F.col("x") > F.col("n")).join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(lowest, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        current = materialise(small, "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
