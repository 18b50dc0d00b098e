"""Connected components of a graph whose edges no single task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.sources.sinks import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours move to the least node of each node's neighbourhood.

    The large step moves the larger neighbours, the small step the smaller ones and the node.
    """
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    sides = edges.unionByName(turned)
    if not large:
        sides = sides.where("v < u")
    least = sides.groupBy("u").agg(F.min("v").alias("low"))
    met = sides.join(least, "u").withColumn("low", F.least("u", "low"))
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            met.select("u", F.col("low").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) is connected with.

    Large and small star steps alternate until nothing changes, which takes a number of rounds
    that grows with the logarithm of the longest chain. Each round is a written table.
    """
    now = written(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == mark or not sums[0]:
            break
        mark = sums
        now = written(_star(_star(now, large=True), large=False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
