"""Connected components of an edge table by alternating large-star and small-star steps, each written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counts, store

HUB = 1000  # a node of more edges is joined apart; there is at most one for so many edges


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with u > v. Each node's neighbours (large: those above it) move to its least neighbour."""
    around = edges.union(edges.select("v", "u").toDF("u", "v")) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    hubs = store.saved(least.where(F.col("n") > HUB).select("u", "m"), "hubs")
    if hubs.limit(1).count():
        seldom = counts.joined_by_size(around, hubs.select("u"), ["u"], "left_anti").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
        moved = seldom.select("u", "v", "m").union(counts.joined_by_size(around, hubs, ["u"], "inner").select("u", "v", "m"))
    else:
        moved = around.join(least, "u").select("u", "v", "m")
    moved = moved.where("v > u").select("v", "m") if large else moved.select("v", "m").union(least.select("u", "m"))
    out = store.saved(moved.toDF("u", "v").where("u != v").distinct(), "edges")
    store.delete(hubs)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, component): the least node that each is connected with. Lone nodes are left out."""
    at = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    at = store.saved(at, "edges")
    told = None
    while True:
        sign = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if sign == told or not sign[0]:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select("v", "v").distinct())
        told = sign
        large = _stars(at, True)
        small = _stars(large, False)
        store.delete(at, large)
        at = small
