"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """For links (a, b): node and the smallest node that it reaches, for every node with a link.

    Each step groups by node with map-side minima and joins, so a node with very many links is split by
    adaptive skew joins; edges shrink to stars in a number of rounds that grows with log n.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, print_ = scratch.put(now, f"{label}0"), None
    for k in range(1, 100):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == print_ or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        print_ = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = scratch.put(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{label}{k}")
        if k > 1:
            scratch.drop(f"{label}{k - 2}")
    raise RuntimeError("components did not settle")
