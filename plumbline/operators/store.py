"""Replace-by-item tables, upserts, back-fills, parent lookup and tiers of fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replaced(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored without the keys that come again, and new."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted(stored: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """One row a key, the new one if there is one; one shuffle."""
    both = stored.withColumn("plumb_new", F.lit(0)).unionByName(new.withColumn("plumb_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("plumb_new")))
    return both.withColumn("plumb_n", last).where("plumb_n = 1").drop("plumb_n", "plumb_new")


def valid(rows: DataFrame, *vectors: str) -> DataFrame:
    """Rows that have all vectors."""
    for v in vectors:
        rows = rows.where(F.col(v).isNotNull() & (F.size(v) > 0))
    return rows


def filled(value: Column, other: Column) -> Column:
    """other where value is null or empty."""
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, other).otherwise(value)


def parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) of the parents of child hits (query_id, parent_uid, rank): the best rank of a parent's children, closed up."""
    best = hits.join(chunks.select("chunk_uid", "chunk_id"), hits.parent_uid == F.col("chunk_uid")).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("best"))
    return best.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "chunk_id")).alias("rank"))


def first_with_rows(tiers: list[DataFrame], key: str = "query_id") -> DataFrame:
    """For each key the rows of the first tier that has any, with the tier's number: one pass over all tiers, no test on the driver."""
    all_ = tiers[0].withColumn("tier", F.lit(1))
    for i, tier in enumerate(tiers[1:], 2):
        all_ = all_.unionByName(tier.withColumn("tier", F.lit(i)))
    return all_.withColumn("plumb_first", F.min("tier").over(Window.partitionBy(key))).where("tier = plumb_first").drop("plumb_first")


def fallback(children: DataFrame, parents_: DataFrame, of_item: Column, key: str = "query_id") -> DataFrame:
    """Hits of the first tier that a query has any in, with tier: children of its items (1), any children (2), parents of its items (3), any parents (4).

    So a child of another item comes before a parent of the right one.
    """
    return first_with_rows([children.where(of_item), children, parents_.where(of_item), parents_], key)
