"""Running sums and neighbours along an order, with no task that holds a whole key.

Rows are dealt into ranges of (key, order), so a key with many rows lies in several ranges, one after the other.
Each range sums its part of a key; a small second pass over (range, key) adds up what the ranges before it hold;
a row's running sum is that plus the sum within its range. Neighbours across a border are handed over the same way.
Values must add up exactly in any grouping: whole numbers or decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

_RANGE = "plumb_range"


def ranged(rows: DataFrame, key: str, order: str, ranges: int | None = None) -> DataFrame:
    """rows with plumb_range, the number of the range of (key, order) that they lie in; written, as a second sampling could deal them otherwise."""
    spark = rows.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return Scratch(spark, "ranges").put(rows.repartitionByRange(n, key, order).withColumn(_RANGE, F.spark_partition_id()), "rows")


def _before(parts: DataFrame, key: str, column: str) -> Column:
    """Over (range, key) rows: what the ranges before hold of the key. As many rows as a key has ranges."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(key).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running(rows: DataFrame, key: str, order: str, ranges: int | None = None, **values: Column) -> DataFrame:
    """rows with, for each of values, its sum over the rows of the key up to this one (null counts as 0).

    order must not repeat within a key, or equal rows come in any order. Null keys are a key like others.
    """
    names = list(values)
    placed = ranged(rows.withColumns({f"plumb_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()}), key, order, ranges)
    parts = placed.groupBy(_RANGE, key).agg(*(F.sum(f"plumb_{n}").alias(f"plumb_of_{n}") for n in names))
    parts = parts.select(_RANGE, F.col(key).alias("plumb_key"), *(_before(parts, key, f"plumb_of_{n}").alias(f"plumb_to_{n}") for n in names))
    within = Window.partitionBy(_RANGE, key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"plumb_{n}": F.sum(f"plumb_{n}").over(within) for n in names}).withColumnRenamed(_RANGE, "plumb_at")
    both = summed.join(parts, (F.col("plumb_at") == F.col(_RANGE)) & F.col(key).eqNullSafe(F.col("plumb_key")))
    return both.select(*rows.columns, *((F.col(f"plumb_{n}") + F.col(f"plumb_to_{n}")).alias(n) for n in names))


def with_previous(rows: DataFrame, key: str, order: str, ranges: int | None = None, **columns: str) -> DataFrame:
    """rows with, for each of columns, its value in the row of the key before this one; null for the first."""
    names = list(columns)
    placed = ranged(rows, key, order, ranges)
    within = Window.partitionBy(_RANGE, key).orderBy(order)
    last = placed.groupBy(_RANGE, key).agg(F.max_by(F.struct(*columns.values()), order).alias("plumb_last"))
    handed = last.select(_RANGE, F.col(key).alias("plumb_key"), F.lag("plumb_last").over(Window.partitionBy(key).orderBy(_RANGE)).alias("plumb_handed"))
    own = placed.withColumn("plumb_own", F.lag(F.struct(*columns.values())).over(within)).withColumn("plumb_first", F.row_number().over(within) == 1).withColumnRenamed(_RANGE, "plumb_at")
    both = own.join(handed, (F.col("plumb_at") == F.col(_RANGE)) & F.col(key).eqNullSafe(F.col("plumb_key")))
    before = F.when(F.col("plumb_first"), F.col("plumb_handed")).otherwise(F.col("plumb_own"))
    return both.select(*rows.columns, *(before[columns[n]].alias(n) for n in names))
