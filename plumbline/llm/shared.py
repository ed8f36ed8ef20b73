"""Tables in the cluster's shared folder, table readers, and joins that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table; missing ones are null."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Scratch:
    """Written tables that cut lineage: a lost executor costs only what comes after the last one."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df written and read again; by: a column whose values get folders of their own."""
        path = f"{self.root}/{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self) -> None:
        """Lets Spark's cleaner find the plans that nothing refers to any more, whose shuffle files it then deletes."""
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Frees a table that nothing still to be computed reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is heavy if it has over 1/HEAVY of all rows; so there are under HEAVY of them, whatever the input.
HEAVY = 2000


def heavy_join(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """left with right's columns (null if none), on a 64-bit key that may be very common in left.

    right has one row a key and its count in left as weight. Keys over 1/HEAVY of all are under HEAVY by
    arithmetic, so these rows may be broadcast; the others meet by a shuffle that has no large key.
    """
    values = [c for c in right.columns if c != key]
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("plumb_all"))
    marked = right.join(F.broadcast(total)).withColumn("plumb_hot", F.col(weight) * HEAVY > F.col("plumb_all"))
    hot = marked.where("plumb_hot").select(F.col(key), F.struct(*values).alias("plumb_near"))
    cold = marked.where(~F.col("plumb_hot")).select(F.col(key).alias("plumb_key"), F.struct(*values).alias("plumb_far"))
    first = left.join(F.broadcast(hot), key, "left")
    spread = F.when(F.col("plumb_near").isNotNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col(key))
    both = first.withColumn("plumb_at", spread).join(cold, F.col("plumb_at") == F.col("plumb_key"), "left")
    found = F.coalesce("plumb_near", "plumb_far")
    return both.select(*left.columns, *(found[c].alias(c) for c in values))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, mod modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
