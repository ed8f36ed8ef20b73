"""Tables in the cluster's shared folder that cut lineage or keep something for several plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir


class Scratch:
    """Written tables under spark.checkpoint.dir: a lost executor costs only what comes after the last one."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """df written and read again; by: a column whose values get folders of their own."""
        path = f"{self.root}/{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Frees a table, or all, that nothing still to be computed reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
