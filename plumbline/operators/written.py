"""A table that is really written, in folders by a hash of the item, so that a change touches its items' folders only.

A change reads the folders of its items, and Spark writes their new rows beside them and moves them into place when
the job has succeeded (dynamic partition overwrite); a job that fails leaves the old rows. Other folders' files are
not opened. One writer at a time; readers that began before a change should be done before the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Each written folder has one row that is not live, so that a folder whose last rows go is written, too.
_FOLDER, _LIVE = "plumb_folder", "plumb_live"


@dataclass(frozen=True)
class ItemTable:
    """Rows of a schema (as DDL) with the column key, in so many folders under path."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    folders: int = 64

    def _folder(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.folders)).cast("int")

    def _read(self) -> DataFrame:
        shape = f"{self.schema}, {_LIVE} boolean, {_FOLDER} int"
        there = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], shape).drop(_LIVE)
        return self.spark.read.schema(shape).parquet(self.path).where(_LIVE).drop(_LIVE)

    def rows(self) -> DataFrame:
        return self._read().drop(_FOLDER)

    def of(self, items: DataFrame) -> DataFrame:
        """The rows of the items (a column of the key's name); only their folders are read."""
        at = [r[0] for r in items.select(self._folder()).distinct().collect()]
        wanted = items.select(F.col(self.key).alias("plumb_wanted")).distinct()
        return self._read().where(F.col(_FOLDER).isin(at)).drop(_FOLDER).join(wanted, F.col(self.key).eqNullSafe(F.col("plumb_wanted")), "left_semi")

    def _change(self, items: DataFrame, changed: Callable[[DataFrame], DataFrame]) -> None:
        """Puts changed(rows of the items' folders) in place of those folders."""
        at = [r[0] for r in items.select(self._folder()).distinct().collect()]  # as many as there are folders, at most
        if not at:
            return
        old = self._read().where(F.col(_FOLDER).isin(at)).drop(_FOLDER)
        rows = changed(old).withColumns({_LIVE: F.lit(True), _FOLDER: self._folder()})
        marks = self.spark.createDataFrame([(i, False) for i in at], f"{_FOLDER} int, {_LIVE} boolean")
        both = rows.unionByName(marks, allowMissingColumns=True).repartition(len(at), _FOLDER)
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_FOLDER).parquet(self.path)

    def _without(self, old: DataFrame, items: DataFrame) -> DataFrame:
        gone = items.select(F.col(self.key).alias("plumb_gone")).distinct()
        return old.join(gone, F.col(self.key).eqNullSafe(F.col("plumb_gone")), "left_anti")

    def replace(self, new: DataFrame) -> None:
        """All rows of new's items go and new's rows come; a null item is an item like others."""
        self._change(new, lambda old: self._without(old, new).unionByName(new.select(*old.columns)))

    def upsert(self, new: DataFrame, on: str) -> None:
        """Rows of new take the place of rows of the same item with the same value of on, or are added."""
        self._change(new, lambda old: store.upserted(old, new.select(*old.columns), self.key, on))

    def clear(self, items: DataFrame) -> None:
        """All rows of the items (a column of the key's name) go."""
        self._change(items, lambda old: self._without(old, items))
