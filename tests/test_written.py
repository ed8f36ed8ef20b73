"""The written item table: folders of other items are untouched, failed writes leave the old rows."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators.written import ItemTable

SCHEMA = "id long, item string, v string"


def filled(spark, path):
    held = ItemTable(spark, str(path), SCHEMA, "item", 8)
    held.replace(spark.createDataFrame([(i, f"item{i % 12}", f"v{i}") for i in range(60)] + [(90, None, "n")], SCHEMA))
    return held


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows(held):
    return sorted((tuple(r) for r in held.rows().collect()), key=str)


def test_changes(spark, tmp_path):
    held = filled(spark, tmp_path / "t")
    assert len(rows(held)) == 61
    held.replace(spark.createDataFrame([(100, "item3", "new"), (101, "item99", "more"), (102, None, "m")], SCHEMA))
    got = rows(held)
    assert (100, "item3", "new") in got and not any(r[1] == "item3" and r[0] != 100 for r in got) and (102, None, "m") in got and len(got) == 61 - 5 + 1 + 1
    held.upsert(spark.createDataFrame([(4, "item4", "changed"), (400, "item4", "added")], SCHEMA), "id")
    assert {r for r in rows(held) if r[1] == "item4"} == {(4, "item4", "changed"), (400, "item4", "added"), *((i, "item4", f"v{i}") for i in (16, 28, 40, 52))}
    held.clear(spark.createDataFrame([("item5",), (None,), ("no such",)], "item string"))
    assert not any(r[1] in ("item5", None) for r in rows(held))
    some = held.of(spark.createDataFrame([("item4",), ("item99",)], "item string"))
    assert some.count() == 7
    held.clear(held.rows())
    assert rows(held) == []
    held.clear(spark.createDataFrame([], "item string"))


def test_other_folders_are_untouched(spark, tmp_path):
    held = filled(spark, tmp_path / "t")
    before = files(tmp_path / "t")
    held.clear(spark.createDataFrame([("item7",)], "item string"))
    after = files(tmp_path / "t")
    same = {f for f, t in before.items() if after.get(f) == t}
    folders = lambda names: {os.path.dirname(f) for f in names}
    assert len(folders(before) - folders(same)) == 1 and len(folders(after)) == len(folders(before))
    read = held.of(spark.createDataFrame([("item1",)], "item string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read and "plumb_folder" in read


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    held = filled(spark, tmp_path / "t")
    before, names = rows(held), files(tmp_path / "t")
    bad = spark.createDataFrame([(1, "item1", "x"), (2, "item2", "x")], SCHEMA).withColumn("v", F.when(F.col("id") == 2, F.raise_error("boom")).otherwise(F.col("v")).cast("string"))
    for change in (lambda: held.replace(bad), lambda: held.upsert(bad, "id")):
        with pytest.raises(Exception, match="boom"):
            change()
    assert rows(held) == before and files(tmp_path / "t") == names
