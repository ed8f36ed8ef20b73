"""The call log's numbers over restarts, tries and failures; reports as Markdown."""

import datetime
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.sources import calls

ROOT = str(Path(__file__).resolve().parents[1])
WHEN = datetime.datetime(2024, 5, 6, 7, 8, 9, 250_000)


def some(spark, n, start=0, parts=3):
    rows = [(f"s{i % 2}", f"p{i} data:image/png;base64,AAAA= x", None if i % 3 else f"r\n{i}|é", None, WHEN) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "stage string, prompt string, response string, error string, at timestamp").repartition(parts)


def numbers(spark, path):
    return sorted(r.seq for r in spark.read.format("call_log").load(path).collect())


def test_numbers_go_on_after_a_restart(spark, tmp_path):
    path = f"{tmp_path}/log"
    calls.register(spark)
    some(spark, 10).write.format("call_log").mode("append").save(path)
    assert numbers(spark, path) == list(range(10))
    again = """import sys
from plumbline.sources import calls
from plumbline.sources.session import local_session
spark = local_session(2, 2, "1g")
calls.register(spark)
spark.range(100, 105).selectExpr("'s' AS stage", "concat('p', id, ' ') AS prompt", "'r' AS response", "CAST(NULL AS string) AS error", "TIMESTAMP '2024-01-01' AS at").write.format("call_log").mode("append").save(sys.argv[1])
"""
    subprocess.run([sys.executable, "-c", again, path], check=True, cwd=ROOT, timeout=120, env=os.environ | {"PYTHONPATH": ROOT})  # another driver
    rows = spark.read.format("call_log").load(path).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(15)) and {r.prompt.split()[0] for r in rows[10:]} == {f"p{i}" for i in range(100, 105)}
    assert not any("AAAA" in r.prompt for r in rows) and any(r.response == "r\n0|é" for r in rows) and rows[0].at == WHEN
    some(spark, 0).write.format("call_log").mode("append").save(path)
    some(spark, 2).write.format("call_log").mode("overwrite").save(path)
    assert numbers(spark, path) == [15, 16]


def test_a_failed_job_leaves_no_rows(spark, tmp_path):
    path = f"{tmp_path}/log"
    calls.register(spark)
    some(spark, 4).write.format("call_log").mode("append").save(path)
    bad = some(spark, 30).withColumn("prompt", F.when(F.col("prompt").startswith("p29"), F.raise_error("boom")).otherwise(F.col("prompt")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        bad.write.format("call_log").mode("append").save(path)
    some(spark, 1).write.format("call_log").mode("append").save(path)
    assert numbers(spark, path) == list(range(5))
    open(f"{path}/rows/left-by-a-lost-task.jsonl", "w").write("not json")  # without a commit it is not there
    assert len(numbers(spark, path)) == 5


def test_empty_log(spark, tmp_path):
    calls.register(spark)
    assert numbers(spark, f"{tmp_path}/none") == []


def test_report(spark, tmp_path):
    calls.register(spark)
    rows = spark.createDataFrame([("a|b", 0.5, None), ("c\nd", 2.0, 3)], "name string, rate double, n int").coalesce(1)
    path = f"{tmp_path}/out/report.md"
    rows.write.format("markdown_report").mode("overwrite").option("title", "Health").save(path)
    assert open(path).read() == "# Health\n\n| name | rate | n |\n| --- | --- | --- |\n| a\\|b | 0.5 |  |\n| c d | 2 | 3 |\n"
    with pytest.raises(Exception, match="at most"):
        spark.range(calls.REPORT_ROWS + 1).write.format("markdown_report").mode("overwrite").save(f"{tmp_path}/big.md")
    assert not os.path.exists(f"{tmp_path}/big.md")
    with pytest.raises(Exception, match="overwrite"):
        rows.write.format("markdown_report").mode("append").save(path)
