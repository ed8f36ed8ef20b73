"""Files in, files out, and model adapters."""

import json

import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import models
from plumbline.sources import files


def test_documents_by_suffix(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.md").write_text("# A\r\ntext")
    (tmp_path / "deep" / "b.HTML").write_text("<p>body</p>")
    (tmp_path / "c.bin").write_text("no")
    got = {r.file_title: r.md for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"a": "# A\ntext", "b": "# b\n\nbody"}


def test_layouts_and_broken_files(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"type": "text", "text": "T", "text_level": 1, "page_idx": 0}, {"type": "table", "table_body": "<table>"}]))
    (tmp_path / "y.json").write_text("[{")
    rows = files.layouts(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.type, r.text, r.text_level, r.table_body) for r in rows] == [(0, "text", "T", 1, None), (1, "table", None, None, "<table>")]


def test_newest_chunks(spark, tmp_path):
    import os

    for name, when in (("old", 1_000_000), ("new", 2_000_000)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"file_title": "t", "content": name}]))
        os.utime(tmp_path / f"{name}.json", (when, when))
    assert [r.content for r in files.newest_chunks(spark, "file_title string, content string", str(tmp_path)).collect()] == ["new"]


def test_log_and_report(spark, tmp_path):
    calls = spark.createDataFrame([("s", "see data:image/png;base64,AAAA= end", "r", None), ("s", "p", None, "boom")], "stage string, prompt string, response string, error string")
    files.append_log(calls, f"{tmp_path}/log")
    files.append_log(calls, f"{tmp_path}/log")
    rows = spark.read.json(f"{tmp_path}/log").collect()
    assert len(rows) == 4 and {r.stage for r in rows} == {"s", "s_error"} and not any("AAAA" in r.prompt for r in rows)
    files.report(calls.groupBy("stage").count(), f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").first()["count"] == "2"
    files.backup(calls, f"{tmp_path}/backup")
    files.backup(calls.limit(1), f"{tmp_path}/backup", cleaned=True)
    assert spark.read.json(f"{tmp_path}/backup/chunks.json").count() == 2 and spark.read.json(f"{tmp_path}/backup/chunks_cleaned.json").count() == 1
    files.backup_markdown(spark.createDataFrame([("a/b", "# x\n\ny"), ("c", None)], "file_title string, md string"), f"{tmp_path}/md")
    rows = spark.read.text(f"{tmp_path}/md", wholetext=True).select("file", "value").collect()
    back = {r.file: r.value for r in rows}
    assert back == {"a_b_new.md": "# x\n\ny\n", "c_new.md": "\n"}


def test_model_adapter_and_stand_ins(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"text {i}") for i in range(6)], "id int, text string")

    def load():
        def model(frame: pd.DataFrame) -> pd.DataFrame:
            if (frame.text == "bad").any():
                raise ValueError("no")
            return pd.DataFrame({"size": frame.text.str.len()})

        return model

    got = {r.id: r.size for r in models.applied(df, load, "size long", batch=1).collect()}
    assert got[3] is None and got[0] == 6 and len(got) == 6
    v = df.select(models.hashed_embedding(F.col("text")).alias("v"), models.overlap_score(F.col("text"), F.lit("text 0")).alias("s")).collect()
    assert all(len(r.v) == 64 and abs(sum(x * x for x in r.v) - 1) < 1e-6 for r in v) and v[0].s == 5.0
    assert spark.range(1).select(models.hashed_embedding(F.lit("")).alias("v")).first().v == [0.0] * 64


def test_batches_of_workers_are_bounded_by_bytes(spark):
    """3,000 rows of 10 KB came as one batch before."""
    import pandas as pd
    from pyspark.sql import functions as F

    from plumbline.sources import session

    @F.pandas_udf("long")
    def together(text: pd.Series) -> pd.Series:
        return pd.Series([int(text.str.len().sum())] * len(text))

    rows = session.ship(spark).range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    assert 0 < rows.select(F.max(together("t"))).first()[0] <= session.BATCH_BYTES + 20_000
    spark.conf.set(session._BATCH, "1000000")
    session.ship(spark)
    assert spark.conf.get(session._BATCH).rstrip("b") == "1000000"
    spark.conf.unset(session._BATCH)
    session.ship(spark)
