"""File sources: Markdown, HTML, layout lists and chunk exports as DataFrames; and sinks for backups, logs and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import route, unix_newlines
from .html import to_markdown

LAYOUT = "type string, text string, text_level int, bbox array<double>, page_idx int, table_body string"


def _title(path: Column) -> Column:
    return F.split_part(F.regexp_extract(path, r"([^/]+)$", 1), F.lit("."), F.lit(1))


def documents(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, file_title, md) of all Markdown, text and HTML files under paths; files of other kinds are left out.

    Formats that need an external converter (PDF, DOCX) are named by the route and read by an adapter of the user's.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    kinds = raw.withColumn("kind", route(F.col("path"))).withColumn("file_title", _title(F.col("path")))
    md = kinds.where("kind = 'md'").select("path", "file_title", unix_newlines(F.col("text")).alias("md"))
    html = kinds.where("kind = 'html'").select("path", "file_title", to_markdown("text", "file_title").alias("md"))
    return md.unionByName(html)


def layouts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, ord, fields of LAYOUT) of layout lists in JSON; a broken file has no items."""
    raw = spark.read.option("recursiveFileLookup", True).text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"array<struct<{LAYOUT.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>").alias("items"))
    return raw.select("path", F.posexplode("items").alias("ord", "x")).select("path", "ord", "x.*")


def newest_chunks(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Rows of the chunk exports under paths, of each file_title only those of the file that changed last (ties: the later path)."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(list(paths)).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("plumb_file"))
    last = rows.groupBy("file_title").agg(F.max("plumb_file").alias("plumb_last"))
    return rows.join(last, "file_title").where("plumb_file = plumb_last").drop("plumb_file", "plumb_last")


# How inline images look, and what stands for them in logs.
IMAGE, MASK = r"data:image/[^;]+;base64,[A-Za-z0-9+/=]+", "data:image/...;base64,[masked]"


def masked(text: Column) -> Column:
    """Inline images in a logged prompt become a short mark."""
    return F.regexp_replace(text, IMAGE, MASK)


def masked_text(text: str | None) -> str | None:
    """masked() of one text."""
    return text and re.sub(IMAGE, lambda _: MASK, text)


def append_log(calls: DataFrame, path: str) -> None:
    """Appends model calls (stage, prompt, response, error, ...) with images masked, a folder for each stage."""
    text = {c: masked(F.col(c)) for c in ("prompt", "response") if c in calls.columns}
    failed = F.when(F.col("error").isNotNull(), F.concat("stage", F.lit("_error"))).otherwise(F.col("stage"))
    calls.withColumns(text | {"stage": failed}).write.mode("append").partitionBy("stage").json(path)


def backup(chunks: DataFrame, folder: str, cleaned: bool = False) -> None:
    """Chunks as JSON lines under folder: as they were cut (chunks.json) or as they were cleaned (chunks_cleaned.json)."""
    chunks.write.mode("overwrite").json(f"{folder}/{'chunks_cleaned' if cleaned else 'chunks'}.json")


def backup_markdown(docs: DataFrame, folder: str) -> None:
    """The texts of docs (file_title, md) as they are after their images were described: a folder <title>_new.md with the text for each.

    Titles are unique. Runs of a document's lines stay together, as a document is one row.
    """
    rows = docs.select(F.concat(F.regexp_replace("file_title", r"[/\\\\]", "_"), F.lit("_new.md")).alias("file"), F.coalesce("md", F.lit("")).alias("value"))
    rows.write.mode("overwrite").partitionBy("file").text(folder)


def report(summary: DataFrame, path: str) -> None:
    """A small summary as one CSV file with header."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
