"""Headings restored from a layout, and the text around images: small helpers in Arrow UDFs, one document a row."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import text as T

# What counts as a candidate line, when headings are missing, and how much context an image gets.
LINE_CHARS, MISSING_AT, CONTEXT_CHARS = 60, 0.30, 200
_HEADING, _BARE, _IMAGE = re.compile(T.HEADING), re.compile(r"[\W_]+"), re.compile(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)")


def with_headings(md: str, headings: list[tuple[int, str]]) -> str:
    """Each heading in order marks the first free short line that equals it, or else equals it without punctuation."""
    lines = md.split("\n")
    free = {i: s for i, line in enumerate(lines) if (s := line.strip()) and len(s) <= LINE_CHARS and not _HEADING.match(line)}
    for level, text in headings:
        bare = _BARE.sub("", text)
        at = next((i for i, s in free.items() if s == text.strip()), None)
        if at is None and bare:
            at = next((i for i, s in free.items() if _BARE.sub("", s) == bare), None)
        if at is not None:
            lines[at] = "#" * level + " " + free.pop(at)
    return "\n".join(lines)


@F.pandas_udf(StringType())
def _restored(md: pd.Series, headings: pd.Series) -> pd.Series:
    return pd.Series([m if m is None or h is None else with_headings(m, [(x["level"], x["text"]) for x in h]) for m, h in zip(md, headings, strict=True)])


def restored(docs: DataFrame, headings: DataFrame, least: float = MISSING_AT) -> DataFrame:
    """docs (doc_id, md) with headings (doc_id, ord, level, text) put back where most are missing; other documents stay."""
    listed = headings.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "level", "text"))), lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"))).alias("plumb_headings"))
    rows = docs.join(listed, "doc_id", "left")
    new = F.when(T.hard_split_rate(F.col("md")) >= least, _restored(F.col("md"), F.col("plumb_headings"))).otherwise(F.col("md"))
    return rows.withColumn("md", F.coalesce(new, "md")).drop("plumb_headings")


def image_context(md: str, most: int = CONTEXT_CHARS) -> list[dict]:
    """For the first link to each image: the heading above, and the nearest paragraphs before and after within its section."""
    lines, found = (md or "").split("\n"), {}
    for i, line in enumerate(lines):
        for name in _IMAGE.findall(line):
            found.setdefault(name, i)

    def near(numbers: range) -> list[str]:
        paragraphs, now = [], []
        for k in numbers:
            if _HEADING.match(lines[k]):
                break
            if not lines[k].strip() or not _IMAGE.sub("", lines[k]).strip():
                if now:
                    paragraphs.append(now)
                now = []
            else:
                now.append(lines[k].strip())
        paragraphs += [now] if now else []
        kept, used = [], 0
        for p in paragraphs:  # the nearest always, then while there is room
            text = " ".join(reversed(p) if numbers.step < 0 else p)
            if kept and used + len(text) > most:
                break
            kept.append(text)
            used += len(text)
        return kept

    out = []
    for name, at in found.items():
        heading = next((lines[k].strip() for k in range(at, -1, -1) if _HEADING.match(lines[k])), "")
        out.append({"name": name, "heading": heading, "before": "\n".join(reversed(near(range(at - 1, -1, -1)))), "after": "\n".join(near(range(at + 1, len(lines))))})
    return out


_CONTEXT = StructType().add("name", "string").add("heading", "string").add("before", "string").add("after", "string")


@F.pandas_udf(ArrayType(_CONTEXT))
def _contexts(md: pd.Series) -> pd.Series:
    return md.map(image_context, na_action="ignore")


def images(docs: DataFrame) -> DataFrame:
    """(doc_id, name, heading, before, after) of every image that a document links to."""
    return docs.select("doc_id", F.explode(_contexts(F.col("md"))).alias("x")).select("doc_id", "x.*")


def valid_chunks(chunks: DataFrame, item: Column) -> DataFrame:
    """Chunks for the graph: content trimmed and not empty, an id of their own if they have none, the document's item if they have none."""
    text = F.trim("content")
    own = F.coalesce("chunk_id", F.concat(F.lit("kg_chunk_temp_"), F.col("ord").cast("string")))
    named = F.when(F.coalesce(F.length(F.trim("item")), F.lit(0)) > 0, F.trim("item")).otherwise(item)
    return chunks.where(F.length(text) > 0).withColumns({"content": text, "chunk_id": own, "item": named})
