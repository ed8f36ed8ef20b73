"""6. Quality rules: thresholds that adapt to each language and source, from mergeable quantile sketches.

A Python pass measures whole texts. For each (lang, source) and measure a KLL sketch takes all documents;
sketches of a language's sources merge into the language's, and these into one of all documents. A fence
is read off the sketches, and the documents are joined with their group's fences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table
from .vecbytes import SPACE, Hasher, U, blocks, mix, raw, words

WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(column: pa.Array) -> list[np.ndarray]:
    """MEASURES of every row."""
    data, offsets = raw(column)
    rows = len(offsets) - 1
    starts, ends, row = words(data, offsets)
    n_words = np.bincount(row, minlength=rows)
    word_chars = _per_row(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_row(_SYMBOL[data], offsets)

    hashed = Hasher(data)
    line_start, line_end, line_row = words(data, offsets, data != 10)
    blank = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=blank[1:])
    has_word = blank[line_end] > blank[line_start]
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    n_lines = np.bincount(line_row, minlength=rows)
    key = mix(hashed(line_start, line_end) ^ mix(line_row.astype(U)))
    _, once = np.unique(key, return_index=True)
    n_dup_lines = n_lines - np.bincount(line_row[once], minlength=rows)

    h, n = hashed(starts, ends), len(starts)
    repeated = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        m = n - WINDOW + 1
        whole = row[:m] == row[WINDOW - 1 :]
        key = mix(row[:m].astype(U))
        for j in range(WINDOW):
            key = key * U(0x9E3779B97F4A7C15) + h[j : m + j]
        at = np.flatnonzero(whole)
        key = mix(key[at])
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = at[twice]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + WINDOW, -1)
    covered = np.cumsum(repeated[:n]) > 0
    n_repeat_words = np.bincount(row[covered], minlength=rows)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text"):
            values = [pa.array(x.astype(np.int64)) for x in measure(block.column(3))]
            yield pa.RecordBatch.from_arrays([*block.columns[:3], *values], names=["id", "lang", "source", *MEASURES])


#: Ratios whose upper tail is junk: (name, what, of what, least spread). A fence is q75 + SPREAD * (q75 - q25)
#: of the group, which junk cannot move while it is under a quarter of the group. The least spread stands
#: in where most documents have the same ratio (mostly none) and the quartiles give no scale.
HIGH = [("symbols", "n_symbols", "word_chars", 0.01), ("dup_lines", "n_dup_lines", "n_lines", 0.1), ("repeats", "n_repeat_words", "n_words", 0.05)]
SPREAD = 3.0
FENCES = [*(name for name, *_ in HIGH), "shortest", "longest"]
#: Mean word length: q50 -+ LENGTH_SPREAD * (q75 - q25), about 7.7 deviations of a normal distribution; least spread.
LENGTH_SPREAD, LENGTH_LEAST = 5.7, 0.1
#: Sketch size: rank errors of about 1.33/k; groups of under k documents are exact.
SKETCH_K = 2000
#: A group's fences are drawn towards its language's, and a language's towards those of all, by as much as
#: so many documents weigh: of n documents the own fence has n / (n + DRAWN) of the say, at every size.
DRAWN = 50


def adaptive_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row of docs: id_col, MEASURES, base_failed, and kept by the fences of the row's language and source.

    Null and empty texts have no words and fail the base. Null languages and sources are groups of their
    own. Rows of any length are measured whole; repeated rows count as often as they come. No rows in: no
    rows out. One shuffle carries sketches only, a few KB for each group and task.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = source.mapInArrow(_measured, f"id {kind}, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES))
    rows = Scratch(docs.sparkSession, "quality").put(rows, "measured")  # whole texts are measured once
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))

    ratios = {name: F.when(F.col(of) > 0, F.col(what) / F.col(of)).otherwise(F.lit(0.0)) for name, what, of, _ in HIGH}
    ratios["word_length"] = F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(0.0))
    counted = rows.where(~F.col("base_failed")).select("lang", "source", *(r.alias(name) for name, r in ratios.items()))
    sketches = counted.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(name, SKETCH_K).alias(name) for name in ratios))
    merged = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(name, SKETCH_K).alias(name) for name in ratios))
    by_lang = merged(sketches, "lang")
    overall = merged(by_lang)

    def fences(df: DataFrame, at: str) -> DataFrame:
        q = lambda name, p: F.kll_sketch_get_quantile_double(name, F.lit(p))
        spread = lambda name, least: F.greatest(q(name, 0.75) - q(name, 0.25), F.lit(least))
        high = [(q(name, 0.75) + SPREAD * spread(name, least)).alias(name) for name, _, _, least in HIGH]
        wide = LENGTH_SPREAD * spread("word_length", LENGTH_LEAST)
        low, top = q("word_length", 0.5) - wide, q("word_length", 0.5) + wide
        return df.select(*(c for c in ("lang", "source") if c in df.columns), "n", F.struct(*high, low.alias("shortest"), top.alias("longest")).alias(at))

    def drawn(n: str, own: str, towards: str) -> Column:
        share = F.col(n) / (F.col(n) + DRAWN)
        return F.struct(*((share * F.col(own)[name] + (1 - share) * F.col(towards)[name]).alias(name) for name in FENCES))

    a, b, c = fences(sketches, "own"), fences(by_lang, "of_lang"), fences(overall, "of_all")
    b = b.join(c.select("of_all"), how="left").select(F.col("lang").alias("lang_b"), drawn("n", "of_lang", "of_all").alias("of_lang"))
    groups = a.join(b, F.col("lang").eqNullSafe(F.col("lang_b")), "left")
    groups = groups.select(F.col("lang").alias("lang_g"), F.col("source").alias("source_g"), drawn("n", "own", "of_lang").alias("fence"))

    same = F.col("lang").eqNullSafe(F.col("lang_g")) & F.col("source").eqNullSafe(F.col("source_g"))
    joined = rows.join(groups, same, "left")
    within = F.lit(True)
    for name, *_ in HIGH:
        within &= ratios[name] <= F.coalesce(F.col("fence")[name], F.lit(float("inf")))
    within &= ratios["word_length"].between(F.coalesce(F.col("fence.shortest"), F.lit(0.0)), F.coalesce(F.col("fence.longest"), F.lit(float("inf"))))
    return joined.select(F.col("id").alias(id_col), *MEASURES, "base_failed", (~F.col("base_failed") & within).alias("kept"))


def op6_adaptive_quality(spark, sf_dir: str) -> DataFrame:
    return adaptive_rules(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
