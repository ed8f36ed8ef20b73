"""2. Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the most frequent byte n-grams (1 to 3) of a language's words, in order of frequency. A
document's own order is compared with each profile: every n-gram is out of place by the difference of its
two ranks, or by TOP if the profile has it not; the language with the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold, table
from .vecbytes import blocks, raw

TOP = 400
#: Rows a task counts in memory before it hands them on.
HELD = 2_000_000
_MAP = np.full(256, 32, np.uint8)  # all but letters become one space; bytes of other scripts are letters
_MAP[65:91] = np.arange(97, 123)
_MAP[97:123] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}").search
_ROW, _CODE = 13, 26


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every n-gram in the words of every row; a word has a space at both ends."""
    data, offsets = raw(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    text = _MAP[data]
    capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    text[1:][capital] += 0x20
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (row[1:] != row[:-1])
    text, row = text[keep].astype(np.int64), row[keep]
    edge = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
    at = np.concatenate([edge[1:], edge[:-1]])  # a space after and before each row; where two rows meet, first the one after
    text, row = np.insert(text, at, 32), np.insert(row, at, np.concatenate([row[edge[1:] - 1], row[edge[:-1]]]))
    rows, codes = [], []
    for n in (1, 2, 3):
        m = len(text) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, np.int64)
        for j in range(n):
            code = code << 8 | text[j : m + j]
        good = row[:m] == row[n - 1 :]
        good &= text[:m] != 32 if n == 1 else (text[:m] != 32) | (text[1 : m + 1] != 32)
        if n == 3:
            good &= text[1 : m + 1] != 32
        rows.append(row[:m][good]), codes.append(code[good])
    return np.concatenate(rows), np.concatenate(codes)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[at], np.diff(at, append=len(keys))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, code, n), added up within the task."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[at], np.add.reduceat(n, at) if len(at) else n

    def out() -> pa.RecordBatch:
        keys, n = merged()
        lang = pa.array(list(names), pa.string()).take(pa.array(keys >> _CODE))
        return pa.RecordBatch.from_arrays([lang, pa.array(keys & (1 << _CODE) - 1), pa.array(n)], names=["lang", "code", "n"])

    for batch in batches:
        for block in blocks(batch, "text"):
            lang = np.array([names.setdefault(x, len(names)) for x in block.column(0).to_pylist()], np.int64)
            row, code = grams(block.column(1))
            held.append(_runs(lang[row] << _CODE | code))
            if sum(len(k) for k, _ in held) > HELD:
                held[:] = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield out()
                    held.clear(), names.clear()
    if held:
        yield out()


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, code, place (0 to TOP - 1) of all rows with text and lang; ties go to the smaller code."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    # the bare rank under a limit lets every task keep TOP rows a language before the shuffle
    return counts.withColumn("rank", rank).where(F.col("rank") <= TOP).select("lang", "code", (F.col("rank") - 1).alias("place"))


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and place of the TOP n-grams of every row."""
    row, code = grams(column)
    keys, n = _runs(row << _CODE | code)
    row, code = keys >> _CODE, keys & (1 << _CODE) - 1
    if len(n) and n.max() < 1 << 24 and len(column) <= 1 << _ROW:
        packed = np.sort(row << 50 | (1 << 24) - n << _CODE | code)
        row, code = packed >> 50, packed & (1 << _CODE) - 1
    else:
        order = np.lexsort((code, -n, row))
        row, code = row[order], code[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    top = place < TOP
    return row[top], code[top], place[top]


def _predictor(known: list[tuple[str, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", rows=1 << _ROW):
                column = block.column(1)
                row, code, place = places(column)
                size = np.bincount(row, minlength=len(column))
                sums = np.zeros((len(known), len(column)))
                for k, (_, codes, at) in enumerate(known):
                    near = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    off = np.where(codes[near] == code, np.abs(at[near] - place), TOP)
                    sums[k] = np.bincount(row, off, len(column))
                data, offsets = raw(column)
                lower = np.concatenate([[0], np.cumsum((data | 32) - 97 < 26)])
                letter = lower[offsets[1:]] > lower[offsets[:-1]]
                for i in np.flatnonzero(~letter & (size > 0)):
                    letter[i] = _LETTER(column[i].as_py()) is not None
                if known:
                    best = sums.argmin(0)
                    score = np.where(letter, 1 - sums.min(0) / np.maximum(size * TOP, 1), 0.0)
                    lang = [known[b][0] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                else:
                    score, lang = np.zeros(len(column)), ["und"] * len(column)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=["id", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, lang_pred, score (1 - mean share out of place; 0 for und).

    model comes from profiles(): TOP rows a language, so what reaches the driver and the tasks is bounded
    by the number of languages. Null, empty and letterless texts, and all texts if nothing was learned, are
    und. Equal distances go to the first language in order of name. Texts are read whole.
    """
    learned: dict[str, list[tuple[int, int]]] = {}
    for lang, code, place in model.collect():
        learned.setdefault(lang, []).append((code, place))
    known = [(lang, *np.array(sorted(learned[lang]), np.int64).T) for lang in sorted(learned)]
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predictor(known), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col, 3) == 1, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identified(docs, profiles(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
