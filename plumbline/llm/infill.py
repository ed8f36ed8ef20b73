"""12. Fill-in-middle transformation by an Aho-Corasick event scan.

One automaton holds the sentinels and the ASCII characters at which a text changes from one unit to the next;
one scan gives the places where any of them occurs. Between two events nothing changes, so the units of a gap
are known by arithmetic, and the end of the k-th unit is looked up among the events by its rank, without a
list of units. Sentinels found by the same scan make a document plain, and part the pieces when it is restored.

Drawn numbers come from the SHA-256 of seed and id, so a document has the same cuts in every run, layout and
cluster. Nothing is shuffled: both directions are passes over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table
from .vecbytes import blocks

#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The characters at which a unit may end. A line ends with its \n, a word with the blanks after it, a character with itself.
UNITS = {"lines": "\n", "words": "\t\n\v\f\r ", "chars": ""}


class Scan:
    """The events of a text, and the ends of its units by rank."""

    def __init__(self, text: str, unit: str, automaton: ahocorasick.Automaton):
        self.size, self.unit, self.ends, self.marks = len(text), unit, [], []
        for last, (width, name) in automaton.iter(text):
            if name is None:
                if unit == "words" and self.ends and self.ends[-1] == last:
                    self.ends[-1] = last + 1  # a run of blanks is one end
                else:
                    self.ends.append(last + 1)
            else:
                self.marks.append((last + 1 - width, name))
        if unit == "words" and self.ends and self.ends[0] and not text[: self.ends[0]].strip(UNITS["words"]):
            del self.ends[0]  # blanks at the start belong to the first word
        rest = self.size - (self.ends[-1] if self.ends else 0)
        self.n = self.size if unit == "chars" else len(self.ends) + (rest > 0)

    def end(self, k: int) -> int:
        """Where the first k units end."""
        if k <= 0:
            return 0
        if self.unit == "chars":
            return k
        return self.ends[k - 1] if k <= len(self.ends) else self.size


@cache
def _automaton(unit: str, sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for c in UNITS[unit]:
        automaton.add_word(c, (1, None))
    for s in sentinels:
        automaton.add_word(s, (len(s), s))
    automaton.make_automaton()
    return automaton


def infill(text: str, draws: tuple[int, int, int, int], unit: str = "lines", rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of prefix and middle (None if plain), and the text in its form."""
    scan = Scan(text, unit, _automaton(unit, sentinels))
    if not text or scan.marks or draws[2] % 100 >= rate:
        return scan.n, "plain", None, None, text
    low, high = sorted(scan.end(d % (scan.n + 1)) for d in draws[:2])
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = sentinels
    if draws[3] % 100 < spm:
        return scan.n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return scan.n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(form: str, output: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text before infill. No part holds a sentinel, and sentinels do not overlap, so each is found once."""
    if form == "plain":
        return output
    marks = Scan(output, "chars", _automaton("chars", sentinels)).marks
    at = [i for i, _ in marks] + [len(output)]
    part = {name: output[i + len(name) : at[k + 1]] for k, (i, name) in enumerate(marks)}
    p, s, m = sentinels
    if form not in ("psm", "spm") or [name for _, name in marks] != ([p, s, m] if form == "psm" else [s, p, m]):
        raise ValueError(f"no output of form {form}")
    return part[p] + part[m] + part[s]


def draws(id_: Column, seed: int = 7) -> list[Column]:
    """Four numbers of 32 bits for a document: the first groups of the SHA-256 of seed, a colon and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _infilled(*options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                drawn = zip(*(block.column(2 + k).to_pylist() for k in range(4)), strict=True)
                rows = [infill(t.as_py(), d, *options) for t, d in zip(block.column(1), drawn, strict=True)]
                n, form, before, middle, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "lines", rate: int = 100, spm: int = 50, seed: int = 7, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Per row of docs: id_col, n (units), form, prefix_chars, middle_chars, output.

    rate of 100 documents are cut into prefix, middle and suffix at units, spm of 100 of them put the suffix
    first; the others, empty texts and those that hold a sentinel are plain: the text itself, with null lengths.
    A null text counts as empty. A null id draws as an empty one. Rows that repeat an id draw the same numbers.
    A text of any length is scanned whole; no rows in, no rows out. Other columns of docs are not looked at,
    whatever their names.
    Sentinels must not be empty, and no end of one may start another, or the parts could not be told apart.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    overlap = any(a != b and b in a or any(a.endswith(b[:k]) for k in range(1, len(b))) for a in sentinels for b in sentinels)
    if len(set(sentinels)) < 3 or not all(sentinels) or overlap or any(c in s for s in sentinels for c in UNITS[unit]):
        raise ValueError("sentinels must differ, must not overlap and must not hold a character that ends units")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *draws(docs[id_col], seed))
    shape = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return source.mapInArrow(_infilled(unit, rate, spm, tuple(sentinels)), shape).withColumnRenamed("id", id_col)


def _restored(width: int, sentinels: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "output"):
                texts = [restore(f, o.as_py(), sentinels) for f, o in zip(block.column("form").to_pylist(), block.column("output"), strict=True)]
                yield pa.RecordBatch.from_arrays([*block.columns[:width], pa.array(texts, pa.string())], names=[*block.schema.names[:width], "restored"])

    return run


def restored(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """rows of infilled with a column more, restored: the exact text, rebuilt from output and form alone."""
    shape = f"{rows.drop('restored')._jdf.schema().toDDL()}, restored string"
    plain = rows.drop("restored")
    return plain.mapInArrow(_restored(len(plain.columns), tuple(sentinels)), shape)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = restored(infilled(table(spark, sf_dir, "documents", "doc_id", "text")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
b AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM b),
d AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
CASE WHEN NOT plain THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN NOT plain THEN length(m)::BIGINT END AS middle_chars,
sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
sha256(CASE WHEN plain THEN t ELSE p || m || s END) AS restored_sha256 FROM d"""
