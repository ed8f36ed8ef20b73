"""Markdown documents as sections and chunks: headings, merging, splitting, children, tables and image links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Sizes, separators in order, and wording of table sentences.
LONGEST, SHORTEST, OVERLAP, TITLE_CHARS = 2000, 500, 200, 50
CHILD, CHILD_OVERLAP = 450, 80
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", ".", "!", "?", ";", " "]
UNKNOWN, NOTHING, SKIPPED = "未知属性", "无", {"-", "/", "\\", "无", ""}
SUBJECT, COLUMN = "未知项目", "属性"
HEADING = r"^\s*(#{1,6})\s+(.+)$"
FENCE = r"^\s*(```|~~~)"


def headed(docs: DataFrame) -> DataFrame:
    """(doc_id, file_title, md) to sections (doc_id, ord, title, parent_title, body).

    Lines are numbered; fences are open where an odd number of fence lines has passed; a section is the running
    count of headings outside fences; a level's title is the last one before, unless a shallower heading came
    after it. Windows are by document, so a document's lines meet in one task and documents spread.
    """
    lines = docs.select("doc_id", "file_title", F.posexplode(F.split(F.regexp_replace("md", r"\r\n?", "\n"), "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    fence = F.col("line").rlike(FENCE)
    opened = F.sum(fence.cast("int")).over(w) % 2 == 1
    level = F.when(~fence & ~opened, F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0)
    rows = lines.withColumn("level", level).withColumn("ord", F.sum((F.col("level") > 0).cast("int")).over(w))
    each = rows.groupBy("doc_id", "file_title", "ord").agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("level") > 0, F.col("line"))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    s = Window.partitionBy("doc_id").orderBy("ord")
    for k in range(1, 6):  # place and title of the last heading of each level
        each = each.withColumn(f"l{k}", F.last(F.when(F.col("level") == k, F.struct("ord", "heading")), ignorenulls=True).over(s))
    shallower = F.greatest(*(F.when(F.col("level") > k, F.col(f"l{k}")) for k in range(1, 6)))
    parent = F.coalesce(shallower["heading"], F.col("heading"), F.col("file_title"))
    body = F.regexp_replace("body", r"^\n+|\n+$", "")
    out = each.select("doc_id", "file_title", "ord", F.coalesce("heading", "file_title").alias("title"), parent.alias("parent_title"), body.alias("body"))
    return out.where((F.col("ord") > 0) | (F.length(F.trim("body")) > 0))


def pieces(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Splits at the first separator there is, joins parts up to size with a tail of overlap, and goes on with the rest inside long parts."""
    here = next((i for i, s in enumerate(separators) if s in text), None)
    if here is None:
        return [text] if len(text) >= size else [text.strip()] if text.strip() else []
    mark, out, run = separators[here], [], []

    def flush() -> None:
        if joined := mark.join(run).strip():
            out.append(joined)

    width = lambda parts: sum(map(len, parts)) + len(mark) * max(0, len(parts) - 1)
    for part in filter(None, text.split(mark)):
        if len(part) >= size:
            flush()
            run.clear()
            out += pieces(part, size, overlap, separators[here + 1 :])
            continue
        if run and width([*run, part]) > size:
            flush()
            while run and (width(run) > overlap or width([*run, part]) > size):
                run.pop(0)
        run.append(part)
    flush()
    return out


def _splitter(size: int, overlap: int):
    @F.pandas_udf(ArrayType(StringType()))
    def split(text: pd.Series, room: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else pieces(t, int(min(size, r)), min(overlap, int(min(size, r)) // 2)) for t, r in zip(text, room, strict=True)])

    return split


def split_long(sections: DataFrame, longest: int = LONGEST, overlap: int = OVERLAP) -> DataFrame:
    """Sections over longest characters (title, gap and body) become title-1, title-2, ...; others stay as they are, part null.

    A body with a table is measured and split with its tables as sentences. A section that fits, or gives one
    piece, or whose title leaves no room, is left as it was.
    """
    title = F.substring("title", 1, TITLE_CHARS)
    rows = sections.withColumn("plumb_text", F.coalesce(linear_tables(F.when(F.contains("body", F.lit("<table>")), F.col("body"))), "body"))
    room = F.lit(longest) - F.length(title) - 2
    over = (F.length("plumb_text") > room) & (room > 0)
    rows = rows.withColumn("plumb_parts", _splitter(longest, overlap)(F.when(over, F.col("plumb_text")), room))
    rows = rows.withColumn("plumb_many", F.coalesce(F.size("plumb_parts") > 1, F.lit(False)))
    opened = rows.select("*", F.posexplode(F.when(F.col("plumb_many"), F.col("plumb_parts")).otherwise(F.array("body"))).alias("plumb_i", "plumb_body"))
    many = F.col("plumb_many")
    named = {"body": F.col("plumb_body"), "part": F.when(many, F.col("plumb_i") + 1), "title": F.when(many, F.concat(title, F.lit("-"), (F.col("plumb_i") + 1).cast("string"))).otherwise(F.col("title"))}
    return opened.withColumns(named).drop("plumb_text", "plumb_parts", "plumb_many", "plumb_i", "plumb_body")


def _merged(shortest: int):
    """Rows sorted by document and place: neighbours of one parent gathered, each row looked at once."""
    names = ["doc_id", "file_title", "ord", "title", "parent_title", "body", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # the section in hand; a document's sections go on in the next batch
        for batch in batches:
            done = []
            for doc, file, title, parent, body, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "file_title", "title", "parent_title", "body", "part")), strict=True):
                body = body or ""
                if now and now[:2] == [doc, file] and now[4] == parent and len(now[5]) < shortest:
                    now[3], now[5], now[6] = parent, now[5].rstrip() + "\n\n" + body.lstrip(), 0
                    continue
                if now:
                    done.append(now)
                now = [doc, file, now[2] + 1 if now and now[:2] == [doc, file] else 0, title, parent, body, part]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in done], schema(batch))
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(names, now, strict=True))], schema(batch))

    def schema(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([(n, pa.int32() if n in ("ord", "part") else batch.schema.field(n).type) for n in names])

    return run


def merge_short(sections: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Neighbours of one parent are joined while what is gathered is under shortest characters; then parts are numbered by parent.

    One pass over the sections in their order, so its cost is linear in a document's sections; documents spread over tasks.
    """
    rows = sections.select("doc_id", "file_title", "ord", F.coalesce("part", F.lit(0)).alias("sub"), "title", "parent_title", "body", F.col("part").cast("int").alias("part"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = f"doc_id {kind['doc_id']}, file_title string, ord int, title string, parent_title string, body string, part int"
    sorted_ = rows.repartition("doc_id", "file_title").sortWithinPartitions("doc_id", "file_title", "ord", "sub")
    merged = sorted_.mapInArrow(_merged(shortest), shape)
    n = F.sum(F.col("part").isNotNull().cast("int")).over(Window.partitionBy("doc_id", "parent_title").orderBy("ord"))
    numbered = merged.withColumn("part", F.when(F.col("part").isNotNull(), n))
    return numbered.withColumn("title", F.when(F.col("part").isNotNull(), F.concat("parent_title", F.lit("-"), F.col("part").cast("string"))).otherwise(F.col("title")))


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, file_title, md) to chunks with content = title, blank line, body."""
    return merge_short(split_long(headed(docs))).withColumn("content", F.concat_ws("\n\n", "title", "body"))


def children(parents: DataFrame, size: int = CHILD, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """A row for every piece of content, numbered from 1, with the parent's other columns."""
    cut = _splitter(size, overlap)(F.col("content"), F.lit(size))
    rows = parents.withColumn("plumb_cut", cut).select("*", F.posexplode("plumb_cut").alias("child", "child_content"))
    return rows.withColumn("child", F.col("child") + 1).drop("plumb_cut")


def linked_images(md: Column, name: Column, caption: Column, url: Column) -> Column:
    """Every image link to a file of that name gets the caption and url."""
    pattern = F.concat(F.lit(r"(?i)!\[[^\]]*\]\([^)]*\Q"), name, F.lit(r"\E[^)]*\)"))
    safe = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    return F.regexp_replace(md, pattern, F.concat(F.lit("!["), safe(caption), F.lit("]("), safe(url), F.lit(")")))


def headings_of(layout: DataFrame) -> DataFrame:
    """(doc_id, items array of type, text, text_level) to distinct headings (doc_id, ord, level, text), the first of each."""
    rows = layout.select("doc_id", F.posexplode("items").alias("ord", "x")).where(~F.col("x.type").isin("header", "footer", "page_number") & F.col("x.text_level").between(1, 6) & (F.trim("x.text") != ""))
    return rows.groupBy("doc_id", F.col("x.text_level").alias("level"), F.trim("x.text").alias("text")).agg(F.min("ord").alias("ord")).select("doc_id", "ord", "level", "text")


def sentences(grid: list[list[str]], header: bool) -> list[str]:
    """Table rows as sentences; a table of two columns without header gives name-value pairs."""
    width = max(map(len, grid), default=0)
    rows = [[*r, *[""] * (width - len(r))] for r in grid]
    out = []
    if width == 2 and not header:
        return [f"- 【{k or UNKNOWN}】：{v or NOTHING}。" for k, v in rows if k or v]
    names = rows[0] if rows else []
    for row in rows[1:]:
        facts = "，".join(f"{n or f'{COLUMN}{k}'}为{v}" for k, (n, v) in enumerate(zip(names, row, strict=True)) if k and v and v not in SKIPPED)
        about = f"(对应{names[0]})" if names[0] else ""
        if facts:
            out.append(f"- 【{row[0] or SUBJECT}】{about}：{facts}。")
        elif row[0] and row[0] != SUBJECT:
            out.append(f"- 【{row[0]}】")
    return out


class _Cells(HTMLParser):
    """The cells of an HTML table by place: a cell fills all rows and columns that it spans."""

    def __init__(self) -> None:
        super().__init__()
        self.at: dict[tuple[int, int], list[str]] = {}
        self.row, self.column, self.named, self.open = -1, 0, False, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row, self.column, self.open = self.row + 1, 0, None
        elif tag in ("td", "th") and self.row >= 0:
            span = [max(1, min(int(n), 1000)) if (n := dict(attrs).get(name) or "1").isdecimal() else 1 for name in ("rowspan", "colspan")]
            while (self.row, self.column) in self.at:
                self.column += 1
            self.named, self.open = self.named or tag == "th", []
            self.at |= {(self.row + i, self.column + j): self.open for i in range(span[0]) for j in range(span[1])}
            self.column += span[1]

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.open = None

    def handle_data(self, data):
        if self.open is not None and data.strip():
            self.open.append(data.strip())

    def grid(self) -> list[list[str]]:
        height, width = (max((p[k] for p in self.at), default=-1) + 1 for k in (0, 1))
        return [[" ".join(self.at.get((i, j), [])) for j in range(width)] for i in range(max(height, self.row + 1))]


def _html_table(table: str) -> str:
    cells = _Cells()
    cells.feed(table)
    cells.close()
    grid = cells.grid()
    if cells.row < 0:
        return table
    if not grid or not grid[0]:
        return ""
    return "\n\n" + "\n".join(sentences(grid, cells.named or not grid[0][0] or len(grid[0]) > 2)) + "\n\n"


#: Where a table begins or ends.
_TABLE_TAG = re.compile(r"<(/?)table", re.I)


def _without_html_tables(md: str) -> str:
    """HTML tables as sentences. A table ends at the first closing tag, so of nested ones what follows the inner one is left as it is."""
    out, done, begun = [], 0, None
    for tag in _TABLE_TAG.finditer(md):
        closes = bool(tag.group(1)) and md[tag.end() : tag.end() + 1] == ">"
        if begun is None and not tag.group(1) and tag.start() >= done:
            begun = tag.start()
        elif begun is not None and closes and ">" in md[begun : tag.start()]:
            out += [md[done:begun], _html_table(md[begun : tag.end() + 1])]
            done, begun = tag.end() + 1, None
    return "".join([*out, md[done:]])


def _cells_of(line: str) -> list[str] | None:
    """The cells of a line between pipes; None for other lines."""
    bare = line.strip(" \t")
    return bare[1:-1].split("|") if len(bare) > 1 and bare[0] == bare[-1] == "|" else None


def _only_marks(cells: list[str]) -> bool:
    """Nothing but dashes, colons and blanks: such a row divides a table and says nothing."""
    return not "".join(cells).strip("-: \t") and any(cells)


def table_text(md: str) -> str:
    """HTML and pipe tables (a row, a rule, more rows) replaced by their sentences, with a blank line on both sides."""
    lines = _without_html_tables(md).split("\n")
    cells, out, i = [_cells_of(line) for line in lines], [], 0
    while i < len(lines):
        rule = cells[i + 1] if i + 2 < len(lines) else None
        if cells[i] is not None and rule is not None and _only_marks(rule) and rule[0].strip(" \t"):
            end = i
            while end < len(lines) and cells[end] is not None:
                end += 1
            grid = [[c.strip() for c in lines[k].strip().strip("|").split("|")] for k in range(i, end) if not _only_marks(cells[k])]
            out.append("\n\n" + "\n".join(sentences(grid, True)) + "\n\n")
            i = end
        else:
            out.append(lines[i] + "\n" * (i + 1 < len(lines)))
            i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def linear_tables(md: pd.Series) -> pd.Series:
    return md.map(table_text, na_action="ignore")
