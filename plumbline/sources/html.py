"""HTML pages as Markdown: a small tree of elements inside an Arrow UDF, so pages spread over tasks.

A heading, paragraph, list item, cell or code block owns all text inside it, whatever elements lie between; lists
right below an item come after it, indented; a quotation marks every line of what it holds; other elements are
looked through, and each text in them is a line. Paragraphs, items, cells and rows that are left open end where
the next one begins, as browsers read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Which elements do what.
DROPPED = {"script", "style", "noscript", "head", "iframe", "meta", "link"}
VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_PARAGRAPH = HEADINGS | {"p", "ul", "ol", "li", "table", "tr", "td", "th", "pre", "blockquote", "hr", "div", "section", "article", "nav", "header", "footer", "main", "form"}
#: What an element that begins ends, and the elements past which it does not reach.
ENDED = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
#: Elements nested deeper count as their ancestor of this depth.
DEEPEST = 200


class Element:
    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.inside = tag, attrs, []

    def texts(self) -> Iterator[str]:
        for x in self.inside:
            if isinstance(x, str):
                yield x
            else:
                yield from x.texts()

    def text(self) -> str:
        return " ".join(" ".join(self.texts()).split())

    def of(self, *tags: str) -> Iterator[Element]:
        """Elements of these tags inside, at any depth, in their order."""
        for x in self.inside:
            if not isinstance(x, str):
                if x.tag in tags:
                    yield x
                yield from x.of(*tags)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]
        self.dropped: list[str] = []

    def _end(self, tags: set[str], short_of: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in short_of:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.dropped or tag in DROPPED:
            if tag not in VOID:
                self.dropped.append(tag)
            return
        if tag in ENDS_PARAGRAPH:
            self._end({"p"}, ENDS_PARAGRAPH - {"p"})
        if tag in ENDED:
            self._end(*ENDED[tag])
        made = Element(tag, dict(attrs))
        self.open[-1].inside.append(made)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(made)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag in self.dropped:
                while self.dropped.pop() != tag:
                    pass
        elif any(x.tag == tag for x in self.open):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.open[-1].inside.append(data)


def _table(table: Element) -> list[str]:
    rows = [cells for row in table.of("tr") if (cells := [c.text() for c in row.of("td", "th")])]
    if not rows:
        return []
    width = max(map(len, rows))
    lines = ["| " + " | ".join(cells + [""] * (width - len(cells))) + " |" for cells in rows]
    return ["\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])]


def _items(of: Element, depth: int = 0) -> Iterator[str]:
    """The items right below a list, each followed by the lists right below it; numbers count empty items, too."""
    for n, item in enumerate((x for x in of.inside if not isinstance(x, str) and x.tag == "li"), 1):
        own = Element("li", {})
        lists = []
        for x in item.inside:
            (lists if not isinstance(x, str) and x.tag in ("ul", "ol") else own.inside).append(x)
        if text := own.text():
            yield "  " * depth + (f"{n}. " if of.tag == "ol" else "- ") + text
        for x in lists:
            yield from _items(x, depth + 1)


def _lines(of: Element) -> Iterator[str]:
    for x in of.inside:
        if isinstance(x, str):
            if text := " ".join(x.split()):
                yield text
        elif x.tag in HEADINGS or x.tag == "p":
            if text := x.text():
                yield ("#" * int(x.tag[1]) + " " if x.tag in HEADINGS else "") + text
        elif x.tag in ("ul", "ol"):
            yield from _items(x)
        elif x.tag == "table":
            yield from _table(x)
        elif x.tag == "pre":
            code = "".join(x.texts())
            if code.strip():
                yield f"```\n{code}\n```"
        elif x.tag == "blockquote":
            yield from ("> " + line for line in _lines(x))
        elif x.tag == "hr":
            yield "---"
        elif x.tag == "br":
            yield ""
        elif x.tag == "img":
            if src := (x.attrs.get("src") or "").strip():
                yield f"![{(x.attrs.get('alt') or '').strip()}]({src})"
        else:
            yield from _lines(x)


def markdown_of(html: str, title: str = "") -> str:
    """Lines of a page's body joined by blank lines, with the title on top if there is no first-level heading; a blank page is empty."""
    if not html or not html.strip():
        return ""
    parser = _Tree()
    parser.feed(html)
    parser.close()
    lines = []
    for line in _lines(next(parser.root.of("body"), parser.root)):
        if line or (lines and lines[-1]):  # a line break counts once
            lines.append(line)
    text = "\n\n".join(lines).strip()
    return text if not title or re.search(r"(?m)^#\s+", text) else f"# {title}\n\n{text}"


@F.pandas_udf(StringType())
def to_markdown(html: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([markdown_of(h, t or "") for h, t in zip(html, title, strict=True)])
