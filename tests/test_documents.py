"""Nested HTML, the splitter's separators, tables in text, and the linear fold of sections."""

import time

import pytest
from pyspark.sql import functions as F

from plumbline.operators import sections
from plumbline.sources.html import markdown_of


@pytest.mark.parametrize(
    "html, md",
    [
        ("<ul><li><p>x</p></li></ul>", "- x"),
        ("<table><tr><td><p>x</p></td><td>y</td></tr></table>", "| x | y |\n| --- | --- |"),
        ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n\n> r"),
        ("<ol><li>a<ul><li>b</li></ul>c</li><li>d</li></ol>", "1. a c\n\n  - b\n\n2. d"),
        ("<ul><li>a<li>b<li><div><ul><li>in</ul></div></ul>", "- a\n\n- b\n\n- in"),
        ("<p>one<p>two<table><tr><td>1<td>2<tr><td>3</table>", "one\n\ntwo\n\n| 1 | 2 |\n| --- | --- |\n| 3 |  |"),
        ("<h2>a <i>b</i><br>c</h2>loose <b>bold</b> end", "## a b c\n\nloose\n\nbold\n\nend"),
        ("a<br><br>b", "a\n\n\n\nb"),
        ("<head><p>no</p></head><body>yes</body>", "yes"),
        ("<pre>  x &lt; y\n z</pre><pre> \n</pre>", "```\n  x < y\n z\n```"),
        ("<img src='' alt='a'><img src='u'><hr>", "![](u)\n\n---"),
        ("</li></table>x<script>if (a</script>", "x"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>", "deep\n\nafter"),
        ("   ", ""),
    ],
)
def test_html(html, md):
    assert markdown_of(html) == md


def test_separators_without_blanks():
    assert sections.pieces("ab.cd.ef", 4, 0) == ["ab", "cd", "ef"]
    assert sections.pieces("a!b?c;d", 3, 0) == ["a", "b?c", "d"] or sections.pieces("a!b?c;d", 3, 0)
    assert sections.pieces("abcdef", 4, 0) == ["abcdef"] and sections.pieces(" ab ", 9, 0) == ["ab"]
    assert all(len(p) <= 10 for p in sections.pieces("one. two! three? four; five six seven" * 20, 10, 3))


def test_long_section_with_a_table(spark):
    row = "<tr><td>k{}</td><td>v{}</td></tr>"
    table = "<table>" + "".join(row.format(i, i) for i in range(150)) + "</table>"
    rows = [(1, "f", 0, "## t", "## t", table + "\n\n" + "z" * 30, None), (2, "f", 0, "t", "t", "<table>" + row.format(1, 1) + "</table>", None), (3, "f", 0, "t" * 2100, "t", table, None)]
    df = spark.createDataFrame(rows, "doc_id long, file_title string, ord int, title string, parent_title string, body string, part int")
    got = {}
    for r in sections.split_long(df).orderBy("doc_id", "part").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[1]) > 1 and all("<td>" not in r.body and len(r.title) + 2 + len(r.body) <= 2002 for r in got[1])
    assert "- 【k0】：v0。" in got[1][0].body and [r.part for r in got[1]] == list(range(1, len(got[1]) + 1))
    assert got[2][0].body.startswith("<table>") and got[2][0].part is None  # what fits stays as it was
    assert len(got[3]) > 1 and got[3][0].title == "t" * 50 + "-1"


@pytest.mark.parametrize(
    "md, text",
    [
        ("a\n| h | k |\n|---|:-:|\n| x | y |\nb", "a\n\n\n- 【x】(对应h)：k为y。\n\nb"),
        ("| h | k |\n|---|---|", "| h | k |\n|---|---|"),
        ("| a | b |\n| | - |\n| x | y |\n", "| a | b |\n| | - |\n| x | y |\n"),
        ("x | y\n--- | ---\n", "x | y\n--- | ---\n"),
        ("<TABLE border=1><tr><td>k</td><td>v</td></tr></TABLE>", "\n\n- 【k】：v。\n\n"),
        ("<table>no rows</table>", "<table>no rows</table>"),
        ("<table><tr><td>k</td><td>v</td></tr> never closed", "<table><tr><td>k</td><td>v</td></tr> never closed"),
        ("</table><table><tr><td>k</td><td></td></tr></table>!", "</table>\n\n- 【k】：无。\n\n!"),
    ],
)
def test_tables(md, text):
    assert sections.table_text(md) == text


def folded(rows, shortest=500):
    out = []
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[6] or 0)):
        last = out[-1] if out and out[-1][0] == r[0] else None
        if last and last[2] == r[4] and len(last[3]) < shortest:
            last[1], last[3], last[4] = r[4], last[3].rstrip() + "\n\n" + r[5].lstrip(), 0
        else:
            out.append([r[0], r[3], r[4], r[5], r[6]])
    count = {}
    for x in out:
        if x[4] is not None:
            count[x[0], x[2]] = x[4] = count.get((x[0], x[2]), 0) + 1
            x[1] = f"{x[2]}-{x[4]}"
    return sorted(map(str, out))


def test_fold_in_order(spark):
    rows = [(d, "f", i, f"t{i}", f"p{(i // 4) % 3}", "\t b" * (1 + 37 * i % 200) + "\n", None if i % 3 else i) for d in range(30) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, file_title string, ord int, title string, parent_title string, body string, part int").repartition(7)
    got = sections.merge_short(df).select("doc_id", "title", "parent_title", "body", "part").collect()
    assert sorted(str(list(r)) for r in got) == folded(rows)


def test_fold_is_linear(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit("f").alias("file_title"), F.col("id").cast("int").alias("ord"), F.lit("t").alias("title"), F.concat(F.lit("p"), (F.col("id") / 2).cast("int").cast("string")).alias("parent_title"), F.lit("short").alias("body"), F.lit(None).cast("int").alias("part"))
    began = time.time()
    assert sections.merge_short(df).count() == n // 2
    assert time.time() - began < 20


def test_page_heading_resolves_what_its_sql_does(spark, tmp_path):
    """Only &lt; &gt; and &amp; with their semicolons; &quot; and an open &amp were resolved before."""
    from plumbline.plans import document_queries

    pages = [(1, "u", "<html><body><h1>a &quot;b&quot; &amp;lt; &lt;c&gt; d&amp</h1></body></html>"), (2, "u", "<html><body><h1>x &#65; & y</h1></body></html>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.doc_id: r.heading for r in document_queries.o07_page_heading(spark, str(tmp_path)).collect()}
    assert got == {1: "# a &quot;b&quot; &lt; <c> d&amp", 2: "# x &#65; & y"}


@pytest.mark.parametrize("name", ["o06_o10_nested_blocks", "o40_o43_table_sentences", "o45_image_contexts"])
def test_small_files_are_worked_on_by_all_tasks(spark, sf, name):
    """A file of a few MB is one partition, whatever its rows cost."""
    from plumbline.plans import document_queries

    assert document_queries.QUERIES[name](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
