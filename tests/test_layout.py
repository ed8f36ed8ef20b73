from pyspark.sql import functions as F

from plumbline.operators import layout


def test_headings_take_lines_once():
    md = "Safety notes\ntext\nSafety-notes\n# Done\nSafety notes\n" + "x" * 61
    assert layout.with_headings(md, [(1, "Safety notes"), (2, "Safety notes"), (3, "Safety notes"), (1, "Done"), (1, "x" * 61)]).split("\n")[:5] == ["# Safety notes", "text", "### Safety-notes", "# Done", "## Safety notes"]


def test_restored_only_where_missing(spark):
    docs = spark.createDataFrame([(1, "Intro\ntext"), (2, "# Intro\nPart\n"), (3, "none")], "doc_id int, md string")
    heads = spark.createDataFrame([(1, 0, 1, "Intro"), (2, 0, 2, "Part")], "doc_id int, ord int, level int, text string")
    got = {r.doc_id: r.md for r in layout.restored(docs, heads).collect()}
    assert got == {1: "# Intro\ntext", 2: "# Intro\nPart\n", 3: "none"}


def test_image_context(spark):
    md = "# H\nfar away\n\nnear one\nnear two\n\n![a](p.png)\n\nafter\n## Next\nother ![b](p.png) ![c](q.png)"
    got = {r.name: (r.heading, r.before, r.after) for r in layout.images(spark.createDataFrame([(1, md), (2, None)], "doc_id int, md string")).collect()}
    assert got == {"p.png": ("# H", "far away\nnear one near two", "after"), "q.png": ("## Next", "", "")}
    assert layout.image_context("a" * 150 + "\n\n" + "b" * 150 + "\n\n![x](i)")[0]["before"] == "b" * 150


def test_valid_chunks(spark):
    rows = spark.createDataFrame([(0, None, " a ", None), (1, "c", "b", "own"), (2, "d", "  ", "x")], "ord int, chunk_id string, content string, item string")
    got = [tuple(r) for r in layout.valid_chunks(rows, F.lit("doc item")).orderBy("ord").collect()]
    assert got == [(0, "kg_chunk_temp_0", "a", "doc item"), (1, "c", "b", "own")]
