"""Hand-made cases for single operators."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import cleaning, context, graph, models, ranking, search, sections, store
from plumbline.sources.html import markdown_of


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("scores", "kept"),
    [([0.9, 0.85, 0.8, 0.1, 0.05], 3), ([0.9, 0.2, 0.15, 0.1], 3), ([0.9, 0.85, 0.8, 0.75, 0.7], 5), ([3.0], 1), ([5.0 - i * 0.01 for i in range(14)], 10), ([1.0, None, 0.9, 0.8], 4)],
)
def test_cliff(spark, scores, kept):
    rows = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate(scores)], "query_id int, rank int, score double")
    assert ranking.cliff_cut(rows).count() == kept


def test_fusion_weights_ties_and_missing_ids(spark):
    legs = spark.createDataFrame([(1, "vector", 1, "a"), (1, "hyde", 1, "b"), (1, "kg", 1, "c"), (1, "kg", 2, "a"), (1, "vector", 2, None)], "query_id int, leg string, rank int, id string")
    got = [(r.id, r.score) for r in ranking.fused(legs).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["a", "b", "c"] and got[0][1] == pytest.approx(1 / 61 + 0.7 / 62, abs=1e-9) and got[2][1] == pytest.approx(0.7 / 61, abs=1e-9)
    assert ranking.fused(legs, top=1).count() == 1 and ranking.fused(legs, top=0).count() == 3


def test_gate(spark):
    ranked = spark.createDataFrame([(1, 1, 3.0), (2, 1, 1.0), (3, 1, -0.5), (4, 1, None)], "query_id int, rank int, score double")
    got = {r.query_id: r.decision for r in ranking.gated(spark.createDataFrame([(i,) for i in range(1, 6)], "query_id int"), ranked).collect()}
    assert got == {1: "answer", 2: "notice", 3: "fallback", 4: "fallback", 5: "fallback"}


def test_metrics(spark):
    cases = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"])], "query_id int, expected array<string>")
    ranked = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "a"), (2, 1, "x")], "query_id int, rank int, id string")
    got = {r.query_id: r for r in ranking.metrics(cases, ranked).collect()}
    assert (got[1].hit_1, got[1].hit_3, got[1].recall_3, got[1].mrr) == (0, 1, 1, 0.5) and 0 < got[1].ndcg < 1
    assert (got[2].hit_5, got[2].mrr, got[2].ndcg) == (0, 0, 0)


def test_text_functions(spark):
    assert one(spark, T.item_key(F.lit("A　b  C\n"))) == "abc" and one(spark, T.squeezed(F.lit(" a \n b "))) == "a b"
    assert one(spark, T.script_ratio(F.lit("中文ab "))) == 0.5 and one(spark, T.script_ratio(F.lit("  "))) == 0
    assert one(spark, T.char_shingles(F.lit("abcabcab"), 3)) == ["abc", "bca", "cab"] and one(spark, T.char_shingles(F.lit("ab"), 3)) == ["ab"] and one(spark, T.char_shingles(F.lit(""), 3)) == []
    assert one(spark, T.without_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(spark, T.without_fence(F.lit("x"))) == "x"
    assert one(spark, T.hard_split_rate(F.lit(""))) == 0 and one(spark, T.hard_split_rate(F.lit("a\nb"))) == 1 and one(spark, T.hard_split_rate(F.lit("# a\nb"))) == 0
    assert one(spark, T.blob_sha1(F.lit("hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, T.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0
    assert [one(spark, T.route(F.lit(p))) for p in ("x/a.PDF", "b.txt", "c.htm", "d.docx", "e.exe")] == ["pdf", "md", "html", "docx", None]


def test_cleaning_cascade(spark):
    long = "这是一段足够长的中文文本用来检查重复行的规则是否有效"
    rows = [(1, 0, long), (1, 1, long + "。"), (1, 2, " "), (1, 3, "目录......3"), (1, 4, "plain english only"), (2, 0, "english"), (2, 1, "")]
    got = {(r.doc_id, r.ord): (r.action, r.lang) for r in cleaning.cleaned(spark.createDataFrame(rows, "doc_id int, ord int, text string")).collect()}
    assert [got[1, i] for i in range(5)] == [("keep", "main"), ("drop_repeat", None), ("drop_short", None), ("drop_contents", None), ("drop_script", None)]
    assert got[2, 0] == got[2, 1] == ("fallback", None)


def test_item_buckets_and_gap(spark):
    rows = [("a", "a", 0.95), ("a", "x", 0.9), ("b", "x", 0.8), ("b", "y", 0.65), ("c", "x", 0.9), ("c", "y", 0.8), ("c", "z", 0.75), ("c", "w", 0.7), ("d", "x", 0.65), ("d", "y", 0.5), ("e", "x", 0.3)]
    df = spark.createDataFrame(rows, "name string, item string, score double")
    got = {r.name: (r.confirmed, r.options) for r in context.buckets(df).collect()}
    assert got == {"a": ("a", ""), "b": ("x", ""), "c": (None, "x|y|z"), "d": (None, "x"), "e": (None, "")}
    gap = spark.createDataFrame([("q", "A", 0.92), ("q", "B", 0.88), ("q", "C", 0.66)], "name string, item string, score double")
    assert sorted(r.item for r in context.within_gap(gap, "name").collect()) == ["A", "B"]


def test_budget_and_history(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["aaaa", "bbbb", "cccccccccc", "d"])], "k int, n int, text string")
    assert [r.n for r in context.within_budget(rows, "k", "n", F.length("text") + 2, F.lit(15)).orderBy("n").collect()] == [0, 1]
    assert [(r.n, r.place) for r in context.recent(rows, "k", "n", 2).orderBy("n").collect()] == [(2, 1), (3, 2)]
    assert one(spark, context.citation(F.lit(1), source=F.lit("web"), chunk_id=F.lit(None).cast("string"))) == "[1] [source=web]"


def test_graph_small(spark):
    edges = spark.createDataFrame([("i", "A", "HAS_PART", "B"), ("i", "A", "MENTIONED_IN", "c1"), ("i", "B", "MENTIONED_IN", "c1"), ("i", "B", "MENTIONED_IN", "c2"), ("i", "Lone", "MENTIONED_IN", "c9")], "item string, head string, kind string, tail string")
    nodes = edges.where("kind = 'MENTIONED_IN'").select("item", F.col("head").alias("name")).distinct()
    asked = spark.createDataFrame([(1, "i", "A"), (2, "i", "Lone"), (3, "i", "on")], "query_id int, item string, asked string")
    s = graph.seeds(asked, nodes)
    assert {(r.query_id, r["name"], r.how) for r in s.collect()} == {(1, "A", "exact"), (2, "Lone", "exact"), (3, "Lone", "fuzzy")}
    hops = graph.one_hop(s, edges)
    ranked = graph.chunk_evidence(graph.node_weights(s, hops), edges).collect()
    assert {(r.query_id, r.chunk_id, r.score, r.rank) for r in ranked} == {(1, "c1", 3.0, 1), (1, "c2", 1.0, 2)}


def test_store(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, store.replaced(old, spark.createDataFrame([("a", 9)], "k string, v int"), "k").collect())) == [("a", 9), ("b", 3)]
    assert sorted(map(tuple, store.upserted(old.where("v > 1"), spark.createDataFrame([("b", 7)], "k string, v int"), "k").collect())) == [("a", 2), ("b", 7)]
    tiers = [spark.createDataFrame([(1, "x")], "query_id int, id string"), spark.createDataFrame([(1, "y"), (2, "z")], "query_id int, id string")]
    assert {tuple(r) for r in store.first_with_rows(tiers).collect()} == {(1, "x", 1), (2, "z", 2)}


def test_dense_hits_ties_and_zero_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "id long, vector array<float>")
    got = [(r.id, r.score) for r in search.dense_hits(rows.where("id = 1"), rows, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (3, 0.0)]


def test_sections_and_chunks(spark):
    md = "intro\n# One\ntext\n```\n# no heading\n```\n### Deep\nmore\n## Two\n" + ("long sentence. " * 300) + "\n# Last\nend"
    docs = spark.createDataFrame([(1, "file", md), (2, "bare", "just text"), (3, "none", "")], "doc_id int, file_title string, md string")
    rows = sections.headed(docs).where("doc_id = 1").orderBy("ord").collect()
    assert [(r.title, r.parent_title) for r in rows] == [("file", "file"), ("# One", "# One"), ("### Deep", "# One"), ("## Two", "# One"), ("# Last", "# Last")]
    assert "# no heading" in rows[1].body
    cut = sections.split_long(sections.headed(docs)).where("doc_id = 1 and part is not null").collect()
    assert len(cut) > 1 and all(len(r.title) + 2 + len(r.body) <= sections.LONGEST + 4 for r in cut)
    made = sections.chunks(docs)
    assert {r.doc_id for r in made.collect()} == {1, 2}
    kids = sections.children(made.select("doc_id", "title", "content")).collect()
    assert all(len(r.child_content) <= sections.CHILD for r in kids)


def test_splitter_and_tables():
    assert sections.pieces("a b c d", 3, 1) == ["a b", "b c", "c d"] and sections.pieces("x" * 20, 5, 1) == ["x" * 20] and sections.pieces("", 5, 1) == []
    text = sections.table_text("before\n| name | size |\n|---|---|\n| bolt | 3 |\n| nut | - |\nafter")
    assert text == "before\n\n\n- 【bolt】(对应name)：size为3。\n- 【nut】\n\nafter"
    spans = "<table><tr><th></th><th>a</th><th></th></tr><tr><td rowspan=2>x<br>y</td><td colspan=2>1</td></tr><tr><td>2</td><td>-</td></tr></table>"
    assert sections.table_text(spans) == "\n\n- 【x y】：a为1，属性2为1。\n- 【x y】：a为2。\n\n"
    assert sections.table_text("<table><tr><td>k</td><td>v</td></tr><tr><td></td><td>w</td></tr></table>") == "\n\n- 【k】：v。\n- 【未知属性】：w。\n\n"
    assert sections.table_text("| no | rule |\n| a | b |") == "| no | rule |\n| a | b |"
    assert sections.sentences([["k", "v"], ["", "w"], ["", ""]], False) == ["- 【k】：v。", "- 【未知属性】：w。"]


def test_image_links(spark):
    md = F.lit("![x](a/P.png) ![y](b.png)")
    assert one(spark, sections.linked_images(md, F.lit("p.png"), F.lit("cap $1"), F.lit("u"))) == "![cap $1](u) ![y](b.png)"


def test_html():
    page = "<html><head><title>t</title></head><body><h2>Head</h2><p>One <b>bold</b> two<script>x()</script><ul><li>a<li>b</ul><ol><li>c</li></ol><table><tr><th>h</th><th>k</th></tr><tr><td>1</td></tr></table><pre>x\n y</pre><hr><img src='i.png' alt='pic'><img alt='no'><div>loose</div></body></html>"
    assert markdown_of(page, "T") == "# T\n\n## Head\n\nOne bold two\n\n- a\n\n- b\n\n1. c\n\n| h | k |\n| --- | --- |\n| 1 |  |\n\n```\nx\n y\n```\n\n---\n\n![pic](i.png)\n\nloose"
    assert markdown_of("") == "" and markdown_of(None) == "" and markdown_of("<h1>x", "T") == "# x"


def test_progress_over_several_files(spark, tmp_path):
    """A task that expires between two files keeps what it had finished."""
    from plumbline.plans.document_queries import stream_task_progress

    day = lambda n: f"2024-01-0{n} 00:00:00"
    for k, rows in enumerate(([(1, 7, "click", day(1))], [(2, 8, "view", day(3))], [(3, 8, "error", day(5))], [(4, 7, "view", day(7))])):
        df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
        df.withColumn("value", F.lit(1.0)).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = {r.task_id: (r.done, str(r.last_seen)) for r in stream_task_progress(spark, str(tmp_path)).collect()}
    assert got == {7: ("click,view", day(7)), 8: ("view", day(5))}


@pytest.mark.parametrize(
    ("reply", "options", "place"),
    [("第 2 个", ["a", "b"], 2), ("两", ["a", "b"], 2), ("第三款", ["a", "b"], None), ("5", ["x", "rs-5"], 2), ("RS 12", ["other", "the rs-12 meter"], 2), ("none", ["", "x"], None), ("", ["a"], None), ("第", ["a"], None)],
)
def test_chosen_option(spark, reply, options, place):
    keys = F.transform(F.array(*map(F.lit, options)), lambda x: T.option_key(x))
    assert one(spark, T.chosen(T.option_key(F.lit(reply)), keys)) == place


@pytest.mark.parametrize(
    ("question", "item", "bare"),
    [("how does rs -1 2 work", "RS-12", "how does work"), ("a+b (c) d", "A+B (C)", "d"), ("keep  this", "", "keep this"), ("a\\E. x", "\\e.", "a x"), ("(RS12 y", "rs12", "( y")],
)
def test_question_without_item(spark, question, item, bare):
    assert one(spark, T.without_item(F.lit(question), F.lit(item))) == bare


def test_extracted_items(spark):
    rows = [('```json\n{"item_names": ["a", "\u3000", 3], "rewritten_query": " q "}\n```', ["a"], "q"), ("{", [], "asked"), ("", [], "asked"), (None, [], "asked"), ("[1]", [], "asked"), ('{"item_names": {"a": 1}, "rewritten_query": null}', [], "asked")]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, reply string")
    names, question = T.extracted_items(F.col("reply"), F.lit("asked"))
    got = df.select("i", names.alias("n"), question.alias("q")).orderBy("i").collect()
    assert [(r.n, r.q) for r in got] == [r[1:] for r in rows]


def test_caps_of_seeds_and_triples(spark):
    asked = spark.createDataFrame([(1, f"i{k:02}", "n") for k in range(40)], "query_id int, item string, asked string")
    nodes = spark.createDataFrame([(f"i{k:02}", f"n{j}") for k in range(40) for j in range(4)], "item string, name string")
    got = graph.seeds(asked, nodes)
    assert got.count() == 30 and {r["item"] for r in got.collect()} == {f"i{k:02}" for k in range(10)}
    edges = spark.createDataFrame([("i00", "n0", "HAS_PART", "n1")] + [("i01", "n0", "HAS_PART", f"p{k:03}") for k in range(70)], "item string, head string, kind string, tail string")
    hops = graph.one_hop(got, edges).collect()
    assert len(hops) == 50 and sum(r["item"] == "i00" for r in hops) == 1  # once, though both of its ends are seeds


def test_clean_entities_keep_the_first(spark):
    rows = [(1, 1, " a ", "Part", " "), (1, 2, "a", "Part", "late"), (1, 3, "a", "Tool", "t"), (1, 4, "b", "Other", "x"), (1, 5, None, "Part", "x"), (1, 6, "x" * 20, "Part", None), (2, 1, "a", "Part", " d ")]
    df = spark.createDataFrame(rows, "chunk_id int, ord int, name string, label string, description string")
    got = sorted(tuple(r) for r in graph.clean_entities(df, ["Part", "Tool"]).collect())
    assert got == [(1, "a", "Part", None), (1, "a", "Tool", "t"), (1, "x" * 15, "Part", None), (2, "a", "Part", "d")]


def test_model_is_tried_again(spark):
    def load():
        calls = []

        def model(frame):
            calls.append(1)
            if frame.v.min() < 0 or len(calls) == 1:
                raise ValueError("no")
            return frame.assign(w=frame.v * 2)

        return model

    df = spark.createDataFrame([(1,), (2,), (-1,), (-2,)], "v int").coalesce(1)
    got = sorted(tuple(r) for r in models.applied(df, load, "w int", batch=2, delay=0.0, error="failed").collect())
    assert got == [(-2, None, "ValueError('no')"), (-1, None, "ValueError('no')"), (1, 2, None), (2, 4, None)]
