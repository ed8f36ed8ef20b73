"""Item samples, prefixes, tiers and fused payloads on small cases."""

from pyspark.sql import functions as F

from plumbline.operators import context, ranking, store

CHUNK = "doc_id long, ord int, title string, file_title string, lang string, content string"


def samples(spark, rows, **kw):
    return {r.doc_id: r.sample for r in context.item_context(spark.createDataFrame(rows, CHUNK), "doc_id", "ord", **kw).collect()}


def test_item_samples(spark):
    plain = "nothing but plain words"
    rows = [(1, i, "f", "f", "zh", plain) for i in range(20)]
    rows[4] = (1, 4, "chapter", "f", "zh", "the model RS-12 is here")
    rows[7] = (1, 7, "chapter", "f", "mixed", plain)
    rows[16] = (1, 16, "chapter", "f", "zh", "too late: RS-99 again")
    rows += [(2, 0, None, "f", None, "short"), (2, 1, "t", "f", "zh", " "), (2, 2, "t", "f", "zh", "tiny"), (3, 0, "t", "f", "zh", None)]
    rows += [(4, 0, "t", "f", "zh", "x" * 3000), (4, 1, "t", "f", "zh", "never seen at all")]
    got = samples(spark, rows)
    assert got[1] == f"[切片]-1-{plain}\n\n[切片]-2-{plain}\n\n[切片]-5-the model RS-12 is here"
    assert got[2] == "[切片]-1-short\n\n[切片]-3-tiny" and 3 not in got
    assert got[4] == ("[切片]-1-" + "x" * 3000)[:2500]
    assert samples(spark, rows, k=1)[1] == "[切片]-5-the model RS-12 is here"
    assert samples(spark, rows, most=30)[1] == f"[切片]-1-{plain}"[:30]


def test_prefix_and_sample(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(context.context_prefix(F.lit('\n "“a "b" c”」 ')) ) == 'a "b" c' and one(context.context_prefix(F.lit(None).cast("string"))) == ""
    assert len(one(context.context_prefix(F.lit("x" * 500)))) == 150 and len(one(context.content_sample(F.lit("x" * 900)))) == 800


def test_child_of_another_item_before_a_parent_of_the_item(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "query_id long, id string, mine boolean")
    children = rows((1, "c1", True), (1, "c2", False), (2, "c3", False))
    above = rows((1, "p1", True), (2, "p2", True), (3, "p3", True), (3, "p4", False), (4, "p5", False))
    got = sorted((r.query_id, r.id, r.tier) for r in store.fallback(children, above, F.col("mine")).collect())
    assert got == [(1, "c1", 1), (2, "c3", 2), (3, "p3", 3), (4, "p5", 4)]


def test_payload_of_the_first_leg(spark):
    legs = spark.createDataFrame([(1, "kg", 1, 7, "from kg"), (1, "hyde", 2, 7, "second"), (1, "hyde", 1, 8, "only"), (1, "vector", 3, 7, "first"), (1, "kg", 2, None, "none"), (1, "web", 1, 9, "no leg")], "query_id long, leg string, rank int, id long, content string")
    got = {r.id: (r.rank, r.content) for r in ranking.fused(legs, payload=("content",)).collect()}
    assert got == {7: (1, "first"), 8: (2, "only")}
