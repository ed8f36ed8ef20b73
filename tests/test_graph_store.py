"""Clustered edges, seeds by rare grams, and equal questions answered once, against plain joins."""

import random

from pyspark.sql import functions as F

from plumbline.operators import graph
from plumbline.plans import graph_queries

ASK, NAME = "query_id long, item string, asked string", "item string, name string"


def asked_and_names():
    random.seed(51)
    word = lambda n: "".join(random.choice("abAB é漢#") for _ in range(n))
    names = [(random.choice("xyz"), word(random.choice([1, 2, 3, 5, 9]))) for _ in range(300)] + [("x", ""), ("y", "ab"), ("z", "İx")]
    asks = [(i, random.choice("xyzw"), word(random.choice([0, 1, 2, 3, 4, 12]))) for i in range(200)] + [(i, *random.choice(names)) for i in range(200, 240)]
    return asks, names


def test_near_pairs_against_all_pairs(spark):
    asks, names = asked_and_names()
    low = lambda t: t.lower()
    want = {(q, i, a, n) for q, i, a in asks for j, n in set(names) if i == j and a and n and (low(a) in low(n) or low(n) in low(a))}
    pairs = graph.near_pairs(spark.createDataFrame(asks, ASK), spark.createDataFrame(names, NAME)).collect()
    assert {(p.query_id, p.item, p.asked, p.name) for p in pairs if p.fits} == want and want
    assert len({(p.query_id, p.item, p.asked, p.name) for p in pairs}) == len(pairs)


def test_few_pairs_are_verified(spark):
    names = spark.range(3000).select(F.lit("x").alias("item"), F.format_string("Supplier#%06d", "id").alias("name"))
    asks = spark.range(0, 3000, 10).select(F.col("id").alias("query_id"), F.lit("x").alias("item"), F.format_string("r#%06d", "id").alias("asked"))
    n, fits = graph.near_pairs(asks, names).agg(F.count("*"), F.count_if("fits")).first()
    assert fits == 300 and n < 0.05 * 300 * 3000


def edges(spark):
    random.seed(52)
    rows = [(random.choice("xyz"), f"n{random.randrange(30)}", random.choice(["HAS", "USES"]), f"n{random.randrange(30)}") for _ in range(400)]
    rows += [(random.choice("xyz"), f"n{random.randrange(30)}", graph.MENTION, f"c{random.randrange(50)}") for _ in range(500)]
    return spark.createDataFrame(rows, "item string, head string, kind string, tail string").repartition(3)


def test_store_gives_the_same_hops_and_evidence(spark):
    e = edges(spark)
    store = graph.stored(e)
    seeds = spark.createDataFrame([(q, random.choice("xyz"), f"n{random.randrange(35)}") for q in range(40) for _ in range(3)], "query_id long, item string, name string").distinct()
    seeds = spark.createDataFrame(seeds.collect(), seeds.schema)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(graph.one_hop(seeds, store)) == rows(graph.one_hop(seeds, e.distinct()))
    hops = graph.one_hop(seeds, store)
    weights = graph.node_weights(seeds, hops)
    assert rows(graph.chunk_evidence(weights, store)) == rows(graph.chunk_evidence(weights, e.distinct()))
    assert rows(store.names) == rows(e.where(F.col("kind") == graph.MENTION).select("item", F.col("head").alias("name")).distinct())


def test_edges_are_not_shuffled(spark):
    store = graph.stored(edges(spark), 6)
    seeds = spark.createDataFrame([(1, "x", "n1")], "query_id long, item string, seed string").hint("merge")
    for side, end in ((store.out, "head"), (store.back, "tail")):
        plan = seeds.join(side, (seeds["item"] == side["item"]) & (seeds["seed"] == side[end]))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # the seeds' own


def test_equal_questions_are_answered_once(spark):
    asked = spark.createDataFrame([(5, "x", "a"), (5, "x", "b"), (3, "x", "b"), (3, "x", "a"), (3, "x", "a"), (9, "x", "a"), (1, "y", "a")], ASK)
    firsts, members = graph.once(asked)
    assert sorted(map(tuple, firsts.collect())) == [(1, "y", "a"), (3, "x", "a"), (3, "x", "b"), (9, "x", "a")]
    out = graph.for_all(firsts.select("query_id", F.lit(1).alias("v")).distinct(), members)
    assert sorted(map(tuple, out.collect())) == [(1, 1), (3, 1), (5, 1), (9, 1)] and out.columns == ["query_id", "v"]


def test_counts_of_the_pass_that_writes(spark):
    rows = [(1, ["a", "b"], ["r"], None), (2, None, None, None), (3, ["x"], ["y"], "boom"), (4, [], ["p", "q"], None)]
    df = spark.createDataFrame(rows, "chunk_id long, entities array<string>, relations array<string>, error string").repartition(3)
    kept, counts = graph.built(df)
    assert counts == graph.Built(4, 3, 1, 2, 3) and kept.count() == 3 and counts.summary().startswith("3 of 4")
    assert graph.built(df.limit(0))[1] == graph.Built(0, 0, 0, 0, 0)


def test_evidence_by_classes_of_chunks(spark):
    """Questions about one item meet classes of chunks, those about several the mentions: both give what all mentions give; repeats count once."""
    random.seed(53)
    mentions = [(random.choice("xy"), f"n{random.randrange(6)}", f"c{random.randrange(90):02d}") for _ in range(500)]
    weights = [(q, item, f"n{k}", random.choice([1.0, 2.0])) for q in range(12) for item in ("x", "y")[q % 2 : 1 + q % 2 + (q % 3 == 0)] for k in random.sample(range(6), 3)]
    want = set()
    for q in {w[0] for w in weights}:
        found = {}
        for _, item, name, weight in (w for w in weights if w[0] == q):
            for i, n, c in set(mentions):
                if (i, n) == (item, name):
                    score, entities = found.get(c, (0.0, 0))
                    found[c] = (score + weight, entities + 1)
        order = sorted(((s, e, c) for c, (s, e) in found.items()), reverse=True)[:7]
        want |= {(q, c, s, e, r) for r, (s, e, c) in enumerate(order, 1)}
    w = spark.createDataFrame(weights, "query_id long, item string, name string, weight double")
    m = spark.createDataFrame(mentions, "item string, name string, chunk_id string").repartition(3)
    got = graph.mention_evidence(w, m, 7).select("query_id", "chunk_id", "score", "entities", "rank").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len({q for q, *_ in want}) == 12


def test_broadcasts_are_bounded_by_counted_rows(spark, sf, monkeypatch, tmp_path):
    """What the driver holds does not grow with parts, suppliers or the grams of names, however small their files are."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    facts = plan(graph_queries._facts(spark, sf))
    assert facts.count("BroadcastHashJoin") == 3
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 1)
    for df in (graph_queries._facts(spark, sf), graph_queries._relations(spark, sf)):
        assert plan(df).count("BroadcastHashJoin") == 1 and plan(df).count("SortMergeJoin") == 2  # nations only
    asks, names = asked_and_names()
    for name, rows, shape in (("asked", asks, ASK), ("names", names, NAME)):
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}")
    asked, names = spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/names")
    # the questions' side of each of three joins may be broadcast, as may the pairs that met, but nothing with a row for every gram
    lines = [x for x in plan(graph.near_pairs(asked, names)).splitlines() if "BroadcastHashJoin" in x and "gram" in x]
    assert not lines
