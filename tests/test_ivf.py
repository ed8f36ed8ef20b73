"""Inverted lists: every row indexed, recall against exact search, exactness when all lists are probed."""

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import ivf, search
from plumbline.plans import search_queries
from plumbline.sources.scratch import Scratch


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    found = search_queries.o80_o112_ivf_topk(spark, d)
    exact = search_queries.o112_dense_topk(spark, d)
    assert ivf.recall(found, exact) >= 0.9 and found.count() == exact.count()


def test_all_lists_probed_is_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(500)] + [(900 + i, [1.0] * 8) for i in range(9)] + [(990, [0.0] * 8), (None, [1.0] * 8), (991, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    index = ivf.indexed(df, 10, sample=100)
    assert index.rows.count() == 510 and len(index.centroids) == 10
    good = df.where("id is not null and vector is not null")
    q = good.where("id % 50 = 0 or id > 895")
    every = sorted(map(tuple, ivf.hits(index, q, 4, probes=10).collect()))
    assert every == sorted(map(tuple, search.dense_hits(q, good, 4).collect()))
    some = ivf.hits(index, q, 4, probes=2)
    assert 0.3 < ivf.recall(some, search.dense_hits(q, good, 4)) <= 1
    assert ivf.hits(index, q.limit(0)).count() == 0
    index.drop()


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    index = ivf.indexed(df, 64)
    assert [(r.query_id, r.id) for r in ivf.hits(index, df, 1).orderBy("query_id").collect()] == [(1, 1), (2, 2)]
    none = ivf.indexed(df.limit(0), 4)
    assert none.rows.count() == 0 and ivf.hits(none, df.limit(0)).count() == 0


def test_k_means_finds_groups():
    rng = np.random.default_rng(7)
    ends = np.eye(6)
    x = np.repeat(ends, 50, axis=0) + rng.normal(scale=0.05, size=(300, 6))
    best = ivf.k_means(x, 6, seed=3) @ ends.T
    assert (np.sort(best.max(1)) > 0.7).all()


def test_vector_hits_against_all_products(spark, monkeypatch):
    """Packs of queries and rows, more than one of each: the same hits as all products; none without a shared token, ties to the smaller id."""
    random.seed(71)
    vectors = {i: {random.randrange(40): random.choice([0.25, 0.5, 1.0]) for _ in range(random.randint(1, 9))} for i in range(150)}
    vectors[150] = {99: 1.0}
    monkeypatch.setattr(search, "PACK", 2000)
    monkeypatch.setattr(search, "ASKED", 3)
    rows = spark.createDataFrame([(i, list(v), list(v.values())) for i, v in vectors.items()], "id long, tokens array<int>, weights array<double>").repartition(3)
    got = search.vector_hits(rows.where("id % 10 = 0"), rows, Scratch(spark, "test"), 4).collect()
    want = set()
    for q in range(0, 151, 10):
        scores = {i: sum(w * vectors[q].get(t, 0) for t, w in v.items()) for i, v in vectors.items()}
        best = sorted((-s, i) for i, s in scores.items() if s > 0)[:4]
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_weighted_rounds_halves_as_doubles(spark):
    hits = spark.createDataFrame([(1, 2, 0.371946)], "query_id long, id long, score double")
    assert search.weighted(hits, hits.limit(0)).first().score == 0.342987
