"""Exact segments, held-out areas, and odd rows of the operators on pages and of the pipeline."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import LONG, ODD, SHAPE

from plumbline.llm import minhash_dedup, suffix_dedup, toxicity, url_filters
from plumbline.llm.shared import table


def test_segments_are_exactly_the_maximal_ones():
    random.seed(71)
    for _ in range(400):
        n = random.randint(1, 30)
        at = sorted(random.sample(range(n), random.randint(0, n)))
        weight = [random.choice([0.15, 0.3, 1.0, 2.0]) + random.random() / 1000 for _ in at]  # no ties
        score = [-toxicity.DRIFT] * n
        for i, w in zip(at, weight):
            score[i] += w

        def best(lo, hi):
            found = max(((sum(score[i:j]), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
            return [] if found[0] <= 1e-12 else [*best(lo, found[1]), (found[1], found[2] - 1, found[0]), *best(found[2], hi)]

        got, want = toxicity.segments(at, weight), best(0, n)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


@pytest.mark.parametrize("size, least", [("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_toxicity_area(spark, size, least):
    path = f"/root/testdata/{size}"
    labels = {r.doc_id: r.toxic for r in table(spark, path, "labels", "doc_id", "toxic").collect()}
    held = [r for r in toxicity.op7_toxicity(spark, path).collect() if r.held_out and r.doc_id in labels]
    bad, good = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    assert sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good)) >= least


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in ("id", "host", "path", "r", "ruled", "s", "i", "run", "key", "times", "piece", "n", "kept", "chunk", "payload", "digest", "record", "at", "bytes", "rank")})


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://a.net/x", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (None, "http://b.org/fr/", None), (4, "", ""), (4, "", "")]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    lines = lambda df: sorted(map(str, df.collect()))
    assert lines(url_filters.judged(clashing(plain))) == lines(url_filters.judged(plain)) and len(rows) == url_filters.judged(plain).count()


def test_pipeline_with_long_texts_and_clashing_columns(spark, sf):
    docs = clashing(spark.createDataFrame(ODD, SHAPE)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        left = {r.doc_id: r.text for r in out.collect()}
        assert left[6] == LONG and None in left and left[4] == "", name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == len(ODD)


def chain(n, words=60, step=3, seed=0):
    """Texts of which each is like the next only: a window that moves over a long row of words."""
    rng = random.Random(seed)
    row = [f"c{seed}w{rng.randrange(10**9)}" for _ in range(words + step * n)]
    return [" ".join(row[step * i : step * i + words]) for i in range(n)]


@pytest.mark.parametrize("whole", [0, 5, minhash_dedup.WHOLE])
def test_chained_near_copies(spark, whole):
    """Large groups are compared by buckets, small ones whole: the classes are those of all pairs."""
    from test_llm_operators import classes

    random.seed(72)
    texts = chain(60, seed=1) + chain(25, step=7, seed=2) + chain(10, step=30, seed=3)
    texts += [" ".join(w if random.random() > 0.04 else f"z{random.randrange(50)}" for w in t.split()) for t in texts[::3]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, k=2, whole=whole).collect()}
    assert got == classes(rows, 2)


def test_only_what_may_repeat_is_built_into_a_transform(monkeypatch):
    """Of segments that share a minimizer only, nothing enters the transform; of others the stretch of windows that occur again."""
    rng = np.random.default_rng(3)
    noise = lambda n: rng.integers(32, 127, n, dtype=np.uint8).tobytes()
    gram, shared = noise(32), noise(120)
    pieces = [noise(50) + gram + noise(50) for _ in range(40)] + [noise(20) + shared, shared + noise(30), b"", noise(99)]
    piece, first, last = suffix_dedup.candidates(pieces, 100)
    assert (piece.tolist(), first.tolist(), last.tolist()) == ([40, 41], [20, 0], [40, 20])
    built = []
    whole = suffix_dedup.transform
    monkeypatch.setattr(suffix_dedup, "transform", lambda some, cap: built.extend(some) or whole(some, cap))
    n = len(pieces)
    rows = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array(range(n)), pa.array([5] * n), pa.array(pieces, pa.binary()), pa.array([False] * n)], names=["key", "id", "start", "content", "again"])
    out = [r for b in suffix_dedup._compared(100)(iter([rows])) for r in b.to_pylist()]
    assert out == [{"id": 41, "start": 5, "span": 21}] and built == [shared, shared]
