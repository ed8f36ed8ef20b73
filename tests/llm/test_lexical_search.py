"""Ranked lexical search: results against all scores, trees against maxima, ties, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from test_llm_operators import ODD, UPPER, none, odd  # noqa: F401

from plumbline.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def by_all_scores(docs, items, k=20):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = {}
    for i, ask in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in ask if t in df}
        scores = []
        for d, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // max(1, total)
            if s := sum(w * ask[t] * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, w in weight.items() if c[t]):
                scores.append((-s, d))
        out[i] = [(r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return {i: rows for i, rows in out.items() if rows}


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.item_id, r.rank)):
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return out


def frame(spark, rows, name, parts=5):
    return spark.createDataFrame(rows, f"{name} long, text string").repartition(parts)


def test_hits_against_all_scores(spark):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "漢字", "É1", "x_y", "the"]
    text = lambda n: " ".join(random.choice(vocabulary[: random.choice([5, 60, 305])]) for _ in range(n))
    docs = [(i, text(random.choice([0, 1, 5, 40, 300]))) for i in range(400)]
    docs += [(1000 + i, docs[7 * i % 90][1]) for i in range(200)] + [(5000 + i, "same words the same") for i in range(150)] + [(9000, None)]
    items = [(i, text(random.choice([0, 1, 4, 25]))) for i in range(50)] + [(60, "same"), (61, "the THE The"), (62, None), (63, "nowhere1"), (64, "same words"), (64, "w1 w2")]
    want = by_all_scores(docs, items)
    df, ask = frame(spark, docs, "doc_id"), frame(spark, items, "item_id", 2)
    for size, bytes_, questions in ((ls.BLOCK_DOCS, ls.BLOCK_BYTES, 1024), (37, 4000, 7), (1, 1, 1000)):
        index = ls.indexed(df, block_docs=size, block_bytes=bytes_)
        assert found(ls.ranked(index, ask).collect()) == want
        hits = ls.block_hits(index, ask, questions=questions).collect()
        best = {}
        for h in sorted(hits, key=lambda h: (-h.score, h.id)):
            best.setdefault(h.item, []).append((h.id, h.score))
        assert {i: [x[1:] for x in rows] for i, rows in want.items()} == {i: rows[:20] for i, rows in best.items()}
    assert found(ls.ranked(index, ask, k=3).collect()) == by_all_scores(docs, items, 3)


def test_wide_questions_shuffled(spark, monkeypatch):
    random.seed(3)
    docs = [(i, " ".join(f"t{random.randrange(80)}" for _ in range(30))) for i in range(90)]
    items = [(i, " ".join(f"t{random.randrange(90)}" for _ in range(12))) for i in range(30)]
    monkeypatch.setattr(ls, "BROADCAST_ROWS", 0)
    index = ls.indexed(frame(spark, docs, "doc_id"))
    assert found(ls.ranked(index, frame(spark, items, "item_id")).collect()) == by_all_scores(docs, items)


def test_trees_hold_the_largest_of_each_range():
    random.seed(4)
    texts = [" ".join(random.choice(["a", "b", "c", f"r{i % 50}"]) for _ in range(random.randint(0, 30))) for i in range(2500)]
    names, x = ls.block_index(pa.array(texts), 2500, 30_000)
    at, inner = np.concatenate([[0], np.cumsum(x["n"])]), 0
    for i, name in enumerate(names.to_pylist()):
        doc, part = x["doc"][at[i] : at[i + 1]], x["part"][at[i] : at[i + 1]]
        assert doc.tolist() == [d for d, t in enumerate(texts) if name in t.split()]
        for level, count in enumerate(x["levels"][:, i], 1):
            nodes, tops = x["node"][inner : inner + count], x["top"][inner : inner + count]
            inner += count
            want = {}
            for d, p in zip(doc.tolist(), part.tolist(), strict=True):
                want[d // ls.FAN**level] = max(want.get(d // ls.FAN**level, 0), p)
            assert dict(zip(nodes.tolist(), tops.tolist(), strict=True)) == (want if x["n"][i] > ls.FAN else {})


def test_search_opens_few_nodes_and_ties_in_order():
    rng = np.random.default_rng(5)
    size, height = 20_000, ls.height_of(20_000)
    empty = np.zeros(0, np.uint16).tobytes()

    def tree(docs, parts):
        return ls.Tree(docs.astype(np.uint16).tobytes(), parts.astype(np.int32).tobytes(), [], empty, empty, height)

    flat, rare = tree(np.arange(size), np.full(size, 1000)), tree(np.sort(rng.choice(size, 40, False)), rng.integers(1, 900_000, 40))
    got, opened = ls.search([(3, flat), (9000, rare)], height, 20)
    score = np.full(size, 3000)
    score[rare.levels[0][0]] += 9000 * rare.levels[0][1]
    assert got == [(int(score[p]), int(p)) for p in np.lexsort((np.arange(size), -score))[:20]] and opened < 45
    # all documents tie: the first ones are given, one branch is opened
    got, opened = ls.search([(3, flat)], height, 20)
    assert got == [(3000, p) for p in range(20)] and opened == height
    assert ls.search([(3, tree(np.array([7]), np.array([5])))], height, 20)[0] == [(15, 7)]


def test_odd_rows(spark, odd, none):  # noqa: F811
    index, items = ls.indexed(odd), [(1, "cat dog"), (2, "word5x5 Wörtern"), (3, "漢字"), (None, "cat"), (4, ""), (5, "id")]
    got = found(ls.ranked(index, frame(spark, items, "item_id")).collect())
    want = by_all_scores([(i, t) for i, t, *_ in ODD], items)
    assert got == want and set(want) == {1, 2, 3}
    empty = ls.indexed(none)
    assert (empty.n_docs, empty.n_terms) == (0, 0) and ls.ranked(empty, frame(spark, items, "item_id")).count() == 0
    assert ls.ranked(index, frame(spark, items, "item_id").limit(0)).count() == 0
    blank = ls.indexed(frame(spark, [(1, " .. "), (2, None)], "doc_id"))
    assert ls.ranked(blank, frame(spark, items, "item_id")).count() == 0
