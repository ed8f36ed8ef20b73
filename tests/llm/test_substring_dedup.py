"""Substring dedup: kept words against counted windows, automata against counted strings, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import ODD, none, odd  # noqa: F401

from plumbline.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_windows(rows, length):
    """Per row (id, n_words, n_removed, kept)."""
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for (key, _), w in zip(rows, texts) if key is not None for i in range(len(w) - length + 1))
    out = []
    for (key, _), w in zip(rows, texts):
        gone = {j for i in range(len(w) - length + 1) if key is not None and seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((key, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def kept(df, **options):
    return sorted(map(tuple, sd.without_shared(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"crowded": 2, "slice_rows": 3, "shard_words": 200}, {"crowded": 10_000, "slice_rows": 2, "shard_words": 50}])
def test_kept_words_against_windows(spark, options):
    random.seed(13)
    length, gram = (35, 8) if not options else (9, 3)
    pool = [f"w{i}" for i in range(40)] + ["é", "漢", "x\x85y"]
    passage = lambda n: [random.choice(pool) for _ in range(n)]
    shared = [passage(n) for n in (length - 1, length, length + 1, 3 * length, 8 * length)]
    hot = passage(gram + 1)
    rows = []
    for i in range(150):
        parts = []
        for _ in range(random.randint(0, 4)):
            parts += random.choice([*shared, hot, passage(random.randint(0, 3 * length))]) if random.random() < 0.7 else passage(length)
        rows.append((i, random.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(500 + i, rows[3 * i][1]) for i in range(20)] + [(600 + i, " ".join(shared[4] + [f"end{i}"])) for i in range(30)]
    rows += [(700, "a " * 200), (701, "a b " * 100), (702, "  "), (703, None), (704, "x " * (length - 1)), (705, "y " * length), (706, "z " * (length + 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert kept(df, length=length, gram=gram, **options) == by_windows(rows, length)


def test_one_passage_in_all_documents(spark):
    """A minimizer of all documents has many slices; one with as many surroundings as documents is dealt out by windows."""
    random.seed(14)
    same = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {same} c{i} d{i % 3} " + " ".join(f"t{j}" for j in range(12)) + f" n{i} " + " ".join(f"u{j}" for j in range(12))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for options in ({"slice_rows": 16, "crowded": 8, "shard_words": 100}, {"slice_rows": 1}):
        assert kept(df, **options) == by_windows(rows, 35)


def test_automaton_against_counts():
    random.seed(15)
    for _ in range(60):
        texts = [[random.choice("abc") for _ in range(random.randint(0, 12))] for _ in range(random.randint(0, 8))]
        times = [random.randint(1, 3) for _ in texts]
        seen = Counter()
        for t, n in zip(texts, times):
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    seen[tuple(t[i:j])] += n
        automaton = sd.SuffixAutomaton()
        for t, n in zip(texts, times):
            automaton.add(t, n)
        least = random.randint(1, 4)
        automaton.finish(least)
        assert len(automaton.length) <= 2 * sum(map(len, texts)) + 1
        probe = [random.choice("abcd") for _ in range(30)]
        for text in (*texts, probe):
            want = [max((n for n in range(1, e + 1) if seen[tuple(text[e - n : e])] >= least), default=0) for e in range(1, len(text) + 1)]
            assert list(automaton.statistics(text)) == want
            covered = {k for e, n in enumerate(want, 1) if n >= 3 for k in range(e - n, e)}
            assert {k for a, b in automaton.spans(text, 3) for k in range(a, b)} == covered


def test_segments_cover_every_window_once():
    random.seed(16)
    texts = [" ".join(random.choice(["a", "b", "cc", "ddd"]) for _ in range(random.choice([0, 5, 6, 7, 40, 200]))) for _ in range(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    for length, gram in ((6, 3), (6, 6), (7, 1), (35, 8)):
        row, first, span, key, _ = sd.cut(data, offsets, length, gram)
        windows = sorted((r, i) for r, a, n in zip(row.tolist(), first.tolist(), span.tolist()) for i in range(a, a + n))
        assert windows == [(r, i) for r, t in enumerate(texts) for i in range(len(t.split()) - length + 1)]
        by = {}
        for r, a, n, k in zip(row.tolist(), first.tolist(), span.tolist(), key.tolist()):
            for i in range(a, a + n):
                assert by.setdefault(tuple(texts[r].split()[i : i + length]), k) == k  # a window's words tell its minimizer


def test_odd_rows(spark, odd, none):  # noqa: F811
    want = by_windows([(i, t) for i, t, *_ in ODD], 35)
    assert kept(odd) == want and sd.without_shared(none).count() == 0
    assert [w[2] for w in want if w[0] in (1, 2)] == [45, 45, 45] and next(w for w in want if w[0] is None)[2] == 0
    same, own = " ".join(f"p{i}" for i in range(40)), " ".join(f"q{i}" for i in range(50))
    rows = [(1, same), (2, own), (2, f"{same} x"), (2, None), (3, own + " z"), (None, same)]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == by_windows(rows, 35)
