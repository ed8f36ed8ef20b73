"""Runs of characters in numpy against sets of strings, and the queries that use them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import grams
from plumbline.functions import text as T
from plumbline.operators import cleaning
from plumbline.plans import text_queries
from plumbline.sources import scratch

WIDE = "".join(chr(0x4E00 + i) for i in range(3000)) + "".join(chr(0x1F300 + i) for i in range(200))


def runs(text, n=8):
    return {text[i : i + n] for i in range(len(text) - n + 1)} or ({text} if text else set())


@pytest.mark.parametrize("alphabet", ["ab", "aé€😀Z ", WIDE])
def test_runs_against_sets(alphabet):
    random.seed(len(alphabet))
    texts = ["", "a", "abcdefg", *("".join(random.choice(alphabet) for _ in range(random.choice([7, 8, 9, 40, 4000]))) for _ in range(30))]
    texts += [texts[-1][: len(texts[-1]) // 2] + texts[-2]]
    for n in (2, 5, 8):
        for a in texts:
            want = sorted(runs(a, n), key=lambda s: s.encode())
            assert grams.least(a, n, 24) == (len(want), want[:24])
            assert grams.sample(a, n, 24) == want[:24] and grams.sample(a, n, 2) == want[:2]
            assert grams.bounded(a, 40, n, 24) == ((len(want), want) if len(want) <= 40 else (41, want[:24]))
            assert grams.hashes(a, n).size == len(want)
            for b in random.sample(texts, 5):
                assert grams.common(a, b, n) == (len(runs(a, n) & runs(b, n)), len(runs(a, n)), len(runs(b, n)))
                assert len(set(grams.hashes(a, n)) & set(grams.hashes(b, n))) == len(runs(a, n) & runs(b, n))
    assert grams.least(None) == (0, []) and grams.common(None, "abc") == (0, 0, 1)


def written(tmp_path) -> int:
    return sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))


@pytest.fixture
def shared(tmp_path, monkeypatch):
    """A shared folder of one test's own."""
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    return tmp_path


def test_neighbours_hand_on_texts(spark, sf, shared):
    """What is written for o52 is no larger than the texts; shingles were eight times as large."""
    text_queries.o52_neighbour_jaccard(spark, sf).collect()
    size = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < written(shared) < size


def test_sketches_are_made_once(spark, shared):
    """The plan that pairs sketches reads written ones; before, every use of them cut the texts again."""
    rows = [(i, f"the same sentence with another tail {chr(97 + i % 3) * (i % 4)}") for i in range(8)]
    near = cleaning.sketch_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), 0.6)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "UDF" not in plan
    sets = {i: set(sorted(runs("".join(t.split())))[:24]) for i, t in rows}
    want = {i: sum(j != i and len(s & t) / len(s | t) >= 0.6 for j, t in sets.items()) for i, s in sets.items()}
    assert {r.doc_id: r.others for r in near.collect()} == {i: n for i, n in want.items() if n}


def test_compared_form_is_the_pattern(spark):
    """The characters that are taken out are those of the pattern; a pattern took over four times as long."""
    texts = ["".join(map(chr, range(0x2100))), "".join(map(chr, range(0x2FF0, 0x3100))) + "，。、０１９" + chr(0x1D7CE) + "a😀b", "", None, " a\u200bb\x1c\ufeff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.regexp_replace("t", T.UNCOMPARED, "")
    got = df.select(T.compared_form(F.col("t")), T.compared_form(F.col("t"), digits=True), T.without_blanks(F.col("t"))).collect()
    want = df.select(F.regexp_replace(bare, r"\p{Nd}", ""), bare, F.regexp_replace("t", T.BLANKS, "")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    plan = df.select(T.compared_form(F.col("t"), digits=True))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


def test_pairs_of_sketches_are_sought_once(spark, shared):
    """The prefixes that meet and the pairs are written; before, each side of the join and of the union made them anew."""
    rows = [(i, f"the same sentence with another tail {chr(97 + i % 3) * (i % 4)}") for i in range(8)]
    near = cleaning.sketch_neighbours(spark.createDataFrame(rows, "doc_id long, text string"), 0.6)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and list(shared.rglob("prefix/*.parquet"))


def test_store_keeps_few_runs_of_long_lines(spark, shared):
    """Lines of over 40 runs hand on 24; before, all handed on 40 and their number, found by a sort of all runs."""
    random.seed(7)
    long = ["".join(random.choice("abcdefghij") for _ in range(500)) for _ in range(2)]
    rows = [(d, o, long[o], True) for d in range(3) for o in range(2)]
    rows += [(d, 2, "a short line that some have", True) for d in range(3)]
    chunks = spark.createDataFrame(rows, "doc_id long, ord int, text string, told boolean")
    assert [tuple(r) for r in cleaning.boilerplate_chunks(chunks).collect()] == [(2, 2)]
    cut = spark.read.parquet(*(str(p) for p in shared.rglob("cut") if p.is_dir())).agg(F.max(F.size("sample")), F.count("items")).first()
    assert tuple(cut) == (24, 3)
    g = spark.createDataFrame([(long[0],)], "t string").select(grams.bounded_of(F.col("t"), 40).alias("g")).first().g
    assert (g["size"], len(g["sample"])) == (41, 24)


def test_least_of_texts(spark):
    texts = [("",), ("abc",), (None,), ("b" * 9 + "a" * 9,)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(grams.least_of(F.col("t"))).collect()]
    assert [(r.size, list(r.sample)) for r in got] == [(0, []), (1, ["abc"]), (0, []), (9, sorted(runs("b" * 9 + "a" * 9)))]


def test_cascade_cuts_lines_once(spark, shared):
    """What joins the marks of boilerplate reads written rows; before, it cut and sorted all lines again for every use."""
    rows = [(d, o, f"the same line {o} of so many documents, as it stands") for d in range(5) for o in range(3)]
    done = cleaning.cleaned(spark.createDataFrame(rows, "doc_id long, ord int, text string"), script="[a-z]")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "UDF" not in plan
    assert {(r.doc_id, r.action) for r in done.collect()} == {(0, "keep"), (1, "keep"), *((d, "fallback") for d in (2, 3, 4))}


def test_sets_and_likeness_of_many_texts_at_once():
    """Runs of all texts are cut in one pass, none across two texts, and similarities of pairs are those of the pairs alone."""
    random.seed(9)
    texts = ["".join(random.choice("abé😀") for _ in range(random.choice([0, 2, 8, 9, 60]))) for _ in range(80)]
    for n in (1, 3, 8):
        owner, h = grams.sets(texts, n)
        want = [len({t[i : i + n] for i in range(len(t) - n + 1)}) or int(t != "") for t in texts]
        assert np.bincount(owner, minlength=len(texts)).tolist() == want and (np.diff(owner) >= 0).all()
        a, b = texts, texts[::-1]
        alone = [c / (p + q - c) if p and q else 0.0 for c, p, q in (grams.common(x, y, n) for x, y in zip(a, b, strict=True))]
        assert grams.alike(a, b, 0.6, n) == alone == grams.alike(a, b, 0.6, n, 100)
    assert grams.sets([], 8)[0].size == 0 and grams.alike([None, ""], ["abc", None], 0.6) == [0.0, 0.0]
