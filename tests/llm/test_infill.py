"""Fill-in-middle: cuts against lists of units, exact round trips, odd rows."""

import hashlib
import random
import re

import pytest
from test_llm_operators import ODD, none, odd  # noqa: F401

from plumbline.llm import infill

#: Units as patterns, matched left to right.
PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[\t-\r ]*[^\t-\r ]+[\t-\r ]*|[\t-\r ]+", "chars": r"[\s\S]"}


def by_lists(id_, text, unit, rate=100, spm=50, seed=7, sentinels=infill.SENTINELS):
    units = re.findall(PATTERNS[unit], text)
    digest = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    before, middle, after = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    p, s, m = sentinels
    out = (s + after + p + before + m + middle) if h[3] % 100 < spm else (p + before + s + after + m + middle)
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(before), len(middle), out


@pytest.mark.parametrize("unit", sorted(PATTERNS))
def test_cuts_against_lists(spark, unit):
    random.seed(12)
    texts = ["".join(random.choice("ab é漢🙂\n\n\t <PSM>") for _ in range(random.randint(0, 40))) for _ in range(400)]
    texts += ["\n", "\n\n", " a", "a ", "  ", "a<P>b", "<S", "a<P\n>b", "<<S>>", "x" * 50_000 + "\n" * 50_000 + "y z", "\r\n \x85\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for rate, spm in ((100, 50), (60, 20)):
        rows = infill.restored(infill.infilled(df, unit=unit, rate=rate, spm=spm)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert tuple(r)[1:6] == by_lists(r.doc_id, texts[r.doc_id], unit, rate, spm) and r.restored == texts[r.doc_id]
        assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_query_restores_every_text(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in infill.op12_fill_in_middle(spark, sf).collect():
        n, form, before, middle, out = by_lists(r.doc_id, texts[r.doc_id], "lines")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert tuple(r)[1:] == (n, form, before, middle, sha(out), sha(texts[r.doc_id]))


def test_odd_rows(odd, none):  # noqa: F811
    rows = infill.restored(infill.infilled(odd)).collect()
    assert sorted((str(r.doc_id), r.restored) for r in rows) == sorted((str(i), t or "") for i, t, *_ in ODD)
    assert all(tuple(r)[1:6] == by_lists(r.doc_id, r.restored, "lines") for r in rows)
    assert {(r.n, r.form, r.prefix_chars) for r in rows if r.doc_id in (3, 4)} == {(0, "plain", None)}
    assert infill.restored(infill.infilled(none)).count() == 0


def test_other_sentinels_and_faults(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\n"), (2, "x\x00y"), (3, "<P>\n<S>\n")], "doc_id long, text string")
    marks = ("\x00pre\x01", "\x00suf\x01", "\x00mid\x01")
    rows = {r.doc_id: r for r in infill.restored(infill.infilled(df, sentinels=marks), marks).collect()}
    assert [rows[i].restored for i in (1, 2, 3)] == ["a\nb\nc\n", "x\x00y", "<P>\n<S>\n"] and rows[3].form != "plain"
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P>x", "<M>"), ("a<S>b", "<S>", "<M>"), ("\n", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.infilled(df, sentinels=bad)
    with pytest.raises(ValueError):
        infill.infilled(df, unit="pages")
    with pytest.raises(ValueError):
        infill.restore("psm", "no parts here")
