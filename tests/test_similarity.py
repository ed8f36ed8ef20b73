"""The prefix join against all pairs, the boilerplate rule, cross-document ratios, and health of documents."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import cleaning, similarity


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_pairs_against_all_pairs(spark, threshold):
    random.seed(int(threshold * 100))
    sets = []
    for _ in range(40):  # variants of one set, all with the member "common"
        base = random.sample([f"m{i}" for i in range(60)], random.randint(1, 25))
        sets += [{"common", *random.sample(base, max(1, len(base) - random.randint(0, 4))), *random.sample(["x", "y", "z"], random.randint(0, 2))} for _ in range(3)]
    sets += [set(), {"common"}, {"common"}, {"alone"}]
    left = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "a long, items array<string>").repartition(3)
    want = {(i, j): (len(a & b), jaccard(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and jaccard(a, b) >= threshold}
    got = {(r.a, r.b): (r.common, r.similarity) for r in similarity.similar_pairs(left, None, threshold).collect()}
    assert got == want and want
    other = [set(random.sample(sorted(s | {"w"}), max(1, len(s) - 1))) for s in sets[::2]]
    right = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(other)], "b long, items array<string>")
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(other) if jaccard(a, b) >= threshold}
    assert {(r.a, r.b) for r in similarity.similar_pairs(left, right, threshold).collect()} == want
    assert similarity.similar_pairs(left.limit(0), right, threshold).count() == 0


def test_one_common_member_sends_few_rows(spark):
    """All sets hold one member, which then lies in no prefix: nothing meets."""
    left = spark.createDataFrame([(i, ["common", *(f"s{i}x{k}" for k in range(4)), f"g{i // 2}"]) for i in range(2000)], "a long, items array<string>")
    grams = left.select("a", F.size("items").alias("n"), F.explode(F.transform("items", lambda x: F.xxhash64(x))).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
    assert similarity._prefix(grams, often, "a", 0.6).count() == 0
    assert similarity.similar_pairs(left, None, 0.6).count() == 0
    assert similarity.similar_pairs(left, None, 0.2).count() == 1000  # g0, g0 and common of ten members


def test_threshold_is_checked(spark):
    left = spark.createDataFrame([(1, ["a"])], "a long, items array<string>")
    for bad in (0, -1, 1.1):
        with pytest.raises(ValueError):
            similarity.similar_pairs(left, None, bad)


SAFETY, OWN = "请勿将本产品置于儿童可触及之处以免发生危险", "型号说明与本机按键功能介绍第{}章内容各不相同{}"


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ord int, text string")


def acts(df):
    return {(r.doc_id, r.ord): (r.action, r.lang) for r in df.collect()}


def test_boilerplate_from_the_third_document_on(spark):
    rows = [(d, 0, SAFETY + "。") for d in range(1, 5)] + [(d, 1, OWN.format(chr(0x4E00 + 7 * d), chr(0x5E00 + 9 * d) * 9)) for d in range(1, 5)]
    rows += [(5, 0, SAFETY + "3")]  # digits do not count for shingles; the only chunk of its document
    rows += [(6, 0, SAFETY[:-4]), (6, 1, "第六章完全不同的另外一段文字内容")]  # most of the shingles
    got = acts(cleaning.cleaned(chunk_rows(spark, rows)))
    assert [got[d, 0][0] for d in (1, 2, 3, 4)] == ["keep", "keep", "drop_boilerplate", "drop_boilerplate"]
    assert all(got[d, 1] == ("keep", "main") for d in (1, 2, 3, 4))
    assert got[5, 0] == ("fallback", None) and got[6, 0][0] == "drop_boilerplate" and got[6, 1][0] == "keep"
    off = acts(cleaning.cleaned(chunk_rows(spark, rows), boilerplate=None))
    assert "drop_boilerplate" not in {a for a, _ in off.values()}
    more = acts(cleaning.cleaned(chunk_rows(spark, rows), docs=3))
    assert [more[d, 0][0] for d in (3, 4)] == ["keep", "drop_boilerplate"]


def test_short_and_long_chunks_are_no_boilerplate(spark):
    short = "安全第一"  # under 20 characters: never told to the store
    long = "".join(chr(0x4E00 + k) for k in range(200))  # a sample of 24 is under 0.6 of 193 shingles
    rows = [(d, k, t) for d in range(1, 6) for k, t in enumerate((short, long))]
    assert {a for a, _ in acts(cleaning.cleaned(chunk_rows(spark, rows))).values()} == {"keep"}


def test_compared_form_keeps_symbols_and_strips_the_listed(spark):
    form = lambda t, **kw: spark.range(1).select(T.compared_form(F.lit(t), **kw)).first()[0]
    assert form("a=b < $3½ 。、“x”—_/\\|+*#@&%", digits=True) == "a=b<$3½x" and form("a=b < $3½٣ ,.") == "a=b<$½"


def test_ratio_against_all_pairs(spark):
    random.seed(21)
    base = ["".join(random.choice("abcdefgh ") for _ in range(40)) for _ in range(6)]
    rows = []
    for d in range(14):
        for o in range(random.randint(1, 6)):
            t = list(random.choice(base))
            for _ in range(random.choice([0, 0, 1, 3])):
                t[random.randrange(len(t))] = random.choice("xyz")
            rows.append((d, o, random.choice(["".join(t), "".join(t).replace(" ", "  "), "", "abc"])))
    sets = [(d, {s[i : i + 8] for i in range(len(s) - 7)} or ({s} if s else set())) for d, _, t in rows for s in ["".join(t.split())]]
    want = {}
    for d, s in sets:
        n, pairs = want.get(d, (0, 0))
        want[d] = (n + 1, pairs + len({e for e, t in sets if e != d and jaccard(s, t) >= 0.6}))
    got = {r.doc_id: (r.chunks, r.pairs) for r in cleaning.repeated_elsewhere(chunk_rows(spark, rows)).collect()}
    assert got == want and any(p for _, p in want.values())


def test_health_of_titles(spark):
    rows = [(1, 0, "guide", "guide ", "字" * 90), (1, 1, "guide", "章节-2", "字" * 90 + "......"), (1, 2, "guide", None, "english only"), (2, 0, "a-1", "a-1", "字" * 100)]
    got = {r.doc_id: r for r in cleaning.health(spark.createDataFrame(rows, "doc_id long, ord int, file_title string, title string, text string")).collect()}
    assert (got[1].n, got[1].median, got[1].longest) == (3, 90, 96)
    assert (got[1].hard_split, got[1].no_title, got[1].fragments, got[1].low_script, got[1].contents) == (0.333333, 0.333333, 0.333333, 0.333333, 0.333333)
    assert got[1].faults == "hard_split,no_title,fragments,low_script,contents,repeated" and got[1].repeated == 0.333333
    assert got[2].faults == "no_title,repeated" and got[2].hard_split == 0


def test_similar_texts_against_all_pairs(spark):
    """Only the first runs of a text are sent; texts that differ at either end, in the middle or in length are found all the same."""
    random.seed(5)
    base = ["".join(random.choice("abcdefgh") for _ in range(size)) for size in (3, 9, 12, 30, 120, 400)]
    texts = {t for b in base for t in (b, b[: len(b) * 3 // 4], b[2:], b + b[:5], b[: len(b) // 2] + "x" + b[len(b) // 2 :], b[::-1])}
    rows = list(enumerate(sorted(texts)))
    sets = {i: {t[k : k + 8] for k in range(len(t) - 7)} or {t} for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.6}
    got = similarity.similar_texts(spark.createDataFrame(rows, "id long, text string").repartition(3), 0.6).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and want


def test_few_meetings_by_chance_are_written(spark):
    """Long texts of a small vocabulary share runs with many others; only the few that share several in a bucket are paired, and no like pair is lost."""
    random.seed(6)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    made = ["".join(random.choice(words) for _ in range(60)) for _ in range(300)]
    made += [t[:150] + "zz" + t[152:] for t in made[:40]]
    rows = list(enumerate(made))
    sets = {i: {t[k : k + 8] for k in range(len(t) - 7)} for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.6}
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    often = spark.sparkContext.broadcast(np.full(similarity.COUNTERS, 2, np.uint16))
    packs = texts.select("id", "text").mapInArrow(similarity._prefixes(often, 8, 0.6, 8), "bucket int, ids binary, sizes binary, at binary, grams binary")
    sent = packs.agg(F.sum(F.length("ids") + F.length("sizes") + F.length("at") + F.length("grams")), F.sum(F.length("at") / 2)).first()
    assert sent[0] < 8 * sent[1] + 12 * 8 * len(rows)  # eight bytes a run at most, and twelve a text and bucket
    met = packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(similarity._meetings(0.6, 8), "a long, b long").distinct().collect()
    assert want <= {(r.a, r.b) for r in met} and len(met) < 300 * 299 / 8
    assert {(r.a, r.b) for r in similarity.similar_texts(texts, 0.6).collect()} == want and len(want) >= 40


def test_indexes_parted_by_sizes_lose_no_pair(spark, monkeypatch):
    """Runs that a text sends do not grow with the data: indexes that are too large are parted by sizes, and equal sizes by ids."""
    random.seed(8)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    made = ["".join(random.choice(words) for _ in range(random.choice([2, 5, 9, 30, 60, 60]))) for _ in range(200)]
    made += [t[: len(t) * k // 10] + "zz" + t[len(t) * k // 10 + 2 :] for t in made[:80] for k in (5, 9)] + [t[: len(t) * 7 // 10] for t in made[:40]]
    rows = list(enumerate(sorted(set(made))))
    sets = {i: {t[k : k + 8] for k in range(len(t) - 7)} or {t} for i, t in rows}
    want = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.6}
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    monkeypatch.setattr(similarity, "INDEXED", 100)
    assert {(r.a, r.b) for r in similarity.similar_texts(texts, 0.6).collect()} == want and len(want) > 100
    sizes = np.array([similarity._first(np.array([len(s)]), 0.6, 16)[1][0] for s in sets.values()])
    groups = similarity._groups(np.bincount(similarity._bin(np.array([len(s) for s in sets.values()])), sizes, similarity.SIZES).astype(int), 1600)
    assert len(groups) > 4 and max(parts for *_, parts in groups) > 1
    # what is sent of a text to one group is bounded, whatever the number of groups
    probe, index = similarity._first(np.array([300]), 0.6, similarity.BUCKETS)
    assert probe[0] <= 300 * 0.4 + 30 and index[0] <= 300 * 0.25 + 30


def test_packs_of_many_groups_are_sent_before_they_fill_a_worker(monkeypatch):
    random.seed(12)
    made = sorted({"".join(random.choice("abcd") for _ in range(size)) for size in range(20, 220)})
    made += [t[:-1] + "z" for t in made]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(made))), pa.array(made)], names=["id", "text"])
    often = SimpleNamespace(value=np.full(similarity.COUNTERS, 2, np.uint16))
    groups = [(0, 180, 0, 1), (180, 220, 0, 2), (180, 220, 1, 2), (220, similarity.SIZES, 0, 1)]

    def met(packed, cut):
        monkeypatch.setattr(similarity, "PACKED", packed), monkeypatch.setattr(similarity, "CUT", cut)
        rows = list(similarity._prefixes(often, 8, 0.6, 16, groups)(iter([batch])))
        ordered = sorted(rows, key=lambda r: (r.column(0)[0].as_py(), r.column(2)[0].as_py()))
        return max(len(r.column(3)[0].as_py()) // 2 for r in rows), sorted(tuple(r.values()) for b in similarity._meetings(0.6, 16, True)(iter(ordered)) for r in b.to_pylist())

    (most, whole), (few, parts) = met(1 << 21, 1 << 20), met(300, 500)
    assert whole == parts and whole and few < most / 3
