"""Exact set-similarity joins with prefix, length and position filters (AllPairs and PPJoin), as DataFrame joins.

Two sets with a Jaccard similarity of t or more share a member within their first n - ceil(t n) + 1 members, in
any order of all members. Members are ordered by the number of sets that hold them, the rarest first, so what
meets are rare members; of a member that all sets hold no row is sent unless a set has nothing rarer. Pairs that
meet are confirmed on the whole sets. Equal sets are best made one class first (see classes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grams
from ..functions.text import spread
from ..sources.scratch import Scratch

#: Counters of runs, and how many of them are one row when they are added up.
COUNTERS, RUN = 1 << 24, 1 << 12
#: Buckets of runs in each group of sizes, and the runs of an index that lie in one bucket.
BUCKETS, INDEXED = 16, 1 << 24
#: By how many more runs in one bucket than its first, over all buckets, like texts are known.
TOLD = 8
#: Sizes of texts are told apart by STEPS for each power of two, SIZES in all.
STEPS, SIZES = 32, 1024
#: Characters whose runs are cut at a time (or those of one text), runs of packs and meetings that are counted at a time (likewise).
CUT, PACKED, MET = 1 << 20, 1 << 21, 1 << 19
#: Texts of pairs that are broadcast by their ids.
FEW = 1_000_000


def classes(rows: DataFrame, items: str) -> tuple[DataFrame, DataFrame]:
    """rows with class (md5 of the sorted members) in place of items, and the classes with their items; empty sets have none."""
    known = rows.where(F.size(items) > 0).withColumn(items, F.array_sort(items))
    known = known.withColumn("class", F.md5(F.array_join(items, "\n").cast("binary")))
    return known.drop(items), known.select("class", items).dropDuplicates(["class"])


def _least(n: Column, threshold: float) -> Column:
    """ceil(threshold * n), on the safe side of rounding."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _prefix(grams: DataFrame, often: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, n, place, gram: the part of each set that must share a member with a similar set.

    Members that no other set holds come first of all in the order; they take places but send no rows.
    """
    known = grams.hint("merge").join(often, "gram")
    whole = Window.partitionBy(key)
    placed = known.withColumns({"m": F.count("*").over(whole), "r": F.row_number().over(whole.orderBy("sets", "gram"))})
    place = (F.col("n") - F.col("m") + F.col("r")).cast("int")
    return placed.select(key, "n", "gram", place.alias("place")).where(F.col("place") <= F.col("n") - _least(F.col("n"), threshold) + 1)


def similar_pairs(left: DataFrame, right: DataFrame | None, threshold: float, items: str = "items", left_key: str = "a", right_key: str = "b", made: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """left_key, right_key, common, similarity of all pairs with a Jaccard similarity of threshold (above 0) or more.

    items are arrays of distinct members, or what made turns into such (texts into shingles, say, so that only the
    texts of pairs that meet are carried); keys are unique. Without right, left is joined with itself: pairs have
    the smaller key first. Empty and null sets are similar to none.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is above 0 and at most 1")
    own = right is None

    def sized(df: DataFrame, key: str) -> DataFrame:
        hashed = df.select(key, F.transform(made(F.col(items)), lambda x: F.xxhash64(x)).alias("grams"))
        return hashed.select(key, F.size("grams").alias("n"), F.explode("grams").alias("gram"))

    a = sized(left, left_key)
    if own:
        b, right_key_of = a.withColumnRenamed(left_key, right_key), left.withColumnRenamed(left_key, right_key)
        often = a.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
    else:
        b, right_key_of = sized(right, right_key), right
        each = a.select("gram", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select("gram", F.lit(0).alias("l"), F.lit(1).alias("r")))
        often = each.groupBy("gram").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l > 0 and r > 0").select("gram", (F.col("l") + F.col("r")).alias("sets"))
    x = _prefix(a, often, left_key, threshold)
    if own:
        x = Scratch(left.sparkSession, "prefix").put(x, "prefix")  # both sides of the join read it
    y = (_prefix(b, often, right_key, threshold) if not own else x.withColumnRenamed(left_key, right_key)).withColumnsRenamed({"n": "n2", "place": "place2"})
    met = x.hint("merge").join(y, "gram")  # exploded rows look smaller to the planner than they are
    if own:
        met = met.where(F.col(left_key) < F.col(right_key))
    met = met.where((F.col("n2") >= _least(F.col("n"), threshold)) & (F.col("n") >= _least(F.col("n2"), threshold)))
    # what can still be common after this meeting place must make up the overlap that the threshold asks for
    rest = F.lit(1) + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    first = F.least("place", "place2") - 1  # members before it that may be common, too
    met = met.where(rest + first >= _least(F.col("n") + F.col("n2"), threshold / (1 + threshold)))
    pairs = met.select(left_key, right_key).distinct()
    full = pairs.hint("merge").join(left.select(left_key, F.col(items).alias("plumb_x")), left_key).hint("merge").join(right_key_of.select(right_key, F.col(items).alias("plumb_y")), right_key)
    full = full.select(left_key, right_key, made(F.col("plumb_x")).alias("plumb_x"), made(F.col("plumb_y")).alias("plumb_y"))
    common = F.size(F.array_intersect("plumb_x", "plumb_y"))
    counted = full.select(left_key, right_key, common.alias("common"), (F.size("plumb_x") + F.size("plumb_y")).alias("plumb_n"))
    return counted.select(left_key, right_key, "common", (F.col("common") / (F.col("plumb_n") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= threshold)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches in parts of at most 65,536 texts and about CUT characters, and the texts, which are the last column; null is empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        low = size = 0
        for i, t in enumerate(texts):
            if i > low and (size + len(t) > CUT or i - low == 65536):
                yield batch.slice(low, i - low), texts[low:i]
                low, size = i, 0
            size += len(t)
        if low < len(texts):
            yield batch.slice(low), texts[low:]


def _bin(n):
    """The step of a size of 1 or more."""
    return np.minimum(np.log2(np.maximum(n, 1)) * STEPS, SIZES - 1).astype(np.int64)


def _counted(n: int, threshold: float = 0.6, buckets: int = BUCKETS):
    """Texts to how many of them (15 at most) have a run of each counter, as rows of RUN counters, two in a byte; and as row -1 the runs that an index has of texts of each step of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(COUNTERS, np.int32), np.zeros(SIZES, np.int64)
        for _, texts in _blocks(batches):
            owner, h = grams.sets(texts, n)
            of = np.sort((h & np.uint64(COUNTERS - 1)).astype(np.uint32))
            new = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: of.size])
            counts[of[new]] += np.diff(np.append(new, of.size)).astype(np.int32)  # once a text
            size = np.bincount(owner, minlength=len(texts))
            np.add.at(sizes, _bin(size), np.minimum(_first(size, threshold, buckets)[1], size))
        parts = np.minimum(counts, 15).astype(np.uint8).reshape(-1, RUN)
        some = np.flatnonzero(parts.any(axis=1))
        told = [(parts[i, ::2] << 4 | parts[i, 1::2]).tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some)), pa.array([sizes.tobytes(), *told], pa.binary())], names=["run", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, counts) sorted by run, added up to 16 bits each; row -1 in full."""
    now, total = None, None
    packed = lambda: total.tobytes() if now < 0 else np.minimum(total, 65535).astype(np.uint16).tobytes()
    for batch in batches:
        done = []
        for run, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if run != now:
                done += [(now, packed())] if now is not None else []
                now, total = run, np.zeros(SIZES if run < 0 else RUN, np.int64)
            if run < 0:
                total += np.frombuffer(counts, np.int64)
                continue
            two = np.frombuffer(counts, np.uint8)
            total[::2] += two >> 4
            total[1::2] += two & 15
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([c for _, c in done], pa.binary())], names=["run", "counts"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([packed()], pa.binary())], names=["run", "counts"])


def _ceil(x: np.ndarray) -> np.ndarray:
    """The next whole number, on the safe side of rounding."""
    return np.ceil(x - 1e-9).astype(np.int64)


def _more(wanted, buckets: int):
    """How many runs beyond one a text's like has of its first runs, at least: as many more it sends."""
    return np.clip(wanted - 1, 0, buckets + TOLD)


def _first(n: np.ndarray, threshold: float, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """How many first runs of a text of n meet those of smaller texts (or as large ones), and how many wait for those of larger ones."""
    wanted = _ceil(threshold * n)
    more = _more(wanted, buckets)
    return n - wanted + more + 1, n - _ceil(2 * threshold / (1 + threshold) * n) + more + 1


def _groups(sizes: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """(from, to, part, parts): steps of sizes whose indexes have up to most runs together; a step with more is parted by ids."""
    out, low, held = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            out.append((low, i, max(1, -(-held // most))))
            low, held = i, 0
        held += size
    out.append((low, SIZES, max(1, -(-held // most))))
    return [(low, high, part, parts) for low, high, parts in out for part in range(parts)]


def _prefixes(shared, n: int, threshold: float, buckets: int, groups: list[tuple[int, int, int, int]] | None = None):
    """(id, text) to packs of (bucket, ids, sizes, at, grams): the first runs of texts, by the order of their counters.

    sizes begin with a byte: 0, runs that wait in an index of the group of their text's size; 1, runs that meet those, which
    go to every group with sizes of similar texts. A run is 28 bits of its hash in the bucket that others name; runs of a
    pack are sorted and told by their distances.
    """
    groups = groups or [(0, SIZES, 0, 1)]

    def packs(held: list[tuple[np.ndarray, ...]], kind: int, group: int) -> Iterator[pa.RecordBatch]:
        ids, sizes = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        at, h = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        held.clear()
        both = (h >> np.uint64(40)) % np.uint64(buckets) << np.uint64(44) | (h & np.uint64(2**28 - 1)) << np.uint64(16) | at.astype(np.uint64)
        del at, h
        both.sort()
        edges = np.searchsorted(both, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(44))
        for bucket in range(buckets):
            mine = both[edges[bucket] : edges[bucket + 1]] & np.uint64(2**44 - 1)
            if not mine.size:
                continue
            at_ = (mine & np.uint64(65535)).astype(np.int64)
            seen = np.zeros(ids.size, bool)
            seen[at_] = True
            far = np.diff(mine >> np.uint64(16), prepend=np.uint64(0))
            row = ids[seen].tobytes(), bytes([kind]) + sizes[seen].tobytes(), (np.cumsum(seen) - 1)[at_].astype(np.uint16).tobytes(), far.astype(np.uint16 if far.max() < 65536 else np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([group * buckets + bucket], pa.int32()), *(pa.array([b], pa.binary()) for b in row)], names=["bucket", "ids", "sizes", "at", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(2 * len(groups))]  # of each group and kind: ids, sizes, runs and their texts
        for batch, texts in _blocks(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, h = grams.sets(texts, n)
            size = np.bincount(owner, minlength=len(texts))
            met = often[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
            # by text and counter; equal counters stay in the order of the hashes
            order = owner.astype(np.uint64) << np.uint64(48) | met.astype(np.uint64) << np.uint64(32) | np.arange(h.size, dtype=np.uint64)
            order.sort()
            order = (order & np.uint64(2**32 - 1)).astype(np.int64)
            place = np.arange(h.size) - (np.cumsum(size) - size)[owner]
            probe, index = _first(size, threshold, buckets)
            some = np.flatnonzero((place < probe[owner]) & (met[order] > 1))  # what one text has meets nothing
            at, h, waits = owner[some], h[order[some]], place[some] < index[owner[some]]
            step, least, sizes = _bin(size), _bin(_ceil(threshold * size)), size.astype(np.int32)
            for group, (low, high, part, parts) in enumerate(groups):
                mine = (step >= low) & (step < high) & (ids % parts == part)
                for kind, (texts_, runs) in enumerate(((mine, waits), ((step >= low) & (least < high), True))):
                    of, which = held[2 * group + kind], texts_[at] & runs
                    if of and (sum(x[0].size for x in of) + int(texts_.sum()) > 65536 or sum(x[3].size for x in of) > PACKED):
                        yield from packs(of, kind, group)
                    if which.any():
                        of.append((ids[texts_], sizes[texts_], (np.cumsum(texts_) - 1)[at[which]] + sum(x[0].size for x in of), h[which]))
            size_of = [sum(x[3].size for x in of) for of in held]
            while sum(size_of) > 4 * PACKED:  # however many groups there are
                i = int(np.argmax(size_of))
                yield from packs(held[i], i % 2, i // 2)
                size_of[i] = 0
        for i, of in enumerate(held):
            if of:
                yield from packs(of, i % 2, i // 2)

    return run


def _meetings(threshold: float, buckets: int, ordered: bool = False):
    """Packs sorted by bucket to (a, b), a < b: texts that share two runs of a bucket, or one, where similar texts may share no two.

    ordered: packs of a bucket are sorted by sizes, too, so that an index lies whole before runs meet it and these pass by;
    and pairs come with more, how many runs beyond one they share, and need, how many similar texts share so over all buckets.
    """

    def read(ids: bytes, sizes: bytes, at: bytes, far: bytes) -> tuple[np.ndarray, ...]:
        gram = np.cumsum(np.frombuffer(far, np.uint16 if len(far) == len(at) else np.uint32), dtype=np.uint64)
        return np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int32, offset=1), np.frombuffer(at, np.uint16), gram << np.uint64(32)

    def built(packs: list[tuple]) -> tuple[np.ndarray, ...]:
        """ids and sizes by size, and (run, place of the text) in order."""
        ids, n = np.concatenate([p[0] for p in packs]), np.concatenate([p[1] for p in packs]).astype(np.int64)
        order = np.argsort(n, kind="stable")
        rank = np.empty(order.size, np.uint64)
        rank[order] = np.arange(order.size, dtype=np.uint64)
        runs, low, base = np.empty(sum(p[2].size for p in packs), np.uint64), 0, 0
        while packs:
            own, _, at, gram = packs.pop(0)
            runs[low : low + at.size] = gram | rank[base : base + own.size][at]
            low, base = low + at.size, base + own.size
        runs.sort()
        return ids[order], n[order], runs

    def of(index: tuple[np.ndarray, ...], pack: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        (ids, n, runs), (own, size, at, gram) = index, pack
        size = size.astype(np.int64)
        more, known = _more(_ceil(threshold * n), buckets), _more(_ceil(threshold * size), buckets)
        short = _more(_ceil(threshold * _ceil(threshold * size)), buckets) < buckets  # one run may be all that tells some of its like
        low = np.searchsorted(runs, gram | np.searchsorted(n, _ceil(threshold * size)).astype(np.uint64)[at])
        count = np.searchsorted(runs, gram | np.searchsorted(n, size, "right").astype(np.uint64)[at]) - low
        mine = np.flatnonzero(count)
        if not mine.size:
            return
        mine = mine[np.argsort(at[mine], kind="stable")]
        low, count, owner = low[mine], count[mine], at[mine].astype(np.uint64)
        total = np.cumsum(count)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))  # where each text begins
        before = np.append((total - count)[first], total[-1])
        first = np.append(first, mine.size)
        i = 0
        while i < first.size - 1:
            j = max(i + 1, int(np.searchsorted(before, before[i] + MET, side="right")) - 1)
            some, i = slice(first[i], first[j]), j
            c = count[some]
            step = np.arange(c.sum()) + np.repeat(low[some] - np.cumsum(c) + c, c)
            key = np.repeat(owner[some] << np.uint64(32), c) | runs[step] & np.uint64(2**32 - 1)
            key.sort()
            again = key[1:] == key[:-1]
            lone = key[np.append(True, ~again)] if short[owner[some].astype(np.int64)].any() else key[:0]
            key = np.concatenate([key[1:][again], lone[short[(lone >> np.uint64(32)).astype(np.int64)]]])
            key.sort()
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: key.size])
            c, key = np.diff(np.append(new, key.size)), key[new]
            x, y = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(2**32 - 1)).astype(np.int64)
            c, need = c - short[x], np.minimum(known[x], more[y]) + 1 - buckets
            good = ((c > 0) | (need <= 0)) & ((n[y] < size[x]) | (ids[y] < own[x]))  # of equal sizes the smaller id waits
            a, b, c, need = own[x[good]], ids[y[good]], c[good], need[good]
            columns = [np.minimum(a, b), np.maximum(a, b), *((c, np.maximum(need, 0)) if ordered else ())]
            for k in range(0, a.size, 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 18)]) for v in columns], names=["a", "b", "more", "need"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, index, later = None, [], None, []

        def rest() -> Iterator[pa.RecordBatch]:
            if waiting and later:
                whole = built(waiting)
                while later:
                    yield from of(whole, later.pop())
            waiting.clear(), later.clear()

        for batch in batches:
            for bucket, ids, sizes, at, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from rest()
                    now, index = bucket, None
                pack = read(ids, sizes, at, far)
                if sizes[0] == 0:
                    waiting.append(pack)
                elif not ordered:
                    later.append(pack)
                else:
                    if waiting:
                        index = built(waiting)
                    if index:
                        yield from of(index, pack)
        yield from rest()

    return run


def similar_texts(texts: DataFrame, threshold: float, n: int = 8) -> DataFrame:
    """a, b, similarity of all pairs of texts (id long, text), a < b, whose sets of runs of n characters have a Jaccard similarity of threshold or more.

    The order of runs is that of COUNTERS counters, which are broadcast: any order finds all pairs, and one that
    puts rare runs first lets few meet. Only the first runs of a text are sent, packed, to buckets by their hashes. The
    smaller text of a pair waits in an index with fewer of them (both share more for their sizes than the larger one must
    share with its smallest like); indexes are parted by sizes until they fit a task, and the runs of larger texts pass
    by. Similar texts share TOLD more of these runs than there are buckets, so those that share more than one in a bucket are
    written, and are a pair if they do so often enough over all buckets (short texts send fewer, and need less).
    texts are read several times and are best written; ids are unique.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is above 0 and at most 1")
    spark = texts.sparkSession
    counters = texts.select("text").mapInArrow(_counted(n, threshold), "run long, counts binary").repartition("run").sortWithinPartitions("run").mapInArrow(_added, "run long, counts binary")
    often, sizes = np.zeros((COUNTERS // RUN, RUN), np.uint16), np.zeros(SIZES, np.int64)
    for row in counters.collect():  # COUNTERS numbers at most, and SIZES
        if row.run < 0:
            sizes = np.frombuffer(row.counts, np.int64)
        else:
            often[row.run] = np.frombuffer(row.counts, np.uint16)
    shared = spark.sparkContext.broadcast(often.ravel())
    groups = _groups(sizes, INDEXED * BUCKETS)
    sent = texts.select("id", "text").mapInArrow(_prefixes(shared, n, threshold, BUCKETS, groups), "bucket int, ids binary, sizes binary, at binary, grams binary")
    met = sent.repartition(2 * BUCKETS * len(groups), "bucket").sortWithinPartitions("bucket", "sizes").mapInArrow(_meetings(threshold, BUCKETS, True), "a long, b long, more long, need long")
    met = met.groupBy("a", "b").agg(F.sum("more").alias("more"), F.max("need").alias("need")).where("more >= need").select("a", "b")
    pairs = Scratch(spark, "pairs").put(met, "pairs")
    held = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    held = Scratch(spark, "held").put(held, "held")
    if held.count() <= FEW:
        texts = texts.join(F.broadcast(held), "id", "left_semi")  # else nearly all texts are sent
    named = lambda key, text: texts.select(F.col("id").alias(key), F.col("text").alias(text))
    full = spread(pairs.hint("merge").join(named("a", "plumb_x"), "a"), "b").hint("merge").join(spread(named("b", "plumb_y"), "b"), "b")
    return full.select("a", "b", grams.likeness(F.col("plumb_x"), F.col("plumb_y"), threshold, n).alias("similarity")).where(F.col("similarity") >= threshold)
