"""13. Substring dedup: suffix automata of reference shards, sent to the documents that stream past them.

The reference is the collection itself: a run of words goes where it also starts anywhere else. An automaton of
all documents would not fit anywhere, so the reference is dealt into shards by content: a window of LENGTH words
is known by its minimizer, the least hash of its GRAM-word strings, so all that could match a window lie in one
shard. A shard holds the segments (runs of windows with one minimizer at one place) of its repeated minimizers,
each text once with the number of its occurrences; a suffix automaton of them counts how often each string
of words occurs. Segments of documents stream past the automaton, whose states give for every word the longest
string ending there that occurs twice or more (matching statistics); maximal ones of LENGTH words or more go.

A minimizer that very many documents share has as many slices of the stream as its rows need, and its reference
is broadcast to every one of them; where one slice is enough, the segments in it are their own reference. Sizes
are bounded: shards take SHARD_WORDS words on average, and a minimizer with over CROWDED different segments is
dealt out by whole windows instead. Equal segments of a task travel as one row. Hashes choose shards only;
strings are compared by their words.

Plan: (a) minimizers are counted, map-side first; (b) those that repeat meet their documents' ids; (c) documents
are cut again, beside their repeated minimizers, and their segments become reference and stream; (d) automata,
matching; (e) runs of words meet their documents. Texts are shuffled once, for (c) and (e) together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, heavy_join, table
from .vecbytes import Hasher, U, blocks, mix, raw, signed, words

LENGTH, GRAM = 35, 8
#: Words of reference in a shard, on average.
SHARD_WORDS = 1 << 17
#: Different segments of a minimizer in one shard, and rows of a minimizer in one slice of the stream.
CROWDED, SLICE = 1024, 1 << 14
#: Bytes of segments among which a task sends equal ones as one row, and occurrences that a row holds at most.
DEALT, HITS = 16 << 20, 1 << 12
#: Bytes of text that are cut at once; a worker's arrays take some 60 times as much.
BLOCK = 512 << 10
#: Kinds of rows of a shard, in the order in which they come.
REFERENCE, WHOLE, STREAMS = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
_HIT = np.dtype([("id", "<i8"), ("of", "<i8"), ("start", "<i4")])


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values, by doubling."""
    if len(h) < n:
        return h[:0]
    out, done, have, power = None, 0, 1, _BASE
    part = h
    while True:  # part: hashes of runs of `have` values, with power = BASE^have
        if n & have:
            if out is None:
                out, done = part, have
            else:
                size = len(h) - done - have + 1
                out, done = out[:size] * U(power) + part[done : done + size], done + have
        if done == n:
            return mix(out + U(n))
        size = len(part) - have
        part = part[:size] * U(power) + part[have : have + size]
        power, have = power * power % (1 << 64), 2 * have


def cut(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of every row: row, number of its first word within the row, windows, minimizer, hash of its bytes."""
    starts, ends, row = words(data, offsets)
    n, none = len(starts), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(U), none.view(U)
    hasher = Hasher(data)
    grams = rolled(hasher(starts, ends), gram)
    place = np.arange(len(grams), dtype=np.int64)
    least = grams & U(0xFFFFFFFF00000000) | place.astype(U)  # of equal ones the first in the window
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    last = n - length + 1
    least = np.minimum(least[:last], least[width - have : width - have + last])
    valid = row[:last] == row[length - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    span = np.flatnonzero(valid & np.append(~valid[1:] | new[1:], True)) + 1 - first
    key = grams[(least[first] & U(0xFFFFFFFF)).astype(np.int64)]
    body = hasher(starts[first], ends[first + span + length - 2])  # tells segments of a minimizer apart, for counts only
    head = np.searchsorted(row, row[first])
    return row[first], first - head, span, key, body


class SuffixAutomaton:
    """All strings of the texts added, with the number of their occurrences.

    Each state stands for strings that end at the same places; link leads to the longest suffix that also ends
    elsewhere. Texts are lists of hashable symbols and are added from the root, so no string crosses two of them.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.again: list[int] = []

    def _state(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A state for the strings of q that are at most one longer than those of p."""
        clone = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, text: list, times: int = 1) -> None:
        following, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in text:
            q = following[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
            else:
                now = self._state({}, 0, length[last] + 1)
                p = last
                while p >= 0 and c not in following[p]:
                    following[p][c] = now
                    p = link[p]
                if p >= 0:
                    q = following[p][c]
                    link[now] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = now
            count[last] += times

    def finish(self, least: int = 2) -> None:
        """Counts of all states; for each, the longest of its suffixes that occurs least times."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        for s in reversed(order[1:]):
            self.count[self.link[s]] += self.count[s]
        self.again = [0] * len(order)
        for s in order[1:]:
            self.again[s] = self.length[s] if self.count[s] >= least else self.again[self.link[s]]

    def statistics(self, text: list) -> Iterator[int]:
        """For each symbol, the length of the longest string ending there that occurs often enough."""
        following, link, length, again = self.next, self.link, self.length, self.again
        at = have = 0
        for c in text:
            while at and c not in following[at]:
                at = link[at]
                have = length[at]
            if c in following[at]:
                at = following[at][c]
                have += 1
            yield min(have, again[at])

    def spans(self, text: list, least: int) -> list[tuple[int, int]]:
        """Maximal runs (start, end) covered by strings of least symbols or more that occur often enough."""
        out: list[tuple[int, int]] = []
        for end, n in enumerate(self.statistics(text), 1):
            if n >= least:
                start = end - n
                if out and start <= out[-1][1]:
                    start = min(start, out.pop()[0])
                out.append((start, end))
        return out


def _cuts(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                row, _, _, key, body = cut(*raw(block.column(1)), length, gram)
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(row)), signed(key), signed(body)], names=["id", "key", "body"])

    return run


_PIECE = "shard long, slice int, slices int, alone boolean, content binary, hits binary, n long"


def _pieces(length: int, gram: int, shards: int):
    """(id, of, text, wanted) to segments with repeated minimizers; equal ones of a task go as one row."""
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, turn, size, held = TaskContext.get().partitionId(), 0, 0, {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(*head, content, np.array(hits[k : k + HITS], _HIT).tobytes(), len(hits[k : k + HITS])) for content, (head, hits) in held.items() for k in range(0, len(hits), HITS)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for block in blocks(batch, "text", BLOCK):
                data, offsets = raw(block.column("text"))
                row, first, span, key, _ = (x.tolist() for x in cut(data, offsets, length, gram))
                ids, of = block.column("id").to_pylist(), block.column("of").to_pylist()
                wanted = [{w["key"] % (1 << 64): (w["slices"], w["crowded"]) for w in ws} for ws in block.column("wanted").to_pylist()]
                tokens, now = [], -1
                for r, a, n, k in zip(row, first, span, key, strict=True):
                    if k not in wanted[r]:
                        continue
                    if r != now:
                        tokens, now = data[offsets[r] : offsets[r + 1]].tobytes().split(), r
                    slices, crowded = wanted[r][k]
                    if not crowded:
                        found = ((a, b" ".join(tokens[a : a + n + length - 1]), k),)
                    else:
                        found = ((i, (c := b" ".join(tokens[i : i + length])), hash_of(c)) for i in range(a, a + n))
                        slices = 1
                    for start, content, by in found:
                        if content not in held:
                            held[content] = ((by % shards, (pid + turn) % slices, slices, crowded), [])
                            size += len(content) + 200
                        held[content][1].append((ids[r], of[r], start))
                        size += 100
                if size > DEALT:
                    yield from out()
                    turn, size, held = turn + 1, 0, {}
        if held:
            yield from out()

    return run


def hash_of(content: bytes) -> int:
    """A hash that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")


def _matched(length: int):
    """Rows by shard, slice and kind: (id, of, start, size) of runs of words that also occur elsewhere.

    Kinds: a text of the reference with its occurrences; a segment whose minimizer has all its segments here, so
    it is held as reference, too, until all are; a segment that only streams past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton, symbols, known, held = None, SuffixAutomaton(), {}, {}, {}
        found: list[bytes] = []
        times, starts, sizes = [], [], []

        def match(content: bytes, n: int, hits: list[bytes]) -> None:
            if content not in known:
                known[content] = automaton.spans([symbols.get(w, -1) for w in content.split(b" ")], length)
            for a, b in known[content]:
                found.extend(hits), times.append(n), starts.append(a), sizes.append(b - a)

        def add(content: bytes, n: int) -> None:
            automaton.add([symbols.setdefault(w, len(symbols)) for w in content.split(b" ")], n)

        def finish() -> None:
            for content, (n, _) in held.items():
                add(content, n)
            automaton.finish()
            for content, (n, hits) in held.items():
                match(content, n, hits)
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                rows = np.frombuffer(b"".join(found), _HIT)
                start, size = (np.repeat(np.array(x, np.int32), times) for x in (starts, sizes))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[c])) for c in ("id", "of")), pa.array(rows["start"] + start), pa.array(size)], names=["id", "of", "start", "size"])
                for x in (found, times, starts, sizes):
                    x.clear()

        for batch in batches:
            for shard, slice_, kind, content, n, hits in zip(*(batch.column(c).to_pylist() for c in ("shard", "slice", "kind", "content", "n", "hits")), strict=True):
                if (shard, slice_) != at:
                    if held:
                        finish()
                    at, automaton, symbols, known = (shard, slice_), SuffixAutomaton(), {}, {}
                if kind == REFERENCE:
                    add(content, n)
                elif kind == WHOLE:
                    one = held.setdefault(content, [0, []])
                    one[0] += n
                    one[1].append(hits)
                else:
                    if not automaton.again:
                        finish()
                    match(content, n, [hits])
            yield from out()
        if held:
            finish()
        yield from out()

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, of, text, runs) to (id, n_words, n_removed, kept); runs of other rows of the id have another of."""
    for batch in batches:
        for block in blocks(batch, "text", 8 << 20):
            n, removed, kept = [], [], []
            for text, of, runs in zip(block.column("text"), block.column("of").to_pylist(), block.column("runs").to_pylist(), strict=True):
                tokens = text.as_buffer().to_pybytes().split()
                n.append(len(tokens))
                if a := [(r["start"], r["start"] + r["size"]) for r in runs or () if r["of"] == of]:
                    mark = np.zeros(len(tokens) + 1, np.int64)
                    a = np.array(a)
                    np.add.at(mark, a[:, 0], 1)
                    np.add.at(mark, a[:, 1], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    removed.append(int(gone.sum()))
                    tokens = [tokens[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    removed.append(0)
                kept.append(b" ".join(tokens).decode())
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])


def shared_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED, slice_rows: int = SLICE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """id, of (a hash of the row's text), start, size: runs of words, length or more, that also start anywhere else.

    Runs of one document may touch or overlap where its segments meet; their union is what windows of length words
    that occur elsewhere cover. See without_shared for odd rows.
    """
    scratch = Scratch(docs.sparkSession, "shared")
    known = _known(docs, id_col, text_col)
    cuts = known.select("id", "text").mapInArrow(_cuts(length, gram), "id long, key long, body long")
    counts = scratch.put(cuts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    open_ = scratch.put(heavy_join(cuts, counts, "key", "c").where("c is not null"), "open")
    bodies = open_.where(F.col("c") > crowded).groupBy("key", "body").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.count("*").alias("kinds"))
    bodies = scratch.put(bodies.where(F.col("kinds") > crowded).select("key", F.col("c").alias("crowd"), F.lit(True).alias("crowded")), "crowded")
    marked = heavy_join(open_, bodies, "key", "crowd").select("id", "key", F.ceil(F.col("c") / slice_rows).cast("int").alias("slices"), F.coalesce("crowded", F.lit(False)).alias("crowded"))
    # a segment has some 1.4 windows' words; one that is dealt out by windows has half its windows times theirs
    n = open_.count() + bodies.agg(F.coalesce(F.sum("crowd"), F.lit(0))).first()[0] * (length - gram) // 3
    shards = max(1, -(-n * (length + length // 2) // shard_words))

    def pieces(of: DataFrame) -> DataFrame:
        wanted = of.groupBy("id").agg(F.collect_set(F.struct("key", "slices", "crowded")).alias("wanted"))
        return known.hint("merge").join(wanted, "id").select("id", "of", "text", "wanted").mapInArrow(_pieces(length, gram, shards), _PIECE)

    # where all segments of a minimizer are in one slice, they are their own reference
    shape = ["shard", "slice", "kind", "content", "n", "hits"]
    stream = pieces(marked).withColumn("kind", F.when((F.col("slices") == 1) & ~F.col("alone"), WHOLE).otherwise(STREAMS)).select(*shape)
    reference = pieces(marked.where("slices > 1 or crowded")).groupBy("shard", "content", "alone").agg(F.sum("n").alias("n"), F.max("slices").alias("slices")).where("n > 1 or not alone")
    reference = reference.withColumns({"slice": F.explode(F.sequence(F.lit(0), F.col("slices") - 1)), "kind": F.lit(REFERENCE), "hits": F.lit(None).cast("binary")})
    both = reference.select(*shape).unionByName(stream)
    return both.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind").mapInArrow(_matched(length), "id long, of long, start int, size int")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("of"), text.alias("text"))


def _known(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _source(docs, id_col, text_col).where("id is not null")


def without_shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options: int) -> DataFrame:
    """Per row of docs: id_col, n_words, n_removed, and kept: the words that shared_runs leaves, joined by one space.

    Words are runs of bytes other than [\\x20\\x09-\\x0D], unchanged. All copies of a shared run go, the first one too.
    Null, empty and blank texts have no words; texts of fewer than length words lose none. Every row with an id
    is a document of its own, also where it repeats another row's id: equal rows are each other's copies. Rows
    with a null id take no part and keep all words. Texts of any length are read whole. No rows in: no rows out.
    Other columns of docs are not looked at, whatever their names.
    """
    runs = shared_runs(docs, id_col, text_col, length, **options).groupBy("id").agg(F.collect_list(F.struct("of", "start", "size")).alias("runs"))
    joined = _known(docs, id_col, text_col).hint("merge").join(runs, "id", "left").select("id", "of", "text", "runs")
    nowhere = _source(docs, id_col, text_col).where("id is null").withColumn("runs", F.lit(None).cast(joined.schema["runs"].dataType))
    shape = "id long, n_words long, n_removed long, kept string"
    return joined.mapInArrow(_kept, shape).unionByName(nowhere.mapInArrow(_kept, shape)).withColumnRenamed("id", id_col)


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_shared(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS pos FROM w),
g AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 34], ' ') AS win FROM p),
again AS (SELECT doc_id, pos FROM g SEMI JOIN (SELECT win FROM g GROUP BY win HAVING count(*) > 1) r USING (win)),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM again, range(35) t(k)),
kept AS (SELECT doc_id, list(pos ORDER BY pos) AS ats FROM gone GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(ats), 0)::BIGINT AS n_removed,
sha256(array_to_string(CASE WHEN ats IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(ats, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
