"""3. Suffix-array dedup: bytes of long strings that occur earlier in the collection.

The collection's Burrows-Wheeler transform and common prefixes are built column by column (Bauer, Cox and
Rosone, 2013; Cox et al., 2016): each round puts one more symbol of every segment, from its end to its
start, into the transform by one sequential merge, and updates the common prefixes next to it. A transform
of all documents would take as many rounds as the longest has bytes, each over all data, so the collection
is first dealt out by content: a string of LENGTH bytes is known by its minimizer, the least hash of its
GRAM-byte strings, so all its occurrences meet. What is compared are segments of 100 to 168 bytes around
repeated minimizers; transforms of batches of them stay in a task's memory, and the external files of the
method are Spark's sorted shuffle files.

Plan: (a) one pass cuts texts into segments, runs of windows with one minimizer at one place; (b) sorted by minimizer
and segment hash, later equal segments are repeats, unique minimizers go, and minimizers of several
different segments remain; (c) their bytes are fetched and (d) their windows compared by transform;
(e) intervals meet their documents. Texts are shuffled once, for (c) and (e) together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table
from .vecbytes import Hasher, U, blocks, mix, raw

LENGTH, GRAM = 100, 32
#: Bytes of segments whose transform a task builds at once.
BATCH = 384 << 10
#: A minimizer with more different segments is dealt out again, by the hashes of its windows.
CROWDED = 2048
#: Segments among which a task settles equal ones before the shuffle, and settled windows it holds.
DEALT, SETTLED = 1 << 20, 1 << 16


def cut(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of every row: place of the first window, number of windows, minimizer, hash of the bytes, row."""
    n, none = len(data), np.zeros(0, np.int64)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return none, none, none.view(U), none.view(U), none
    hashed = Hasher(data)
    at = np.arange(n - gram + 1)
    grams = hashed(at, at + gram)
    least = grams & U(0xFFFFFFFF00000000) | at.astype(U)  # of equal ones the first in the window
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: n - length + 1], least[width - have : width - have + n - length + 1])
    mark = np.zeros(n + 1, np.int8)
    mark[offsets[long]] += 1
    mark[offsets[long + 1] - length + 1] -= 1
    valid = np.cumsum(mark[: n - length + 1], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(new)
    over = np.flatnonzero(valid & np.append(~valid[1:] | new[1:], True)) + 1
    key = grams[(least[starts] & U(0xFFFFFFFF)).astype(np.int64)]
    return starts, over - starts, key, hashed(starts, over + length - 1), np.searchsorted(offsets, starts, "right") - 1


def repeats_of(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are, and which come after, the earliest (doc, start) of their key."""
    order = np.lexsort((start, doc, key))
    k, d, s = key[order], doc[order], start[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    of = np.repeat(head, np.diff(np.append(head, len(k))))
    later = (d != d[of]) | (s != s[of])
    return order[head], order[later]


def _segments(length: int, gram: int):
    """(id, text) to (key, hash, id, start, span, again); again: an equal segment among DEALT of the task's comes earlier.

    So of a passage that all documents share, a task sends one row for DEALT segments under the passage's key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            key, hash_, ids, start, span = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            head, later = repeats_of(mix(key) ^ hash_, ids, start)
            key[later] = mix(ids[later].view(U) ^ mix(start[later].view(U)))  # these are settled and go anywhere
            at = np.concatenate([head, later])
            again = np.arange(len(at)) >= len(head)
            for k in range(0, len(at), 1 << 16):
                some, of = at[k : k + (1 << 16)], again[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(hash_[some].view(np.int64)), pa.array(ids[some]), pa.array(start[some]), pa.array(span[some]), pa.array(of)], names=["key", "hash", "id", "start", "span", "again"])

        for batch in batches:
            for block in blocks(batch, "text"):
                data, offsets = raw(block.column(1))
                first, span, key, hash_, row = cut(data, offsets, length, gram)
                held.append((key, hash_, block.column(0).to_numpy(zero_copy_only=False)[row], first - offsets[row], span))
                if sum(len(h[0]) for h in held) > DEALT:
                    yield from out()
        if held:
            yield from out()

    return run


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, hash, id, start: repeats (key null) and, of keys with several hashes, the first of each hash."""
    names = ["key", "hash", "id", "start", "span"]
    last: tuple | None = None  # the row before
    head: tuple | None = None  # first row of the hash in hand, while its key has no other hash
    first = (0, 0)  # place of the first row of the hash in hand
    for batch in batches:
        again = batch.column("again").to_numpy(zero_copy_only=False)
        rows = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
        gone, (key, hash_, ids, start, span) = [a[again] for a in rows[2:]], (a[~again] for a in rows)
        n = len(key)
        told, later = np.zeros(n, bool), np.zeros(n, bool)
        more: list[tuple] = []
        if n:
            new_key = np.append(last is None or key[0] != last[0], key[1:] != key[:-1])
            new = new_key | np.append(last is None or hash_[0] != last[1], hash_[1:] != hash_[:-1])
            starts = np.flatnonzero(new)
            of = np.cumsum(new)  # 0: rows of the hash in hand
            later = ~new & ((ids != np.append(first[0], ids[starts])[of]) | (start != np.append(first[1], start[starts])[of]))
            if len(starts):
                other = ~new_key[starts]  # the key has another hash before this one
                if head and other[0]:
                    more.append(head)
                told[starts] = other | np.append(other[1:], False)
                at = starts[-1]
                head, first = None if other[-1] else (key[at], ids[at], start[at], span[at]), (ids[at], start[at])
            last = (key[-1], hash_[-1])
        held = [np.concatenate([a, b[told], b[later], np.array([r[j] for r in more], np.int64)]).astype(np.int64) for j, (a, b) in enumerate(zip((gone[0], *gone), (key, ids, start, span), strict=True))]
        settled = np.repeat([True, False, True, False], [len(gone[0]), told.sum(), later.sum(), len(more)])
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64(), mask=settled), *(pa.array(a) for a in held[1:])], names=["key", "id", "start", "span"])


def _fetched(length: int):
    """(id, text, wanted) to (key, id, start, content, again): bytes of segments; of crowded keys, a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, starts, content, again = [], [], [], [], []
            deep: list[tuple[int, int, bytes]] = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = memoryview(text.as_buffer())
                for w in wanted:
                    piece = bytes(data[w["start"] : w["start"] + w["span"] + length - 1])
                    if w["crowded"]:
                        deep.append((doc, w["start"], piece))
                    else:
                        keys.append(w["key"]), ids.append(doc), starts.append(w["start"]), content.append(piece), again.append(False)
            if deep:
                joined, sizes = np.frombuffer(b"".join(p for *_, p in deep), np.uint8), np.array([len(p) for *_, p in deep])
                offset, count = np.cumsum(sizes) - sizes, sizes - length + 1
                which = np.repeat(np.arange(len(deep)), count)
                within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                at = offset[which] + within
                hash_ = Hasher(joined)(at, at + length)
                doc, start = np.array([d for d, *_ in deep])[which], np.array([s for _, s, _ in deep])[which] + within
                head, later = repeats_of(hash_, doc, start)
                for i in head:
                    keys.append(int(hash_[i : i + 1].view(np.int64)[0])), content.append(joined[at[i] : at[i] + length].tobytes())
                keys += mix(doc[later].view(U) ^ mix(start[later].view(U))).view(np.int64).tolist()
                content += [b""] * len(later)
                again += [False] * len(head) + [True] * len(later)
                ids += doc[head].tolist() + doc[later].tolist()
                starts += start[head].tolist() + start[later].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(content, pa.binary()), pa.array(again, pa.bool_())], names=["key", "id", "start", "content", "again"])

    return run


def transform(pieces: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (symbols are bytes plus 1, 0 ends a piece) and common prefixes (up to cap) of a collection.

    Round j takes suffixes of j symbols. The place of a suffix is the number of ended pieces and of symbols
    before its own in the transform so far, in order of symbol and place; the merge keeps what is there.
    """
    m, sizes = len(pieces), np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(pieces), np.uint8) + np.uint8(1)
    symbol = np.where(sizes > 0, text[np.maximum(ends - 1, 0)] if len(text) else 0, 0).astype(np.uint8)
    bwt, common = symbol, np.zeros(m, np.uint8)
    live, place = np.flatnonzero(sizes > 0), np.flatnonzero(sizes > 0)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        r = rank[place]
        target = r + m - np.count_nonzero(bwt == 0)
        # common prefix with the row before and the row after: one more than the least between the two in the last order
        padded = np.append(common, np.uint8(0))
        symbols = bwt[order]
        before, after = np.maximum(r - 1, 0), np.minimum(r + 1, len(bwt) - 1)
        has_before, has_after = (r > 0) & (symbols[before] == symbols[r]), (r + 1 < len(bwt)) & (symbols[after] == symbols[r])
        up, down = np.zeros(len(r), np.uint8), np.zeros(len(r), np.uint8)
        for has, low, high, out in ((has_before, order[before] + 1, place + 1, up), (has_after, place + 1, order[after] + 1, down)):
            some = np.flatnonzero(has)
            if len(some):
                some = some[np.argsort(low[some])]
                cuts = np.column_stack([low[some], high[some]]).ravel()
                out[some] = np.minimum(np.minimum.reduceat(padded, cuts)[::2], cap - 1) + 1
        symbol = np.where(sizes[live] > j, text[np.maximum(ends[live] - j - 1, 0)], 0).astype(np.uint8)
        old = np.ones(len(bwt) + len(live), bool)
        old[target] = False
        merged, lcp = np.empty(len(old), np.uint8), np.empty(len(old) + 1, np.uint8)
        merged[old], merged[target] = bwt, symbol
        lcp[:-1][old], lcp[target] = common, up
        follower = target + 1
        lcp[follower[has_after]] = down[has_after]
        lcp[target] = up  # where new rows follow each other the later one's own value holds
        bwt, common = merged, lcp[:-1]
        more = sizes[live] > j
        live, place = live[more], target[more]
    return bwt, common


def repeated_windows(pieces: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of length bytes in the pieces, (doc, start) of those equal to one with a smaller (doc, start)."""
    bwt, common = transform(pieces, length)
    m, sizes = len(pieces), np.array([len(p) for p in pieces])
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt)) + m - np.count_nonzero(bwt == 0)
    kind = np.cumsum(common < length)  # rows of one kind share their first length symbols
    row, live = np.arange(m), np.arange(m)
    found: list[tuple[np.ndarray, ...]] = []
    for j in range(1, int(sizes.max(initial=0)) + 1):
        more = sizes[live] >= j
        live, row = live[more], step[row[more]]
        if j >= length:
            found.append((kind[row], docs[live], starts[live] + sizes[live] - j))
    if not found:
        return docs[:0], starts[:0]
    kinds, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
    _, later = repeats_of(kinds, doc, start)
    return doc[later], start[later]


def candidates(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces with windows whose hash occurs again in the collection, and the first and last of these: all others hold no repeat."""
    sizes = np.array([len(p) for p in pieces])
    count = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(pieces)), count)
    at = np.arange(len(which)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(count) + count, count)
    if not len(at):
        return at, at, at
    hash_ = Hasher(np.frombuffer(b"".join(pieces), np.uint8))(at, at + length)
    order = np.argsort(hash_)
    same = hash_[order[1:]] == hash_[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    again = np.flatnonzero(again)
    if not len(again):
        return again, again, again
    piece, within = which[again], again - (np.cumsum(count) - count)[which[again]]
    new = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    return piece[new], within[new], within[np.append(new[1:], len(piece)) - 1]


def _compared(length: int):
    """Rows sorted by key to (id, start, span 1) of repeated windows; keys are gathered to batches, none is divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size, settled = 0, ([], [])

        def out() -> Iterator[pa.RecordBatch]:
            # only stretches of windows that may repeat are built into a transform
            piece, first, last = candidates([h[3] for h in held], length)
            some = [(held[i], a, b + length) for i, a, b in zip(piece.tolist(), first.tolist(), last.tolist(), strict=True)]
            doc, start = repeated_windows([h[3][a:b] for h, a, b in some], np.array([h[1] for h, _, _ in some], np.int64), np.array([h[2] + a for h, a, _ in some], np.int64), length)
            doc, start = np.concatenate([doc, np.array(settled[0], np.int64)]), np.concatenate([start, np.array(settled[1], np.int64)])
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))[: len(doc)])
            yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(start[new]), pa.array(np.diff(np.append(new, len(doc))))], names=["id", "start", "span"])

        for batch in batches:
            for key, doc, start, content, again in zip(*(batch.column(x).to_pylist() for x in ("key", "id", "start", "content", "again")), strict=True):
                if again:
                    settled[0].append(doc), settled[1].append(start)
                    if len(settled[0]) > SETTLED:
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in settled), pa.array(np.ones(len(settled[0]), np.int64))], names=["id", "start", "span"])
                        settled = ([], [])
                    continue
                if size > BATCH and key != held[-1][0]:
                    yield from out()
                    held, size, settled = [], 0, ([], [])
                held.append((key, doc, start, content))
                size += len(content)
        if held or settled[0]:
            yield from out()

    return run


def _kept(length: int):
    """(id, text, runs, of) to (id, of, n_bytes, n_removed, n_spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", 8 << 20):
                n, removed, spans, kept = [], [], [], []
                for text, runs in zip(block.column(1), block.column(2).to_pylist(), strict=True):
                    data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                    n.append(len(data))
                    if not runs or not len(data):
                        removed.append(0), spans.append(0), kept.append(data.tobytes())
                        continue
                    a = np.sort(np.array([(r["start"], r["start"] + r["span"] - 1 + length) for r in runs], np.int64), axis=0)
                    a = np.minimum(a, len(data))  # another row of the id may be longer
                    mark = np.zeros(len(data) + 1, np.int64)
                    np.add.at(mark, a[:, 0], 1)
                    np.add.at(mark, a[:, 1], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    removed.append(int(gone.sum())), spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())), kept.append(data[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(3), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["id", "of", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of docs: id_col, of (a hash of its text), n_bytes, n_removed, n_spans, and kept, the bytes that no earlier string of length bytes covers.

    Earlier: in a smaller id, or in the same text further ahead. Strings are judged on the input and never
    cross documents. Null and empty texts keep nothing. Rows with a null id take no part and keep their text.
    Rows that share an id count as one document: what occurs at one place in all of them is no repeat.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = source.where("id is not null")
    cuts = known.mapInArrow(_segments(length, gram), "key long, hash long, id long, start long, span long, again boolean")
    cuts = cuts.repartition("key").sortWithinPartitions("key", "hash", "id", "start")
    settled = scratch.put(cuts.mapInArrow(_settled, "key long, id long, start long, span long"), "settled")

    open_ = settled.where("key is not null")
    crowded = open_.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > CROWDED).select("key", F.lit(True).alias("crowded"))
    wanted = open_.join(crowded, "key", "left").groupBy("id").agg(F.collect_list(F.struct("key", "start", "span", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("wanted"))
    pieces = known.hint("merge").join(wanted, "id").select("id", "text", "wanted").mapInArrow(_fetched(length), "key long, id long, start long, content binary, again boolean")
    more = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(length), "id long, start long, span long")

    runs = settled.where("key is null").select("id", "start", "span").unionByName(more).groupBy("id").agg(F.collect_list(F.struct("start", "span")).alias("runs"))
    shape = "id long, of long, n_bytes long, n_removed long, n_spans long, kept binary"
    out = known.hint("merge").join(runs, "id", "left").select("id", "text", "runs", F.xxhash64("text").alias("of")).mapInArrow(_kept(length), shape)
    unknown = source.where("id is null").select("id", F.xxhash64("text").alias("of"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return out.unionByName(unknown).withColumnRenamed("id", id_col)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([b.decode("utf-8", "ignore") for b in batch.column(2).to_pylist()], pa.string())], names=["plumb_id", "plumb_of", "plumb_text"])


def with_repeats_cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with text_col less what without_repeats removes (and less characters that this parts), and size_col, if there is one, to match.

    Only rows that lose bytes change; null texts stay null. Rows that share an id are one document, and each keeps
    what is left of its own text.
    """
    cut_ = without_repeats(docs.where(F.col(id_col).isNotNull()), id_col, text_col).where("n_removed > 0").select(F.col(id_col).alias("plumb_id"), "of", "kept")
    cut_ = cut_.mapInArrow(_decoded, "plumb_id long, plumb_of long, plumb_text string").dropDuplicates(["plumb_id", "plumb_of"])
    same = (F.col(id_col).cast("long") == F.col("plumb_id")) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col("plumb_of"))
    joined = docs.join(cut_, same, "left")
    text = F.coalesce("plumb_text", docs[text_col])
    new = {text_col: text}
    if size_col in docs.columns:
        new[size_col] = F.when(F.col("plumb_text").isNull(), docs[size_col]).otherwise(F.length("plumb_text").cast(docs.schema[size_col].dataType))
    return joined.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
