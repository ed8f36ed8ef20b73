"""11. Ranked lexical search by hierarchical max trees over document ranges.

The collection is dealt into blocks of documents, in id order within a block. A term has in each block its
postings (position of the document, its part of the score without the term's weight) and over them a tree:
a node covers FAN nodes of the level below and holds the largest part among them. A question sums, for a node,
weight times largest part of its terms; no document below can score more. A search of a block takes the node of
the highest sum from a heap, opens it, and so on; a document that comes to the top is a hit, as nothing left can
pass it. Of equal sums that with the smaller first position comes first, so every range that might hold a tie
with a smaller id is opened before the tie is given away, and equal scores come in order of their ids.

Plan: (a) one pass counts terms; (b) one pass writes the index, a row for each block and term; no posting is
shuffled for it; (c) document frequencies are sums over the index's counts; (d) rows of asked terms meet the
questions' weights and are gathered by block; each block gives its k best; (e) the k best of all.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, table
from .vecbytes import LOWER, blocks, raw, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True
#: Nodes of a level that one of the next level covers. Lists of up to FAN postings are stored without a tree: one node would cover them.
FAN = 32
#: A block ends at so many documents (positions take two bytes) or bytes of text, and has one document at least.
BLOCK_DOCS, BLOCK_BYTES = FAN**3, 16 << 20
#: Questions whose terms meet a block's at once, and (term, block of questions) rows up to which they are broadcast.
QUESTIONS, BROADCAST_ROWS = 1024, 1_000_000
#: Bytes of index rows that a task hands over at once.
OUT_BYTES = 4 << 20
_SHAPE = "block long, term string, n int, docs binary, parts binary, levels array<int>, nodes binary, tops binary"


def terms(text: Column) -> Column:
    """The terms of a text, in order: maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))


@dataclass(frozen=True)
class Index:
    """Index rows, a row of ids for each block (term empty), the documents with a term, and the number of all their terms."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def _slices(lengths: np.ndarray, flat: np.ndarray) -> pa.Array:
    """flat's items as binary values, so many in each."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def parents(code: np.ndarray, node: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level up: of each list, the ranges of FAN nodes that have any, and the largest part in each."""
    up = node // FAN
    head = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (up[1:] != up[:-1]))[: len(code)])
    return code[head], up[head], np.maximum.reduceat(top, head) if len(head) else top


def block_index(texts: pa.Array, n_docs: int, n_terms: int) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """The terms of a block's texts, and postings and trees as flat arrays in the order of the terms."""
    data, offsets = raw(texts)
    inside = INSIDE[data]
    starts, ends, row = words(data, offsets, inside)
    size, d = ends - starts, max(1, len(texts))
    flat = pa.py_buffer(LOWER[data[inside]])
    coded = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat]).dictionary_encode()
    length = np.bincount(row, minlength=d).astype(np.int64)
    key = np.sort(coded.indices.to_numpy().astype(np.int64) * d + row)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    tf, code, doc = np.diff(np.append(head, len(key))), key[head] // d, key[head] % d
    m = 75 + 25 * length * n_docs // max(1, n_terms)
    part = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    n = np.bincount(code, minlength=len(coded.dictionary))
    tall = n[code] > FAN
    level = parents(code[tall], doc[tall], part[tall])
    trees = [level]
    while len(level[0]) and (level[1] > 0).any():
        trees.append(level := parents(*level))
    of = np.concatenate([t[0] for t in trees])
    order = np.argsort(of, kind="stable")  # by term, then from the level above the documents to the root
    counts = np.array([np.bincount(t[0], minlength=len(n)) for t in trees]) if len(n) else np.zeros((len(trees), 0), np.int64)
    return coded.dictionary, {
        "n": n, "doc": doc.astype(np.uint16), "part": part.astype(np.int32), "levels": counts,
        "node": np.concatenate([t[1] for t in trees])[order].astype(np.uint16), "top": np.concatenate([t[2] for t in trees])[order].astype(np.int32),
    }


def _index(n_docs: int, n_terms: int, block_docs: int, block_bytes: int):
    def rows(block: int, ids: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        names, x = block_index(texts.take(pa.array(order)), n_docs, n_terms)
        tall = x["n"] > FAN
        inner = np.where(tall, x["levels"].sum(0), 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tall) + 1, dtype=np.int32) * len(x["levels"])), pa.array(x["levels"].T.ravel().astype(np.int32)))
        columns = [pa.array(np.full(len(tall), block)), names, pa.array(x["n"].astype(np.int32)), _slices(x["n"], x["doc"]), _slices(x["n"], x["part"]), lists, _slices(inner, x["node"]), _slices(inner, x["top"])]
        out = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SHAPE.split(", ")])
        size, at = np.cumsum(6 * (x["n"] + inner) + 32), 0
        while at < len(tall):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + OUT_BYTES, "right")))
            yield out.slice(at, to - at)
            at = to
        none = [pa.array([v], t) for v, t in ((b"", pa.binary()), ([], pa.list_(pa.int32())), (b"", pa.binary()), (b"", pa.binary()))]
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([""]), pa.array([len(ids)], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), *none], names=out.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, docs, size = TaskContext.get().partitionId() << 32, [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from rows(block, whole.column("id").to_numpy(), whole.column("text").chunk(0))

        for batch in batches:
            at = 0
            length = np.diff(raw(batch.column("text"))[1])
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(length[at:]), block_bytes - size, "right")
                to = at + min(max(int(room), 0 if held else 1), block_docs - docs)
                if to > at:
                    held.append(batch.slice(at, to - at))
                    docs, size, at = docs + to - at, size + int(length[at:to].sum()), to
                if at < batch.num_rows:
                    yield from out()
                    block, held, docs, size = block + 1, [], 0, 0
        if held:
            yield from out()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and all terms, of each batch."""
    for batch in batches:
        for block in blocks(batch, "text"):
            data, offsets = raw(block.column(0))
            row = words(data, offsets, INSIDE[data])[2]
            yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(row))]), pa.array([len(row)])], names=["docs", "terms"])


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> Index:
    """The index of docs, written in the shared folder: every row with an id, and every term of its whole text.

    A null or empty text has no terms and is no hit. Rows with a null id take no part. Rows that repeat an id are
    documents of their own. Other columns of docs are not looked at. An empty table gives an index without rows.
    A text of any length is indexed whole, in a block of its own if need be.
    """
    if not 0 < block_docs <= BLOCK_DOCS:
        raise ValueError(f"a block has 1 to {BLOCK_DOCS} documents")
    scratch = scratch or Scratch(docs.sparkSession, "lexical")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    counted = source.select("text").mapInArrow(_counted, "docs long, terms long")
    n_docs, n_terms = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "terms"))).first()
    return Index(scratch.put(source.mapInArrow(_index(n_docs, n_terms, block_docs, block_bytes), _SHAPE), "index"), n_docs, n_terms)


class Tree:
    """Levels of a term in a block, documents first: sorted nodes and the largest part in each."""

    def __init__(self, docs: bytes, parts: bytes, counts: list[int], nodes: bytes, tops: bytes, height: int):
        self.levels = [(np.frombuffer(docs, np.uint16).astype(np.int64), np.frombuffer(parts, np.int32).astype(np.int64))]
        if nodes:
            node, top = np.frombuffer(nodes, np.uint16).astype(np.int64), np.frombuffer(tops, np.int32).astype(np.int64)
            cuts = np.cumsum(counts)[:-1]
            self.levels += [x for x in zip(np.split(node, cuts), np.split(top, cuts), strict=True) if len(x[0])]
        while len(self.levels) <= height:
            node, top = self.levels[-1]
            self.levels.append(parents(np.zeros(len(node), np.int64), node, top)[1:])
        self.root = int(self.levels[height][1].max())
        self._first: dict[int, array] = {}

    def first(self, level: int) -> array:
        """Where the nodes of level that each node above it covers begin, by the node above; made when first asked for."""
        if level not in self._first:
            node = self.levels[level][0]
            ends = node.searchsorted(np.arange(0, int(node[-1]) + 2 * FAN, FAN))
            self._first[level] = array("i", ends.astype(np.int32).tobytes())
        return self._first[level]


def height_of(n_docs: int) -> int:
    """Levels above the documents until one node covers them."""
    height = 0
    while FAN**height < n_docs:
        height += 1
    return height


def search(asked: list[tuple[int, Tree]], height: int, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, position) of a block for (weight, tree) pairs, best first and equal ones by position; nodes opened."""
    most = sum(w * t.root for w, t in asked)
    heap = [(-most, 0, height)] if most else []
    below = [[(w, t.first(level), *t.levels[level]) for w, t in asked] for level in range(height)]
    found: list[tuple[int, int]] = []
    best: list[int] = []  # the k highest scores of documents seen so far
    opened = 0
    while heap and len(found) < k:
        bound, first, level = heapq.heappop(heap)
        if not level:
            found.append((-bound, first))
            continue
        opened += 1
        at = first // FAN**level
        low = at * FAN
        sums = np.zeros(FAN, np.int64)
        for w, cuts, node, top in below[level - 1]:
            if at + 1 < len(cuts) and cuts[at] < cuts[at + 1]:
                some = slice(cuts[at], cuts[at + 1])
                sums[node[some] - low] += w * top[some]
        least = max(best[0], 1) if len(best) == k else 1
        step = FAN ** (level - 1)
        for c in np.flatnonzero(sums >= least).tolist():
            s = int(sums[c])
            heapq.heappush(heap, (-s, (low + c) * step, level - 1))
            if level == 1:
                heapq.heappush(best, s) if len(best) < k else heapq.heappushpop(best, s)
    return found, opened


def _searched(k: int):
    def run(_key: tuple, rows: pa.Table) -> pa.Table:
        names, shape = ["item", "id", "score", "opened"], pa.schema([("item", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("opened", pa.int64())])
        columns = {c: rows.column(c).to_pylist() for c in ("term", "docs", "parts", "levels", "nodes", "tops", "asks")}
        at = columns["term"].index("") if "" in columns["term"] else None
        if at is None or len(columns["term"]) == 1:
            return shape.empty_table()
        ids = np.frombuffer(columns["docs"][at], np.int64)
        height = height_of(len(ids))
        by_item: dict[int, list[tuple[int, Tree]]] = {}
        for i, asks in enumerate(columns["asks"]):
            if asks:
                tree = Tree(*(columns[c][i] for c in ("docs", "parts", "levels", "nodes", "tops")), height)
                for ask in asks:
                    by_item.setdefault(ask["item"], []).append((ask["weight"], tree))
        out: list[tuple[int, int, int, int]] = []
        for item, asked in by_item.items():
            found, opened = search(asked, height, k)
            out += [(item, int(ids[p]), score, opened) for score, p in found]
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [[]] * 4, names=names).cast(shape)

    return run


def questions_of(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, times): rows that share an id are one question, equal rows once; null ids and texts without terms ask nothing."""
    rows = queries.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    return rows.select("item", F.explode(terms(F.col("text"))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def block_hits(index: Index, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", questions: int = QUESTIONS) -> DataFrame:
    """item, id, score, opened (nodes that the search of the document's block opened): the k best of each block."""
    spark = queries.sparkSession
    asked = questions_of(queries, id_col, text_col)
    n_rows, n_items = asked.agg(F.count("*"), F.count_distinct("item")).first()
    small = (lambda df: F.broadcast(df)) if n_rows <= BROADCAST_ROWS else (lambda df: df)
    n_blocks = -(-n_items // questions) or 1
    df = index.rows.select("term", "n").join(small(asked.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    # a weight of 0 adds nothing; a block's ids come with every block of questions
    weighed = asked.join(df, "term").select("term", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("part"), "item", (weight * F.col("times")).alias("weight")).where("weight > 0")
    asks = weighed.groupBy("term", "part").agg(F.collect_list(F.struct("item", "weight")).alias("asks"))
    ids = spark.range(n_blocks).select(F.lit("").alias("term"), F.col("id").alias("part"), F.array().cast("array<struct<item:long,weight:long>>").alias("asks"))
    facing = index.rows.join(small(asks.unionByName(ids)), "term")
    return facing.groupBy("block", "part").applyInArrow(_searched(k), "item long, id long, score long, opened long")


def ranked(index: Index, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per question its k best documents: id_col, rank (from 1), doc_id, score above 0; equal scores by ascending id.

    A term's weight w is floor(1000 ln((2N+2)/(2df+1))); a document's m is 75 + 25nN div L; its score sums
    w * (10^9 tf div (1000 tf + 12m)) over the question's terms with their repeats, in 64-bit integers.
    N: documents with a term, L: all their terms, n: the document's, df: documents that hold the term, tf: how often.
    Null and empty questions, and those whose terms occur nowhere, have no rows. Questions may be of any number and
    length: they are taken in blocks of QUESTIONS.
    """
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    hits = block_hits(index, queries, k, id_col, text_col).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return hits.select(F.col("item").alias(id_col), "rank", F.col("id").alias("doc_id"), "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    index = indexed(table(spark, sf_dir, "documents", "doc_id", "text"))
    return ranked(index, table(spark, sf_dir, "benchmark", "item_id", "text"))


OP11_SQL = r"""WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE doc_id IS NOT NULL),
dt AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
qt AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY 1), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // l AS m FROM sizes, total),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
scored AS (SELECT q.item_id, tf.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m)))::BIGINT AS score
  FROM (SELECT item_id, term, count(*) AS times FROM qt GROUP BY 1, 2) q JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.doc_id = tf.doc_id GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20"""
