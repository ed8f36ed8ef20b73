"""Dense, sparse and weighted search: a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..sources.scratch import Scratch

#: Queries that are compared with a partition of rows at once.
BLOCK = 512


def top_k(hits: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """The k best hits of each query with their rank; ties go to the smaller id. Spark cuts groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def dense_hits(queries: DataFrame, rows: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): cosine of unit-normed vectors, by matrix products of query blocks and row batches.

    queries and rows have id and vector. Queries are dealt into blocks of about BLOCK; all rows meet each
    block, in as many tasks as row slices, and every task keeps k hits of a query for the final cut. A
    vector of length zero scores 0.
    """
    spark = queries.sparkSession
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = F.broadcast(queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("blocks")))
    q = queries.join(blocks).select(F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(True).alias("asks"), "id", "vector")
    r = rows.join(blocks).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), F.lit(False).alias("asks"), "id", "vector")
    return top_k(products(q.unionByName(r), k, digits), k)


def products(met: DataFrame, k: int, digits: int) -> DataFrame:
    """(query_id, id, score) of rows (block, slice, asks, id, vector): in each block and slice the k best of every query for a batch of rows."""
    met = met.repartition("block", "slice").sortWithinPartitions("block", "slice", F.desc("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ask_ids, asks = None, [], []
        for batch in batches:
            at = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            ids = batch.column(3).to_numpy(zero_copy_only=False)
            flat, size = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64), batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            start = 0
            while start < len(at):
                stop = start
                while stop < len(at) and at[stop] == at[start]:
                    stop += 1
                matrix = flat[ends[start] - size[start] : ends[stop - 1]].reshape(stop - start, -1)
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
                if at[start][:2] != key:
                    key, ask_ids, asks = at[start][:2], [], []
                if at[start][2]:
                    ask_ids.append(ids[start:stop]), asks.append(matrix)
                elif asks:
                    who, score = np.concatenate(ask_ids), np.round(np.concatenate(asks) @ matrix.T, digits)
                    order = np.lexsort((np.broadcast_to(ids[start:stop], score.shape), -score), axis=1)[:, :k]
                    out.append((np.repeat(who, order.shape[1]), ids[start:stop][order].ravel(), np.take_along_axis(score, order, 1).ravel()))
                start = stop
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "score"])

    return met.select("block", "slice", "asks", "id", "vector").mapInArrow(run, "query_id long, id long, score double")


def tokens(text: Column) -> Column:
    """The words of a text in order, lower-cased: runs of characters other than [\\x20\\x09-\\x0D]. Split at one character, which is far faster than a pattern."""
    return F.array_remove(F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " "), "")


def token_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, weight): a text's sparse vector of token counts."""
    return df.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("weight"))


def sparse_hits(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank): inner products of sparse vectors (id, token, weight), joined by token.

    Sums are partial before they are shuffled; a very common token's rows are split by adaptive skew joins.
    """
    q = queries.select(F.col("id").alias("query_id"), "token", F.col("weight").alias("asked"))
    hits = rows.join(q, "token").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("asked")).cast("double").alias("score"))
    return top_k(hits, k)


#: Bytes of sparse vectors that are packed as one row, about, and queries that are held as one matrix.
PACK, ASKED = 2 << 20, 64


def _packs(vectors: DataFrame) -> DataFrame:
    """(ids, sizes, tokens, weights), packed as bytes, of rows (id long, tokens array<int>, weights array<double>), about PACK bytes a row; ids by hash, so that packs are alike."""
    n = vectors.agg(F.ceil(F.sum(F.size("tokens").cast("long") * 12 + 12) / PACK)).first()[0] or 1
    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("pack"), "id", "tokens", "weights")
    dealt = dealt.repartition("pack").sortWithinPartitions("pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def packed() -> pa.RecordBatch:
            ids, sizes, tokens, weights = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([c.astype(t).tobytes()], pa.binary()) for c, t in ((ids, np.int64), (sizes, np.int32), (tokens, np.int32), (weights, np.float64))], names=["ids", "sizes", "tokens", "weights"])

        for batch in batches:
            packs, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(packs)) + 1, [packs.size]]) if packs.size else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if packs[i] != now and held:
                    yield packed()
                    held = []
                now = packs[i]
                tokens, weights = batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i)
                held.append((ids[i:j], tokens.value_lengths().to_numpy(zero_copy_only=False), tokens.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)))
        if held:
            yield packed()

    return dealt.mapInArrow(run, "ids binary, sizes binary, tokens binary, weights binary")


def vector_hits(queries: DataFrame, rows: DataFrame, scratch: Scratch, k: int = 5, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best inner products of sparse vectors (id long, tokens array<int>, weights array<double>), ties to the smaller id.

    All rows meet all queries, pack by pack, by products with the queries' columns: no row is sent for a (query, id),
    only the k best of a query in a pack of rows. Packs are written and read where they meet, so nothing is copied for
    every block of queries. Rows that share no token with a query are none of its hits.
    """
    asks = scratch.put(_packs(queries), "asks").withColumnsRenamed({c: f"q_{c}" for c in ("ids", "sizes", "tokens", "weights")})
    met = scratch.put(_packs(rows), "packs").repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))).crossJoin(asks)

    def best(ask: tuple, row: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q_ids, q_sizes, q_tokens, q_weights = ask
        ids, sizes, tokens, weights = row
        q_ends = np.cumsum(q_sizes)
        for low in range(0, q_ids.size, ASKED):
            high = min(low + ASKED, q_ids.size)
            part = slice(q_ends[low] - q_sizes[low], q_ends[high - 1])
            known, at = np.unique(q_tokens[part], return_inverse=True)
            columns = np.zeros((known.size + 1, high - low))
            columns[at, np.repeat(np.arange(high - low), q_sizes[low:high])] = q_weights[part]
            where = np.minimum(np.searchsorted(known, tokens), known.size - 1)
            hit = known[where] == tokens
            owner, where, weight = np.repeat(np.arange(ids.size), sizes)[hit], where[hit], weights[hit]
            score = np.zeros((ids.size, high - low))
            for start in range(0, where.size, 1 << 15):
                piece = columns[where[start : start + (1 << 15)]] * weight[start : start + (1 << 15), None]
                mine = owner[start : start + (1 << 15)]
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                score[mine[first]] += np.add.reduceat(piece, first, axis=0)
            score = np.where(score > 0, np.round(score, digits), -1.0).T
            order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            top = np.take_along_axis(score, order, 1)
            good = top >= 0
            yield np.repeat(q_ids[low:high], order.shape[1])[good.ravel()], ids[order][good], top[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int32, np.int32, np.float64)
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = [np.frombuffer(v, t) for v, t in zip(values, kinds * 2, strict=True)]
                for who, which, score in best(both[4:], both[:4]):
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(which), pa.array(score)], names=["query_id", "id", "score"])

    return top_k(met.mapInArrow(run, "query_id long, id long, score double"), k)


def squashed(score: Column, kind: str) -> Column:
    """Scores as 0 to 1: cosine (-1 to 1) or inner product (any)."""
    return (1 + score) / 2 if kind == "cosine" else 0.5 + F.atan(score) / F.lit(3.141592653589793)


def weighted(a: DataFrame, b: DataFrame, weights: tuple[float, float] = (0.5, 0.5), kinds: tuple[str, str] = ("cosine", "product"), k: int = 5, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the weighted sum of two legs' squashed scores; a leg without the row gives 0."""
    leg = lambda df, i: df.select("query_id", "id", squashed(F.col("score"), kinds[i]).alias("x"), F.lit(i).alias("leg"))
    part = lambda i: F.coalesce(F.max(F.when(F.col("leg") == i, F.col("x"))), F.lit(0.0))
    # halves go up as the double times the power of ten has them, not its decimal digits
    whole = F.floor((weights[0] * part(0) + weights[1] * part(1)) * 10.0**digits + 0.5) / F.lit(10.0**digits)
    both = leg(a, 0).unionByName(leg(b, 1)).groupBy("query_id", "id").agg(whole.alias("score"))
    return top_k(both, k)


def united(local: DataFrame, web: DataFrame) -> DataFrame:
    """(origin, content, title, chunk_id, url) of local rows (content, title, chunk_id) and web rows (content, snippet, title, url).

    A web row without content has its snippet. Rows without either, or with a blank local content, go; nulls are empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    a = local.select(F.lit("local").alias("origin"), stripped(text(F.col("content"))).alias("content"), stripped(text(F.col("title"))).alias("title"), "chunk_id")
    content = F.coalesce(F.nullif(F.col("content"), F.lit("")), stripped(text(F.col("snippet"))))
    b = web.select(F.lit("web").alias("origin"), content.alias("content"), stripped(text(F.col("title"))).alias("title"), stripped(text(F.col("url"))).alias("url"))
    return a.unionByName(b, allowMissingColumns=True).where("content <> ''").select("origin", "content", "title", "chunk_id", "url")
