"""Dense search over inverted lists: rows by their nearest centroid, a few lists probed for each query, exact products there.

Exact search (search.dense_hits) is the default; this one looks at a share of the rows and may miss some hits.
Centroids are fitted on a bounded sample; every row is in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .search import BLOCK, products, top_k

#: Rows on which centroids are fitted, at most; rows of a list that one task takes.
SAMPLE, SLICE = 20_000, 50_000


@dataclass(frozen=True)
class Lists:
    """rows (list, id, vector), a folder for each list, and the centroids by number."""

    rows: DataFrame
    centroids: np.ndarray
    scratch: Scratch

    def drop(self) -> None:
        self.scratch.drop()


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means: unit centroids of the unit rows of x. Empty ones move to the row that fits worst."""
    x = _unit(x)
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ centroids.T
        at = near.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        counts = np.bincount(at, minlength=len(centroids))
        worst = np.argsort(near.max(1), kind="stable")
        sums[counts == 0] = x[worst[: int((counts == 0).sum())]]
        centroids = _unit(sums)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _nearest(centroids: np.ndarray, n: int):
    """(id, vector) to (list, id, vector): the n nearest lists of each, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                near = np.argsort(-(_matrix(some.column(1)) @ centroids.T), axis=1, kind="stable")[:, :n]
                row = pa.array(np.repeat(np.arange(some.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), some.column(0).take(row), some.column(1).take(row)], names=["list", "id", "vector"])

    return run


def indexed(rows: DataFrame, lists: int = 64, sample: int = SAMPLE, seed: int = 0) -> Lists:
    """The lists of rows (id, vector), written in the shared folder. All vectors have one length; null ids and vectors take no part.

    Centroids come from the sample rows of least hash (all, if there are no more); a zero vector goes to the first list.
    """
    good = rows.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    picked = good.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vector").toArrow()
    flat = picked.column(0).combine_chunks()
    centroids = k_means(_matrix(flat), lists, seed=seed) if len(flat) else np.zeros((1, 1))
    scratch = Scratch(rows.sparkSession, "lists")
    placed = good.mapInArrow(_nearest(centroids, 1), "list int, id long, vector array<float>")
    return Lists(scratch.put(placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))), "rows", by="list").select("list", "id", "vector"), centroids, scratch)


def hits(index: Lists, queries: DataFrame, k: int = 5, probes: int = 8, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): the k best cosines among the rows of each query's nearest lists; ties go to the smaller id.

    queries have id and vector, and are dealt into blocks of about BLOCK. A long list is cut into slices of SLICE
    rows, so none lies in one task; lists that no query probes are not read.
    """
    asked = queries.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    probed = Scratch(queries.sparkSession, "probes").put(asked.mapInArrow(_nearest(index.centroids, probes), "list int, id long, vector array<float>"), "probed")
    blocks = max(1, -(-asked.count() // BLOCK))
    slices = index.rows.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))  # a row for each list
    block = lambda part: F.struct("list", part.alias("part"))
    wanted = probed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    q = wanted.join(F.broadcast(slices), "list").select(block(F.col("part")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("asks"), "id", "vector")
    parts = F.broadcast(wanted.select("list", "part").distinct())  # under lists times blocks
    r = index.rows.join(parts, "list").join(F.broadcast(slices), "list").select(block(F.col("part")).alias("block"), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.lit(False).alias("asks"), "id", "vector")
    return top_k(products(q.unionByName(r), k, digits), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact hits (query_id, id) that are among those found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return float(hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0])
