"""7. Toxicity by maximum-scoring segments.

Labelled documents give each token the log-odds of the toxic class under a Dirichlet prior, shrunk by its
standard error. A text is scanned once (Ruzzo and Tompa, 1999) for all maximal segments of token score less
DRIFT; extreme-value statistics (Karlin and Altschul, 1990) say how unusual the best is for a text of that
length; a logistic curve fitted on other labelled documents turns this into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, fold, table
from .vecbytes import LOWER, Hasher, U, blocks, raw, words

#: Tokens are hashed to so many classes; so the model has at most so many weights, whatever the vocabulary.
CLASSES = 1 << 20
#: Labelled documents that the model is fitted on, at most: those with the smallest hashes of their ids.
LABELLED = 100_000
#: A token's classes: the whole word, and its first bytes, so that inflected and compound forms share evidence.
STEMS = (5, 6, 7, 8, 9, 10)
#: Cost of every token in a segment.
DRIFT = 0.1
#: Prior weight in tokens that is shared out by background frequency, and what every class has besides.
PRIOR, FLOOR = 500.0, 0.5
#: A weight is its distance from zero less so many standard errors.
ERRORS = 2.5
#: Segments of at most this chance in a clean text of the same length are significant.
CHANCE = 0.05
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], int]:
    """Starts, ends and row of the runs of letters and digits, A-Z lower-cased; which tokens have a class of each sort, and it; the number of rows."""
    data, offsets = raw(column)
    data = LOWER[data]
    starts, ends, row = words(data, offsets, _TOKEN[data])
    hashed, every = Hasher(data), np.arange(len(starts))
    kinds = [(every, (hashed(starts, ends) >> U(44)).astype(np.int64))]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        kinds.append((long, ((hashed(starts[long], starts[long] + n) * U(2 * n + 1)) >> U(44)).astype(np.int64)))
    return starts - offsets[row], ends - offsets[row], row, kinds, len(offsets) - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (kind, toxic, n): tokens by class, added up in the task."""
    n = np.zeros((2, CLASSES), np.int64)
    for batch in batches:
        for block in blocks(batch, "text"):
            _, _, row, kinds, _ = tokens(block.column(1))
            toxic = block.column(0).to_numpy(zero_copy_only=False).astype(bool)[row]
            for at, kind in kinds:
                for t in (0, 1):
                    n[t] += np.bincount(kind[toxic[at] == t], minlength=CLASSES)
    for t in (0, 1):
        at = np.flatnonzero(n[t])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), t, np.int32)), pa.array(n[t][at])], names=["kind", "toxic", "n"])


def segments(at: list[int], weight: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first token, last token, score): at and weight give the tokens above zero, every token costs DRIFT.

    Linear time: each candidate looks back to the nearest one that starts lower, and joins up if it ends higher.
    """
    held: list[list] = []  # first, last, sum before, sum after, index of the nearest candidate that starts lower
    total, before = 0.0, -1
    for i, w in zip(at, weight, strict=True):
        total -= DRIFT * (i - before - 1)
        before = i
        low, high, first = total, total + w - DRIFT, i
        total = high
        if high <= low:
            continue
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append([first, i, low, high, j])
                break
            first, low = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, high - low) for a, b, low, high, _ in held]


@dataclass(frozen=True)
class Model:
    """Weights above zero by class, the rate and size of clean texts' best segments, and the logistic curve."""

    kinds: np.ndarray
    weights: np.ndarray
    rate: float = 1.0
    log_size: float = 0.0
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def weighed(self, column: pa.Array) -> Iterator[tuple[int, list[int], list[float], list[tuple[int, int]]]]:
        """For every row: its number of tokens; of those above DRIFT the place, the largest weight of their classes, and the bytes."""
        starts, ends, row, kinds, rows = tokens(column)
        weight = np.zeros(len(starts))
        for at, kind in kinds:
            if len(self.kinds):
                near = np.minimum(np.searchsorted(self.kinds, kind), len(self.kinds) - 1)
                hit = self.kinds[near] == kind
                weight[at[hit]] = np.maximum(weight[at[hit]], self.weights[near[hit]])
        hit = np.flatnonzero(weight > DRIFT)
        first = np.searchsorted(row, np.arange(rows + 1))
        cut = np.searchsorted(row[hit], np.arange(rows + 1))
        for i in range(rows):
            own = hit[cut[i] : cut[i + 1]]
            yield int(first[i + 1] - first[i]), (own - first[i]).tolist(), weight[own].tolist(), list(zip(starts[own].tolist(), ends[own].tolist(), strict=True))

    def chance(self, score: float, size: int) -> float:
        """That a clean text of so many tokens has a segment of at least this score."""
        e = self.rate * score - math.log(size) - self.log_size
        return -math.expm1(-math.exp(min(-e, 50.0)))

    def found(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float, float]]]]:
        """For every row: its number of tokens, and its segments with byte offsets, score and chance."""
        for size, at, weight, spans in self.weighed(column):
            place = dict(zip(at, spans, strict=True))
            yield size, [(place[a][0], place[b][1], s, self.chance(s, size)) for a, b, s in segments(at, weight)]

    def features(self, size: int, found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """Of the best segment its extreme-value statistic, and the log of what all significant ones score."""
        best = max((s for _, _, s, _ in found), default=0.0)
        e = self.rate * best - math.log(max(size, 1)) - self.log_size
        return max(-5.0, min(e, 20.0)), math.log1p(sum(s for _, _, s, p in found if p <= CHANCE))

    def score(self, size: int, found: list[tuple[int, int, float, float]]) -> float:
        x = self.features(size, found)
        return 1 / (1 + math.exp(-(self.curve[0] + self.curve[1] * x[0] + self.curve[2] * x[1])))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a slight ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(b)), x.T @ (y - p) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, b))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents of docs (at most LABELLED).

    Documents with crc32 of the id even or 1 mod 4 give weights, the others the calibration. Of equal texts one counts.
    An id with several labels has the largest. No labels, or one class only: a model that scores all alike.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("plumb_id")).agg(F.max(F.col(label_col).cast("int")).alias("plumb_toxic"))
    known = known.orderBy(F.xxhash64("plumb_id"), "plumb_id").limit(LABELLED)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(known), F.col("id") == F.col("plumb_id"))
    rows = rows.select("id", F.col("plumb_toxic").alias("toxic"), "text")
    unique = rows.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.min("id").alias("keep")).select("keep").distinct()
    rows = rows.join(F.broadcast(unique), F.col("id") == F.col("keep")).drop("keep")

    counts = rows.where(fold("id", 4) != 3).select("toxic", "text").mapInArrow(_counts, "kind long, toxic int, n long")
    counts = counts.groupBy("kind").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    counts = Scratch(docs.sparkSession, "toxic").put(counts, "counts")
    n_t, n_c, n = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not n_t or not n_c:
        share = float(n_t > 0) if n else 0.1
        return Model(np.zeros(0, np.int64), np.zeros(0), curve=(math.log((share + 0.01) / (1.01 - share)), 0.0, 0.0))
    prior = FLOOR + PRIOR * (F.col("t") + F.col("c")) / (n_t + n_c)
    odds = lambda x, of: F.log((F.col(x) + prior) / (of + FLOOR * n + PRIOR - F.col(x) - prior))
    weight = odds("t", n_t) - odds("c", n_c) - ERRORS * F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    up = counts.select("kind", weight.alias("weight")).where(F.col("weight") > DRIFT).orderBy("kind").collect()  # CLASSES rows at most
    model = Model(np.array([r.kind for r in up], np.int64), np.array([r.weight for r in up], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                every = [(size, w, [s for *_, s in segments(at, w)]) for size, at, w, _ in model.weighed(block.column(1))]
                some = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([x[0] for x in every], pa.int64()), pa.array([x[1] for x in every], some), pa.array([x[2] for x in every], some)], names=["toxic", "size", "above", "sums"])

    tried = rows.where(fold("id", 4) == 3).select("toxic", "text").mapInArrow(run, "toxic int, size long, above array<double>, sums array<double>").toPandas()  # under LABELLED rows
    if not 0 < tried.toxic.sum() < len(tried):
        return model
    clean = tried[tried.toxic == 0]
    above, total = np.concatenate([np.zeros(0), *clean.above]), max(int(clean["size"].sum()), 1)

    def excess(rate: float) -> float:
        return float(np.exp(rate * (above - DRIFT)).sum() + (total - len(above)) * math.exp(-rate * DRIFT)) / total - 1

    low, high = 1e-6, 1.0
    while len(above) and excess(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(100 if len(above) else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    best = np.array([max(s, default=0.0) for s in clean.sums])
    log_size = float((high * best - np.log(np.maximum(clean["size"].to_numpy(), 1))).mean()) - 0.5772156649  # of the Gumbel mean
    model = Model(model.kinds, model.weights, high, log_size)
    x = np.array([model.features(n, [(0, 0, s, model.chance(s, n)) for s in sums]) for n, sums in zip(tried["size"], tried.sums, strict=True)])
    return Model(model.kinds, model.weights, high, log_size, _logistic(x, tried.toxic.to_numpy(float)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, score (0 to 1), and passages: significant segments as (start, end, score, chance), in bytes.

    One pass, no shuffle. Null and empty texts have no token and the score of a text in which nothing is
    found. Rows that repeat are scored as often as they come; texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))
        for batch in batches:
            for block in blocks(batch, "text"):
                every = list(model.found(block.column(1)))
                passages = [[dict(zip(("start", "end", "score", "chance"), s, strict=True)) for s in found if s[3] <= CHANCE] for _, found in every]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([model.score(*x) for x in every], pa.float64()), pa.array(passages, kind)], names=["id", "score", "passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, passages array<struct<start: long, end: long, score: double, chance: double>>")
    return out.withColumnRenamed("id", id_col)


#: Documents with at least this score are toxic.
TOXIC_AT = 0.3


def learnt(spark, sf_dir: str) -> Model:
    """The model of the labels outside the held-out fold (crc32 of doc_id mod 4 = 2)."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold("doc_id", 4) != 2)
    return fitted(table(spark, sf_dir, "documents", "doc_id", "text"), labels)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, unchanged, whose id has no text that scores TOXIC_AT or more."""
    bad = scored(docs, model).where(F.col("score") >= TOXIC_AT).select(F.col("doc_id").alias("plumb_gone")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("plumb_gone")), "left_anti")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents", "doc_id", "text"), learnt(spark, sf_dir))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
