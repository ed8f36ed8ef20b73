"""Rank fusion, cliff cutoff, confidence gate, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Constants of the ranking rules.
RRF_K = 60
LEG_WEIGHTS = {"vector": 1.0, "hyde": 1.0, "kg": 0.7}
CLIFF = {"most": 10, "least": 3, "gap": 0.5, "ratio": 0.25}
GATE = {"reject_below": 0.0, "note_below": 2.0}


def fused(legs: DataFrame, weights: dict[str, float] = LEG_WEIGHTS, k: int = RRF_K, top: int = 10, digits: int = 9, payload: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score, rank) from (query_id, leg, rank, id): sum over legs of weight / (k + rank).

    Legs are named columns added in the order of weights, so sums do not depend on row order. Ties go to
    the first leg's and then the best rank, then the id. top 0: all. payload: columns of the hits that the result
    carries, as the first leg in the order of weights that has the id gave them.
    """
    names = list(weights)
    worst = 1 << 30
    part = lambda n: F.min(F.when(F.col("leg") == n, F.col("rank")))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("leg"))
    told = [F.min_by(F.struct(*payload), F.struct(place, F.col("rank"))).alias("payload")] if payload else []
    wide = legs.where(F.col("id").isNotNull() & F.col("leg").isin(*names)).groupBy("query_id", "id").agg(*(part(n).alias(f"r_{n}") for n in names), *told)
    score = sum((F.coalesce(F.lit(weights[n]) / (F.col(f"r_{n}") + k), F.lit(0.0)) for n in names), F.lit(0.0))
    order = [F.desc("score"), *(F.coalesce(f"r_{n}", F.lit(worst)) for n in names), "id"]
    ranked = wide.withColumn("score", F.round(score, digits)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return (ranked.where(F.col("rank") <= top) if top else ranked).select("query_id", "id", "score", "rank", *(F.col("payload")[c].alias(c) for c in payload))


def cliff_cut(ranked: DataFrame, most: int = CLIFF["most"], least: int = CLIFF["least"], gap: float = CLIFF["gap"], ratio: float = CLIFF["ratio"]) -> DataFrame:
    """The rows of (query_id, rank, score) up to the first cliff: a drop of gap, or of ratio of the larger score, after rank least or later."""
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    whole = Window.partitionBy("query_id")
    upper = F.least(F.lit(most), F.count("*").over(whole))
    lower = F.least(F.lit(least), upper)
    after = F.lead("score").over(by_rank)
    drop = F.col("score") - after
    steep = (drop >= gap) | ((F.lit(ratio) > 0) & (drop / F.greatest(F.abs("score"), F.abs(after), F.lit(1e-6)) >= ratio))
    seen = ranked.withColumn("plumb_cut", F.when(steep & (F.col("rank") >= lower) & (F.col("rank") < upper), F.col("rank"))).withColumn("plumb_upper", upper)
    cut = F.coalesce(F.min("plumb_cut").over(whole), F.col("plumb_upper"))
    return seen.withColumn("plumb_to", cut).where(F.col("rank") <= F.col("plumb_to")).drop("plumb_cut", "plumb_upper", "plumb_to")


def gated(queries: DataFrame, ranked: DataFrame, reject_below: float = GATE["reject_below"], note_below: float = GATE["note_below"]) -> DataFrame:
    """Per query: decision fallback (no rows, no score, or a first score under reject_below), notice (under note_below) or answer."""
    first = ranked.where("rank = 1").select("query_id", F.col("score").alias("top_score"))
    s = F.col("top_score")
    decision = F.when(s.isNull() | (s < reject_below), "fallback").when(s < note_below, "notice").otherwise("answer")
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", "top_score", decision.alias("decision"))


def metrics(cases: DataFrame, ranked: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5), digits: int = 6) -> DataFrame:
    """Per case of (query_id, expected array): hit and recall at each cutoff, and mrr and ndcg at the last.

    A repeated hit counts again for recall; the ideal order is that of the gains found.
    """
    wanted = cases.select("query_id", F.size("expected").alias("wanted"))
    return pair_metrics(wanted, cases.select("query_id", F.explode("expected").alias("id")), ranked, cutoffs, digits)


def pair_metrics(wanted: DataFrame, pairs: DataFrame, ranked: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5), digits: int = 6) -> DataFrame:
    """metrics() of the number wanted of each query_id and a row (query_id, id) for each expected id."""
    last = max(cutoffs)
    hit = pairs.select("query_id", "id").distinct().withColumn("gain", F.lit(1))
    got = ranked.where(F.col("rank") <= last).join(hit, ["query_id", "id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    at = lambda k, f: F.coalesce(f(F.when(F.col("rank") <= k, F.col("gain"))), F.lit(0))
    dcg = F.sum(F.col("gain") / F.log2(F.col("rank") + 1))
    each = got.groupBy("query_id").agg(*(at(k, F.max).alias(f"hit_{k}") for k in cutoffs), *(at(k, F.sum).alias(f"gain_{k}") for k in cutoffs), F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"), dcg.alias("dcg"), F.sum("gain").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    all_ = wanted.join(each, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    r = lambda c: F.round(zero(c.cast("double")), digits)
    recall = lambda k: F.when(F.col("wanted") > 0, F.col(f"gain_{k}") / F.col("wanted"))
    ndcg = F.when(F.col("n") > 0, F.col("dcg") / ideal)
    return all_.select("query_id", *(r(F.col(f"hit_{k}")).alias(f"hit_{k}") for k in cutoffs), *(r(recall(k)).alias(f"recall_{k}") for k in cutoffs), r(1 / F.col("first")).alias("mrr"), r(ndcg).alias("ndcg"))
