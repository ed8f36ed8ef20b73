"""The corpus pipeline: toxic documents go, of near duplicates one stays, repeated passages and leaked documents go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written
as Parquet and read again. Nulls, empty texts, repeated rows and empty tables have the results that the
operators' docstrings state; all stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, minhash_dedup, suffix_dedup, toxicity
from plumbline.llm.shared import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels outside the held-out fold."""
    return toxicity.without_toxic(docs, toxicity.learnt(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, that with the smallest id stays."""
    return minhash_dedup.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every string of 100 bytes that occurs earlier; a character cut in two goes whole. n_chars follows."""
    return suffix_dedup.with_repeats_cut(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 80 per cent of a benchmark item's five-word shingles go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes for every remaining document."""
    return bpe.round_trip(docs, bpe.public_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: SQL cannot express the toxicity model or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs, name)
    return docs
