"""Adapters for models: a function over Arrow batches with its model loaded once a task, and offline stand-ins.

Stand-ins let pipelines and tests run without a network; their scores have other scales than a real model's.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import tokens

DIMENSIONS = 64


def applied(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], added: str, batch: int = 16, attempts: int = 3, delay: float = 0.5, error: str | None = None) -> DataFrame:
    """df with the columns that a model adds (as DDL). load runs once a task.

    A batch that fails is tried again, after delay seconds, then twice as long, and so on; after the last attempt it
    passes with nulls, and with the exception's text in the column that error names, if any.
    """
    names = [part.split()[0] for part in added.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch].reset_index(drop=True)
                made, failed = None, None
                for attempt in range(attempts):
                    try:
                        made = model(some)[names].reset_index(drop=True)
                        break
                    except Exception as e:  # a model's failure costs its batch, not the job
                        failed = repr(e)
                        if attempt + 1 < attempts:
                            time.sleep(delay * 2**attempt)
                if made is None:
                    logging.getLogger(__name__).warning("a batch of %d rows failed %d times: %s", len(some), attempts, failed)
                    made = pd.DataFrame({n: [None] * len(some) for n in names})
                    made[error or "plumb_error"] = failed
                elif error:
                    made[error] = None
                yield pd.concat([some, made[names + ([error] if error else [])]], axis=1)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{shape}, {added}" + (f", {error} string" if error else ""))


def hashed_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A unit vector of signed token hashes; no tokens: zeros. Built-in functions only."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    at = lambda h: F.pmod(h, F.lit(dimensions))
    sign = lambda h: F.when(F.shiftright(h, 40) % 2 == 0, 1.0).otherwise(-1.0)
    sums = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(F.filter(hashes, lambda h: at(h) == i), F.lit(0.0), lambda a, h: a + sign(h)))
    return F.transform(F.array(sums), lambda v: F.transform(v, lambda x: F.coalesce(x / F.nullif(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)), F.lit(0.0)), F.lit(0.0)).cast("float")))[0]


def sparse_embeddings(df: DataFrame, id_col: str, text_col: str, bits: int = 24, digits: int = 6) -> DataFrame:
    """(id_col, vector): a text's sparse vector as a map from token number to weight, in place of a learned sparse encoder.

    A token's number is the first bits of its MD5; its weight is ln(1 + count), by the norm of the vector. Texts
    without tokens and null texts have no row. Built-in functions only.
    """
    counted = df.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token"))
    number = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, bits // 4), 16, 10).cast("int")
    weighed = counted.select("id", number.alias("token")).groupBy("id", "token").agg(F.log1p(F.count("*")).alias("weight"))
    entries = F.collect_list(F.struct("token", "weight"))
    vectors = weighed.groupBy("id").agg(entries.alias("entries"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    scaled = F.transform("entries", lambda x: F.struct(x["token"], F.round(x["weight"] / F.col("norm"), digits).cast("double")))
    return vectors.select(F.col("id").alias(id_col), F.map_from_entries(scaled).alias("vector"))


def overlap_score(question: Column, content: Column, low: float = -7.0, high: float = 5.0) -> Column:
    """The share of a question's words that the content has, on the scale of a cross-encoder."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    share = F.size(F.array_intersect(words(question), words(content))) / F.nullif(F.size(words(question)), F.lit(0))
    return F.coalesce(low + (high - low) * share, F.lit(low))
