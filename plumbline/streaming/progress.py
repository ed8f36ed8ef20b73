"""Task progress and windows over event streams, with watermarks; batch twins are in the plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: State of a task without events is dropped after this long.
TTL = "2 hours"
OUT = "task_id long, done string, status string, last_seen timestamp"
STATE = "done string, status string, last_seen timestamp"


def events_stream(spark: SparkSession, path: str, files_a_step: int = 1) -> DataFrame:
    """A folder of event files as a stream, ts as a timestamp with a watermark of one TTL."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_step).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", TTL)


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds finished nodes and keeps the latest status; a task that timed out reports once and goes."""
    done, status, seen = state.get if state.exists else ("", "processing", pd.Timestamp(0))
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], done, "expired", seen)], columns=["task_id", "done", "status", "last_seen"])
        return
    names = set(filter(None, done.split(",")))
    for batch in batches:
        batch = batch.sort_values(["ts", "event_id"])
        names |= set(batch.event_type[batch.event_type.isin(["click", "view"])])
        ends = batch.event_type[batch.event_type.isin(["error", "purchase"])]
        if len(ends) and batch.ts.max() >= seen:
            status = "failed" if ends.iloc[-1] == "error" else "completed"
        seen = max(seen, batch.ts.max())
    state.update((",".join(sorted(names)), status, seen))
    state.setTimeoutTimestamp(max(int(seen.timestamp() * 1000), state.getCurrentWatermarkMs()) + 7_200_000)
    yield pd.DataFrame([(key[0], ",".join(sorted(names)), status, seen)], columns=["task_id", "done", "status", "last_seen"])


def task_progress(events: DataFrame) -> DataFrame:
    """Updates of (task_id, done, status, last_seen), state keyed by task and ended by event time."""
    rows = events.select(F.col("user_id").alias("task_id"), "event_id", "event_type", "ts")
    return rows.groupBy("task_id").applyInPandasWithState(_advance, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """(task_id, done, last_seen) of all updates, expiries included: the names of all of them, whatever files they came in."""
    names = updates.select("task_id", "last_seen", F.explode(F.split("done", ",")).alias("name"))
    seen = names.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("name") != "", F.col("name")))), ",").alias("done"), F.max("last_seen").alias("last_seen"))
    return seen.withColumn("done", F.when(F.col("done") != "", F.col("done")))


def windowed_counts(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Events and their value by window and type; late ones within the watermark count."""
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
