"""Sessions over streams with arbitrary state: an open slot, the last messages, and an end after idle time.

Each session has a value state (its slot), a list state (its last messages) and an event-time timer that is moved
with every row; when the timer fires the states go and the session reports its end. State lies in RocksDB, so it
may be larger than memory. Rows of a session may come in any order and any cut into steps: order is by a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that these operators need, for streams started inside; the session's own afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Slots(StatefulProcessor):
    """Rows (session_id, place, kind, ts): an ask opens the slot, a clear empties it; a row behind the last place changes nothing."""

    def __init__(self, asks: tuple[str, ...], clears: tuple[str, ...], idle_ms: int | None):
        self.asks, self.clears, self.idle = asks, clears, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slot = handle.getValueState("slot", "last long, asked_at long, options string, version long")

    def _row(self, key: tuple, state: tuple, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "asked_at": pd.array([state[1]], "Int64"), "options": [state[2]], "version": [state[3]], "ended": [ended]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, asked_at, options, version = self.slot.get() if self.slot.exists() else (-1, None, None, 0)
        seen = None
        for frame in rows:
            top = frame["ts"].max()
            seen = top if seen is None else max(seen, top)
            told = frame[frame["kind"].isin(self.asks + self.clears)]
            if len(told):
                row = told.loc[told["place"].idxmax()]
                if row["place"] > last:
                    last = int(row["place"])
                    asked_at, options = (last, row["kind"]) if row["kind"] in self.asks else (None, None)
        state = (last, asked_at, options, version + 1)
        self.slot.update(state)
        if self.idle is not None and seen is not None:
            due = int(seen.timestamp() * 1000) + self.idle
            old = [t for t in self.handle.listTimers()]
            if not old or due > max(old):
                for t in old:
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.slot.get()
        # the number of updates stays, so that a session that comes again is newer than its end
        self.slot.update((state[0], None, None, state[3] + 1))
        yield self._row(key, (state[0], None, None, state[3] + 1), True)

    def close(self) -> None:
        pass


def slots(events: DataFrame, asks: tuple[str, ...], clears: tuple[str, ...], idle: int | None = None) -> DataFrame:
    """Updates (session_id, asked_at, options, version, ended) of events (session_id, place, kind, ts).

    asked_at and options tell the open slot, null for none. idle: milliseconds of event time without a row after
    which a session ends (ts must then have a watermark); None: never. Keep the largest version of a session.
    """
    rows = events.select("session_id", "place", "kind", "ts")
    shape = "session_id long, asked_at long, options string, version long, ended boolean"
    return rows.groupBy("session_id").transformWithStateInPandas(_Slots(asks, clears, idle), shape, "Update", "None" if idle is None else "EventTime")


class _Recent(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, as every read and write of state is a call of its own
        self.held = handle.getValueState("held", "version long, places array<long>, roles array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, places, roles = self.held.get() or (0, [], [])
        held = list(zip(places, roles, strict=True))
        for frame in rows:
            held = sorted([*held, *zip(frame["place"].tolist(), frame["role"].tolist(), strict=True)], key=lambda x: x[0])[-self.n :]
        places, roles = [p for p, _ in held], [r for _, r in held]
        self.held.update((version + 1, places, roles))
        yield pd.DataFrame({"session_id": key[0], "place": places, "role": roles, "version": version + 1})

    def close(self) -> None:
        pass


def recent(messages: DataFrame, n: int) -> DataFrame:
    """Updates (session_id, place, role, version) of messages (session_id, place, role): each gives the last n messages of a session anew."""
    return messages.select("session_id", "place", "role").groupBy("session_id").transformWithStateInPandas(_Recent(n), "session_id long, place long, role string, version long", "Update", "None")


def latest(updates: DataFrame) -> DataFrame:
    """The rows of each session's last update; steps that were written twice count once."""
    newest = F.max("version").over(Window.partitionBy("session_id"))
    return updates.distinct().withColumn("plumb_newest", newest).where("version = plumb_newest").drop("plumb_newest", "version")
