"""Sessions kept in state over streams split into files, against their batch twins; timers."""

import datetime
import random

from pyspark.sql import functions as F

from plumbline.plans import document_queries
from plumbline.plans.document_queries import _drained
from plumbline.streaming import sessions

BASE = datetime.datetime(2024, 1, 1)
EVENTS = "session_id long, place long, kind string, ts timestamp"


def in_files(spark, rows, shape, path, cut):
    for i in range(0, len(rows), cut):
        spark.createDataFrame(rows[i : i + cut], shape).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_slots_over_files(spark, tmp_path):
    random.seed(61)
    rows = [(random.randrange(6), i, random.choice(["click", "view", "signup", "other"]), BASE + datetime.timedelta(minutes=i)) for i in range(120)]
    random.shuffle(rows)  # a later file may hold earlier places
    with sessions.rocks(spark):
        got = sessions.latest(_drained(sessions.slots(in_files(spark, rows, EVENTS, tmp_path / "e", 25), ("click", "view"), ("signup",)), "update")).collect()
    want = {}
    for s, place, kind, _ in sorted(rows, key=lambda r: r[1]):
        if kind != "other":
            want[s] = (place, kind) if kind != "signup" else (None, None)
    assert {r.session_id: (r.asked_at, r.options) for r in got} == want


def test_last_messages_over_files(spark, tmp_path):
    random.seed(62)
    rows = [(random.randrange(4), i, random.choice(["user", "assistant"])) for i in range(60)]
    random.shuffle(rows)
    with sessions.rocks(spark):
        got = sessions.latest(_drained(sessions.recent(in_files(spark, rows, "session_id long, place long, role string", tmp_path / "m", 13), 5), "update")).collect()
    want = sorted((s, p, r) for s in range(4) for s2, p, r in sorted((x for x in rows if x[0] == s), key=lambda x: x[1])[-5:])
    assert sorted((r.session_id, r.place, r.role) for r in got) == want


def test_idle_sessions_end_and_come_again(spark, tmp_path):
    at = lambda h: BASE + datetime.timedelta(hours=h)
    steps = [[(1, 1, "click", at(0)), (2, 2, "view", at(0))], [(2, 3, "other", at(1))], [(3, 4, "click", at(9))], [(3, 5, "other", at(10))], [(1, 6, "view", at(11))]]
    for k, step in enumerate(steps):
        spark.createDataFrame(step, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e").withWatermark("ts", "10 minutes")
    with sessions.rocks(spark):
        updates = _drained(sessions.slots(stream, ("click", "view"), ("signup",), idle=2 * 3_600_000), "update")
    assert {r.session_id for r in updates.where("ended").collect()} == {1, 2}
    got = {r.session_id: (r.asked_at, r.options) for r in sessions.latest(updates).collect()}
    assert got == {1: (6, "view"), 2: (None, None), 3: (4, "click")}


def test_the_sessions_store_setting_is_put_back(spark):
    before = spark.conf.get(sessions._PROVIDER, None)
    with sessions.rocks(spark):
        assert "RocksDB" in spark.conf.get(sessions._PROVIDER)
    assert spark.conf.get(sessions._PROVIDER, None) == before


def test_a_repeated_step_counts_once(spark):
    rows = spark.createDataFrame([(1, 5, "user", 1), (1, 5, "user", 1), (1, 5, "user", 2), (1, 6, "user", 2), (1, 6, "user", 2)], "session_id long, place long, role string, version long")
    assert sorted(map(tuple, sessions.latest(rows).select("place", "role").collect())) == [(5, "user"), (6, "user")]
    assert sessions.latest(rows.where(F.lit(False))).count() == 0


def test_small_files_share_a_step(spark, tmp_path, monkeypatch):
    for i in range(5):
        spark.createDataFrame([(1, i, "user", "t")], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    seen = []
    monkeypatch.setattr(document_queries, "_drained", lambda df, mode: seen.append(_drained(df, mode)) or seen[-1])
    got = document_queries.stream_recent_messages(spark, str(tmp_path)).collect()
    assert sorted(r.place for r in got) == [1, 2, 3, 4]
    assert {r.version for r in seen[0].collect()} == {1}
