"""Sessions for local work, and making the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of rows that a Python worker gets at a time, at most (or one row); Spark's own bound is 10,000 rows, whatever their size.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's folder to the Python path that workers start with (a cluster may have it installed besides), and bounds their batches.

    A smaller bound that the session has stays.
    """
    if not 0 < int(spark.conf.get(_BATCH, str(2**31 - 1)).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *known]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, one of our own, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, with the settings that tests and the bench share."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("plumbline")
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory}
    spark = builder.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
