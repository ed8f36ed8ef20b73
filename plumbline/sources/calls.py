"""Data sources in Python: a log of model calls with numbers that survive restarts, and reports as Markdown tables.

    calls.register(spark)
    df.write.format("call_log").mode("append").save(path)
    spark.read.format("call_log").load(path)

A task writes its rows to a file of its own and tells the driver how many there are; the driver numbers them by
writing one commit file that names the tasks' files and their first numbers. Files without a commit do not exist for
readers, so a task that was tried twice or a job that failed leaves no rows. One writer at a time.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import masked_text

LOG = "seq long, stage string, prompt string, response string, error string, at timestamp"
#: Rows of a report, at most: it is a summary, and the driver writes it.
REPORT_ROWS = 10_000


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path there; a path without a scheme is a local or mounted one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _names(system: fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its file (none without rows) and the number of rows."""

    partition: int
    file: str | None
    rows: int


@dataclass
class Part(InputPartition):
    file: str
    first: int


class _LogWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = _place(self.path)
        number, name, n = TaskContext.get().partitionId(), None, 0
        sink = None
        for row in iterator:
            values = row.asDict()
            if sink is None:
                system.create_dir(f"{root}/rows", recursive=True)
                name = f"{uuid.uuid4().hex}.jsonl"
                sink = system.open_output_stream(f"{root}/rows/{name}")
            kept = {k: masked_text(values.get(k)) if k in ("prompt", "response") else values.get(k) for k in ("stage", "prompt", "response", "error")}
            kept["at"] = None if values.get("at") is None else values["at"].timestamp()
            sink.write(json.dumps(kept, ensure_ascii=False).encode() + b"\n")
            n += 1
        if sink:
            sink.close()
        return Written(number, name, n)

    def commit(self, messages: list) -> None:
        system, root = _place(self.path)
        system.create_dir(f"{root}/commits", recursive=True)
        before = _names(system, f"{root}/commits")
        last = json.loads(system.open_input_stream(before[-1]).read()) if before else {"number": 0, "next": 0}
        files, following = [], last["next"]
        for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
            files.append({"file": m.file, "first": following, "rows": m.rows})
            following += m.rows
        with system.open_output_stream(f"{root}/commits/{last['number'] + 1:012d}.json") as sink:
            # an overwrite hides what was there before; numbers go on all the same
            sink.write(json.dumps({"number": last["number"] + 1, "next": following, "files": files, "alone": self.overwrite}).encode())

    def abort(self, messages: list) -> None:
        system, root = _place(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{root}/rows/{m.file}")


class _LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        system, root = _place(self.path)
        parts: list[Part] = []
        for name in _names(system, f"{root}/commits"):
            told = json.loads(system.open_input_stream(name).read())
            parts = ([] if told["alone"] else parts) + [Part(f["file"], f["first"]) for f in told["files"]]
        return parts

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a log without commits
            return
        system, root = _place(self.path)
        kinds = {"seq": pa.int64(), "stage": pa.string(), "prompt": pa.string(), "response": pa.string(), "error": pa.string(), "at": pa.timestamp("us", "UTC")}
        schema, held, seq = pa.schema(list(kinds.items())), [], partition.first
        with io.BufferedReader(system.open_input_stream(f"{root}/rows/{partition.file}")) as source:
            for line in source:
                row = json.loads(line)
                held.append(row | {"seq": seq, "at": None if row["at"] is None else round(row["at"] * 1e6)})
                seq += 1
                if len(held) == 4096:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class CallLog(DataSource):
    """Model calls (stage, prompt, response, error, at) with seq, their numbers from 0; inline images in texts are masked."""

    @classmethod
    def name(cls) -> str:
        return "call_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> _LogReader:
        return _LogReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _LogWriter:
        return _LogWriter(self.options["path"], overwrite)


@dataclass
class Told(WriterCommitMessage):
    partition: int
    rows: list


class _ReportWriter(DataSourceWriter):
    def __init__(self, path: str, title: str, columns: list[str]):
        self.path, self.title, self.columns = path, title, columns

    def write(self, iterator: Iterator) -> Told:
        from pyspark import TaskContext

        rows = []
        for row in iterator:
            rows.append(["" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in row])
            if len(rows) > REPORT_ROWS:
                raise ValueError(f"a report has at most {REPORT_ROWS} rows")
        return Told(TaskContext.get().partitionId(), rows)

    def commit(self, messages: list) -> None:
        rows = [r for m in sorted((m for m in messages if m), key=lambda m: m.partition) for r in m.rows]
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"a report has at most {REPORT_ROWS} rows")
        safe = lambda cell: " ".join(cell.replace("|", "\\|").split())
        lines = ["| " + " | ".join(map(safe, r)) + " |" for r in [self.columns, ["---"] * len(self.columns), *rows]]
        system, root = _place(self.path)
        system.create_dir(root.rpartition("/")[0], recursive=True)
        with system.open_output_stream(root) as sink:
            sink.write("\n".join([*([f"# {self.title}", ""] if self.title else []), *lines, ""]).encode())

    def abort(self, messages: list) -> None:
        pass  # nothing is written before the commit


class Report(DataSource):
    """A small table as a Markdown file at path, under option title; rows in the order of their partitions."""

    @classmethod
    def name(cls) -> str:
        return "markdown_report"

    def writer(self, schema, overwrite: bool) -> _ReportWriter:
        if not overwrite:
            raise ValueError("a report is written whole: mode overwrite")
        return _ReportWriter(self.options["path"], self.options.get("title", ""), schema.names)


def register(spark: SparkSession) -> None:
    """Makes call_log and markdown_report known to the session."""
    spark.dataSource.register(CallLog)
    spark.dataSource.register(Report)
