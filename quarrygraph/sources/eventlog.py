"""An append-only event log as a Python data source: files named by the times that they hold, read as far as they are wanted.

Writers share a folder and no file: each task writes its rows to a hidden file, and the commit renames the files of all
tasks into the log under names that say the least and the largest time, so a reader sees an append as a whole file or not
at all, and no lock is needed. A reader plans one partition a file, leaves out files whose times lie before the wanted
ones, and parses the rest line by line; torn and odd lines are skipped. Times are pushed down from since and, where
Spark's filter pushdown for Python sources is on, from where(ts >= ...).

Paths may have a scheme (file, hdfs, s3), as pyarrow reads them.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, WriterCommitMessage

from quarrygraph.sources.logs import LOG

NAME = re.compile(r"log_(-?[0-9.e+-]+)_(-?[0-9.e+-]+)_[0-9a-f]{32}\.jsonl$")
_KINDS = {"string": str, "double": (int, float), "boolean": bool}
FIELDS = [tuple(f.strip().split(" ")) for f in LOG.split(",")]


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, str]]:
    """(name, whole path) of the log's files, hidden ones left out; a log that is not there is empty."""
    from pyarrow import fs

    system, at = _fs(path)
    return sorted((x.base_name, x.path) for x in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.is_file and x.base_name[:1] not in "._")


def parsed(line: bytes, since: float) -> tuple | None:
    """A line's fields, null for a torn one, one without a time, and one before since; a field of another kind is null."""
    try:
        row = json.loads(line)
    except ValueError:
        return None
    at = row.get("ts") if isinstance(row, dict) else None
    if not isinstance(at, (int, float)) or isinstance(at, bool) or not math.isfinite(at) or at < since:
        return None
    out = []
    for name, kind in FIELDS:
        v = row.get(name)
        fits = isinstance(v, _KINDS[kind]) and not (kind == "double" and isinstance(v, bool))
        out.append(float(v) if fits and kind == "double" else v if fits else None)
    return tuple(out)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, since: float):
        self.path, self.since = path, since

    def partitions(self):
        wanted = []
        for name, path in _listed(self.path):
            told = NAME.match(name)
            if told is None or float(told[2]) >= self.since:
                wanted.append(_File(path))
        return wanted or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = _fs(self.path)
        with system.open_input_stream(partition.path) as stream:
            rest = b""
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from filter(None, (parsed(x, self.since) for x in lines))
            if rest and (row := parsed(rest, self.since)) is not None:
                yield row


class _Pushed(_Reader):
    """The same where Spark's filter pushdown for Python sources is on, as it refuses a reader with pushFilters else."""

    def pushFilters(self, filters: list[Filter]):
        """The least time that any filter on ts lets through; all filters are checked again by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("ts",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.since = max(self.since, float(f.value))
            yield f


class _Written(WriterCommitMessage):
    def __init__(self, hidden: str | None, name: str | None):
        self.hidden, self.name = hidden, name


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> _Written:
        system, at = _fs(self.path)
        system.create_dir(at)
        token = uuid.uuid4().hex
        hidden, low, high, stream = f"{at}/.{token}.part", math.inf, -math.inf, None
        for row in rows:
            if row["ts"] is None:
                continue
            stream = stream or system.open_output_stream(hidden)
            low, high = min(low, row["ts"]), max(high, row["ts"])
            stream.write(json.dumps({k: v for k, v in row.asDict().items() if v is not None}).encode() + b"\n")
        if stream is None:
            return _Written(None, None)
        stream.close()
        return _Written(hidden, f"log_{low!r}_{high!r}_{token}.jsonl")

    def commit(self, messages) -> None:
        system, at = _fs(self.path)
        for m in messages:
            if m is not None and m.hidden:
                system.move(m.hidden, f"{at}/{m.name}")

    def abort(self, messages) -> None:
        system, _ = _fs(self.path)
        for m in messages:
            if m is not None and m.hidden:
                system.delete_file(m.hidden)


class EventLog(DataSource):
    """spark.read.format("eventlog").option("since", seconds).load(path), df.write.format("eventlog").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> DataSourceReader:
        made = _Pushed if self.options.get("pushdown", "") == "true" else _Reader
        return made(self.options["path"], float(self.options.get("since", "-inf")))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("an event log is only appended to")
        return _Writer(self.options["path"])


def read(spark: SparkSession, path: str, since: float | None = None) -> DataFrame:
    """Rows of LOG from since on."""
    spark.dataSource.register(EventLog)
    r = spark.read.format("eventlog").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (r if since is None else r.option("since", repr(float(since)))).load(path).where("true" if since is None else f"ts >= {float(since)!r}D")


def append(rows: DataFrame, path: str) -> None:
    """One append: all of its files or, if it fails, none of them. Fields that rows lack are null; rows without a time are left out."""
    rows.sparkSession.dataSource.register(EventLog)
    known = set(rows.columns)
    rows.selectExpr(*[f"cast({n if n in known else 'null'} as {k}) as {n}" for n, k in FIELDS]).write.format("eventlog").mode("append").save(path)
