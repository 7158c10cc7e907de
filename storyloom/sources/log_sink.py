"""An append-only log as a Python data source: writes that are whole or absent, in batch and as a stream's sink.

``df.write.format("upsert_log").option("path", folder).mode("append").save()``. Each task writes a file of its own and names it in
its commit message; the driver's commit puts all names into one file of ``commits``, written aside and moved into place.
Readers take the files that commits name. A failed job's files are deleted on abort; those of a lost executor, or of a
task that was still at work then, are named nowhere and never read, and ``Log.sweep`` deletes them. Option ``batch`` names a write, and a name that was committed before adds nothing;
a stream's batches are named by their query's ``name`` option and number, so that one that is run again adds nothing.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, local or with a scheme, and the path in it."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class Log:
    """The files of a log and its commits."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        place, base = place_of(self.path)
        name, out, rows = f"rows/{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in batches:
                if out is None:
                    place.create_dir(f"{base}/rows", recursive=True)
                    out = pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=place)
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                place.delete_file(f"{base}/{name}")
            raise
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, rows)

    def commit(self, messages: list[Written | None], batch: str, schema: str) -> None:
        place, base = place_of(self.path)
        there = f"{base}/commits/{batch}.json"
        if place.get_file_info(there).type != fs.FileType.NotFound:
            self.abort(messages)
            return
        place.create_dir(f"{base}/commits", recursive=True)
        aside = f"{base}/commits/_{uuid.uuid4().hex}"
        with place.open_output_stream(aside) as out:
            out.write(json.dumps({"schema": schema, "files": [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m)}).encode())
        place.move(aside, there)

    def abort(self, messages: list[Written | None]) -> None:
        place, base = place_of(self.path)
        for m in messages:
            if m and m.file and place.get_file_info(f"{base}/{m.file}").type != fs.FileType.NotFound:
                place.delete_file(f"{base}/{m.file}")

    def sweep(self, older_than: float = 86_400.0) -> int:
        """Delete files that no commit names and that were last written so many seconds ago; no job may take longer. Gives their number."""
        place, base = place_of(self.path)
        named, now, n = {f for c in self.commits() for f in c["files"]}, time.time(), 0
        for f in place.get_file_info(fs.FileSelector(f"{base}/rows", allow_not_found=True)):
            if f"rows/{f.base_name}" not in named and now - f.mtime.timestamp() >= older_than:
                place.delete_file(f.path)
                n += 1
        return n

    def commits(self) -> list[dict]:
        """What was committed, in order of names."""
        place, base = place_of(self.path)
        found = place.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
        told = []
        for name in sorted(f.base_name for f in found if f.base_name.endswith(".json")):
            with place.open_input_stream(f"{base}/commits/{name}") as source:
                told.append(json.loads(source.read()))
        return told


class LogWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.log, self.batch, self.schema = Log(options), options.get("batch") or uuid.uuid4().hex, schema.json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.log.write(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.log.commit(messages, self.batch, self.schema)

    def abort(self, messages: list[Written | None]) -> None:
        self.log.abort(messages)


class LogStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.log, self.name, self.schema = Log(options), options.get("name", "stream"), schema.json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.log.write(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.log.commit(messages, f"{self.name}-{batchId:012d}", self.schema)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.log.abort(messages)


class LogFile(InputPartition):
    def __init__(self, file: str):
        self.file = file


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.log = Log(options)

    def partitions(self) -> list[LogFile]:
        return [LogFile(file) for c in self.log.commits() for file in c["files"]] or [LogFile("")]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        if partition.file:
            place, base = place_of(self.log.path)
            with place.open_input_file(f"{base}/{partition.file}") as source:
                yield from pq.ParquetFile(source).iter_batches()


class UpsertLog(DataSource):
    """``upsert_log``: see the module's text. All writes of a log have one schema."""

    @classmethod
    def name(cls) -> str:
        return "upsert_log"

    def schema(self) -> StructType:
        told = Log(dict(self.options)).commits()
        if not told:
            raise ValueError("nothing was committed to this log; give its schema")
        return StructType.fromJson(json.loads(told[0]["schema"]))

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is appended to")
        return LogWriter(dict(self.options), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogStreamWriter:  # noqa: N802
        return LogStreamWriter(dict(self.options), schema)
