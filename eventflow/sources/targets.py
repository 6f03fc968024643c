"""A user-defined target through Spark's Python data source API: files that count only once their batch is committed.

Each task writes one Parquet file under a new name. When all have ended, a manifest
that lists the files makes the batch visible in one step. A failed task
takes its file back, a failed batch all of them; files of a lost executor may stay, but no manifest
names them. A batch whose manifest exists is not added again. Any other subclass of
``DataSource`` with a writer registers the same way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

DATA, COMMITS = "data", "commits"


@dataclass
class Written(WriterCommitMessage):
    """What a task reports: its file, none if it had no rows."""

    file: str | None
    rows: int


class _Folder:
    """The target's folder, on any file system Arrow can reach."""

    def __init__(self, path: str):
        self.path = path

    def at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, "/".join([root.rstrip("/"), *parts])

    def put(self, batches: Iterator[pa.RecordBatch]) -> Written:
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        system, file = self.at(DATA, name)
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if writer is None:
                    system.create_dir(self.at(DATA)[1], recursive=True)
                    writer = pq.ParquetWriter(file, batch.schema, filesystem=system, compression="zstd")
                writer.write_batch(batch)
                rows += batch.num_rows
            if writer is not None:
                writer.close()
        except BaseException:
            if writer is not None:
                writer.close()
                self.remove([Written(name, rows)])
            raise
        return Written(name if rows else None, rows)

    def remove(self, messages: list) -> None:
        for message in messages:
            if message is not None and message.file:
                system, file = self.at(DATA, message.file)
                if system.get_file_info(file).type != fs.FileType.NotFound:
                    system.delete_file(file)

    def commit(self, messages: list, batch: str) -> None:
        system, manifest = self.at(COMMITS, f"{batch}.json")
        if system.get_file_info(manifest).type != fs.FileType.NotFound:
            self.remove(messages)
            return
        system.create_dir(self.at(COMMITS)[1], recursive=True)
        kept = [m for m in messages if m is not None and m.file]
        draft = self.at(COMMITS, f".{uuid.uuid4().hex}")[1]
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"files": [m.file for m in kept], "rows": sum(m.rows for m in kept)}).encode())
        system.move(draft, manifest)

    def files(self) -> list[str]:
        system, folder = self.at(COMMITS)
        names = []
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with system.open_input_stream(info.path) as manifest:
                    names += json.loads(manifest.read())["files"]
        return [f"{self.path.rstrip('/')}/{DATA}/{name}" for name in sorted(names)]


class _Batch(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.folder, self.batch = _Folder(path), batch

    def write(self, iterator):
        return self.folder.put(iterator)

    def commit(self, messages):
        self.folder.commit(messages, self.batch)

    def abort(self, messages):
        self.folder.remove(messages)


class _Stream(DataSourceStreamArrowWriter):
    def __init__(self, path: str, name: str):
        self.folder, self.name = _Folder(path), name

    def write(self, iterator):
        return self.folder.put(iterator)

    def commit(self, messages, batchId):
        self.folder.commit(messages, f"{self.name}-{batchId}")

    def abort(self, messages, batchId):
        self.folder.remove(messages)


class ManifestTarget(DataSource):
    """Options: ``path`` (a folder all executors reach, as a URI or an absolute path), ``batch`` or ``stream``.

    ``batch`` names a batch write: a second write of that name adds nothing. Without it each write is its
    own batch. ``stream`` names a stream among several that write to one folder.
    """

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("the target appends; write to a new path instead")
        return _Batch(self.options["path"], f"batch-{self.options.get('batch', uuid.uuid4().hex)}")

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _Stream(self.options["path"], f"stream-{self.options.get('stream', 'main')}")


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed batches, as a plain Parquet scan."""
    files = _Folder(path).files()
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
