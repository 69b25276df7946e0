"""Batch writes of files with exact names and formats, as Spark data sources with a commit.

`df.write.format("sievework_shards")` and `df.write.format("sievework_files")` hand each partition to
a task that writes its files. A file gets its name when it is complete, and a name stands for one
content, so repeated and speculative attempts of a task put the same bytes in the same place. Each
successful attempt leaves a list of its files; the commit names the lists of the attempts that Spark
chose. What no committed list names is not part of the result.
"""

from __future__ import annotations

import base64
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sievework.sources.files import open_folder, put_file, put_new

LIST = pa.schema([("name", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())])
LIST_DDL = "name string, rows bigint, bytes bigint"


@dataclass
class Written(WriterCommitMessage):
    """Where an attempt's list lies, and how many files it has."""

    part: str
    files: int


class FileSink(DataSourceArrowWriter):
    """Writes files by `put` and keeps lists of them below `log`."""

    def __init__(self, folder: str, log: str) -> None:
        self.folder, self.log = folder.rstrip("/"), log.rstrip("/")

    def put(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        """Writes files and gives (name, rows, bytes) of each."""
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        found = list(self.put(batches))
        if not found:
            return Written("", 0)
        table, part = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), LIST)], schema=LIST), f"parts/{uuid.uuid4().hex}.parquet"
        put_new(f"{self.log}/{part}", lambda sink: pq.write_table(table, sink))
        return Written(part, len(found))

    def commit(self, messages: list[Written | None]) -> None:
        chosen = [m for m in messages if m is not None and m.part]
        listing = {"parts": sorted(m.part for m in chosen), "files": sum(m.files for m in chosen)}
        put_file(f"{self.log}/committed.json", lambda sink: sink.write(json.dumps(listing).encode()))

    def abort(self, messages: list[Written | None]) -> None:
        """Finished files stay: they are complete, in no list, and the next run takes them up or replaces them."""
        system, base = open_folder(self.log)
        for message in messages:
            if message is not None and message.part:
                system.delete_file(posixpath.join(base, message.part))


class RecordFiles(FileSink):
    """One file per row: `name`, `content`."""

    def put(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                yield name, 1, put_file(f"{self.folder}/{name}", lambda sink, content=content: sink.write(content))


class ShardFiles(FileSink):
    """One Parquet file per run of equal `file`, in row groups of `rows_per_group`; rows come in (file, pos) order.

    With `payloads`, a pair (folder, function that makes an encoder, suffix), the task reads and
    encodes the payload of each row itself, one row group at a time.
    """

    def __init__(self, folder: str, log: str, rows_per_group: int, payloads: tuple | None) -> None:
        super().__init__(folder, log)
        self.rows_per_group, self.payloads = rows_per_group, payloads

    def put(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int]]:
        runs = _Runs(batches)
        encoder = self.payloads[1]() if self.payloads else None
        while (name := runs.next_name()) is not None:
            rows = 0

            def fill(sink) -> None:
                nonlocal rows
                rows = self._fill(sink, name, runs.batches_of(name), encoder)

            size = put_new(f"{self.folder}/{name}", fill)
            yield name, rows, size

    def _fill(self, sink, name: str, batches: Iterator[pa.RecordBatch], encoder: Callable[[bytes], bytes] | None) -> int:
        from sievework.sources.writers import shard_schema

        schema, written, last = shard_schema(), 0, -1
        held: pa.Table | None = None
        with pq.ParquetWriter(sink, schema, compression="zstd") as writer:

            def flush(group: pa.Table) -> int:
                whole = group if encoder is None else group.append_column("image", self._images(group, encoder, schema))
                writer.write_table(whole.select(schema.names).cast(schema))
                return group.num_rows

            for batch in batches:
                positions = batch.column("pos").to_pylist()
                if any(b <= a for a, b in zip([last, *positions], positions)):
                    raise ValueError(f"rows of {name} are not in order")
                last = positions[-1]
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
                while held.num_rows >= self.rows_per_group:
                    written += flush(held.slice(0, self.rows_per_group))
                    held = held.slice(self.rows_per_group)
            if held is not None and held.num_rows:
                written += flush(held)
        return written

    def _images(self, group: pa.Table, encoder: Callable[[bytes], bytes], schema: pa.Schema) -> pa.Array:
        folder, _, suffix = self.payloads
        system, base = open_folder(folder)
        cells = []
        for name in group.column("id").to_pylist():
            with system.open_input_file(f"{base}/{name}.png") as source:
                cells.append({"bytes": encoder(source.read()), "path": f"{name}{suffix}"})
        return pa.array(cells, schema.field("image").type)


class _Runs:
    """Cuts batches where `file` changes."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches, self.open = batches, None

    def next_name(self) -> str | None:
        while self.open is None or not self.open.num_rows:
            self.open = next(self.batches, None)
            if self.open is None:
                return None
        return self.open.column("file")[0].as_py()

    def batches_of(self, name: str) -> Iterator[pa.RecordBatch]:
        while self.next_name() == name:
            names = self.open.column("file").to_pylist()
            end = next((i for i, n in enumerate(names) if n != name), len(names))
            part, self.open = self.open.slice(0, end), self.open.slice(end)
            yield part


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sievework_shards"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        held = self.options.get("payloads")
        payloads = cloudpickle.loads(base64.b64decode(held)) if held else None
        return ShardFiles(self.options["path"], self.options["log"], int(self.options["rows_per_group"]), payloads)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sievework_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordFiles(self.options["path"], self.options["log"])


def save(rows: DataFrame, source: type[DataSource], folder: str, log: str, **options: str) -> None:
    """Writes `rows` by `source`; the lists of what it has written lie below `log`."""
    rows.sparkSession.dataSource.register(source)
    rows.write.format(source.name()).mode("append").options(path=folder, log=log, **options).save()


def packed(value) -> str:
    """A value for an option of a data source."""
    return base64.b64encode(cloudpickle.dumps(value)).decode()


def written(spark: SparkSession, log: str) -> DataFrame:
    """(name, rows, bytes) of the files of the committed write with this log."""
    system, base = open_folder(log.rstrip("/"))
    with system.open_input_file(f"{base}/committed.json") as source:
        parts = json.loads(source.read())["parts"]
    return spark.read.schema(LIST_DDL).parquet(*[f"{log.rstrip('/')}/{p}" for p in parts]) if parts else spark.createDataFrame([], LIST_DDL)


def strangers(folder: str, known: set[str]) -> list[str]:
    """Files below `folder` whose names are not in `known`."""
    system, base = open_folder(folder.rstrip("/"))
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted(f.path[len(base) :].lstrip("/") for f in found if f.is_file and f.path[len(base) :].lstrip("/") not in known)
