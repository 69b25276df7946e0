"""File access from inside tasks, for any folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.session import local_path


SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfs"}


def open_folder(path: str):
    """(file system, path in it) of a folder given as a path or URI."""
    from pyarrow import fs

    path = local_path(path)
    if "://" in path:
        # Spark's names of a store, and the names this library has for it. hdfs needs libhdfs on the workers.
        scheme, rest = path.split("://", 1)
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.LocalFileSystem(), path


def _temporary(path: str, write):
    """Writes the file under a name of its own; (file system, that name, target)."""
    system, target = open_folder(path)
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    temporary = f"{target}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(temporary) as sink:
            write(sink)
    except BaseException:
        if system.get_file_info(temporary).is_file:
            system.delete_file(temporary)
        raise
    return system, temporary, target


def put_file(path: str, write) -> int:
    """Writes under a temporary name and renames, so a reader never meets half a file; returns the size.

    A file of that name is replaced in one step where the store can do that. Where it cannot, the
    content is written in the old one's place.
    """
    system, temporary, target = _temporary(path, write)
    size = system.get_file_info(temporary).size
    try:
        system.move(temporary, target)
    except OSError:
        if not system.get_file_info(target).is_file:
            raise
        system.copy_file(temporary, target)
        system.delete_file(temporary)
    return size


def put_new(path: str, write) -> int:
    """The same for names that stand for one content: a file that is there already stays; returns its size."""
    system, temporary, target = _temporary(path, write)
    if not system.get_file_info(target).is_file:
        try:
            system.move(temporary, target)
        except OSError:
            if not system.get_file_info(target).is_file:
                raise
    if system.get_file_info(temporary).is_file:
        system.delete_file(temporary)
    return system.get_file_info(target).size


def remove_folder(path: str) -> None:
    """Deletes a folder with all it holds, if there is one."""
    from pyarrow import fs

    system, base = open_folder(path)
    if system.get_file_info(base).type == fs.FileType.Directory:
        system.delete_dir(base)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """One file per row (`name` -> bytes of `content`); returns the written names and sizes.

    Lazy: the files are written when the result is read.
    """
    rows = df.selectExpr(f"`{name}` AS name", f"CAST(`{content}` AS BINARY) AS content")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = [], []
            for row in batch.to_pylist():
                sizes.append(
                    put_file(f"{folder}/{row['name']}", lambda sink, row=row: sink.write(row["content"]))
                )
                names.append(row["name"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"]
            )

    return rows.mapInArrow(put, "name string, bytes bigint")
