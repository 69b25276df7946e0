"""Sinks: shards, metadata, report, sidecars, scores, sections."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievework import schema as S
from sievework.session import freeze
from sievework.sources.files import open_folder
from sievework.sources.sinks import RecordSource, save, written

_ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "float": pa.float32(),
}


def described(field: pa.Field) -> dict:
    """How consumers of a shard file name the type of a column."""
    if pa.types.is_struct(field.type):
        return {"_type": "Image"}
    text = pa.types.is_string(field.type)
    return {"dtype": "string" if text else field.type.to_pandas_dtype().__name__, "_type": "Value"}


def shard_schema() -> pa.Schema:
    image = pa.struct([("bytes", pa.binary()), ("path", pa.string())])
    fields = [pa.field("image", image)]
    fields += [pa.field(name, _ARROW[kind]) for name, kind in S.RECIPE_COLUMNS]
    features = json.dumps({"info": {"features": {f.name: described(f) for f in fields}}})
    return pa.schema(fields, metadata={S.FEATURES_KEY: features.encode()})


def shard_name(shard: Column, total: Column) -> Column:
    return F.format_string("train-%05d-of-%05d.parquet", shard, total)


def remove_files(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Deletes the files directly in `folder` that `wanted` (file) does not name, and returns their names.

    Files under temporary names are removed as well.
    """
    system, base = open_folder(folder)
    names = [(f.base_name,) for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file]
    if not names:
        return spark.createDataFrame([], "file string")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_folder(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                if store.get_file_info(f"{at}/{name}").is_file:
                    store.delete_file(f"{at}/{name}")
            yield batch

    return freeze(spark.createDataFrame(names, "file string").join(wanted, "file", "left_anti").mapInArrow(delete, "file string"))


def write_metadata(df: DataFrame, path: str) -> None:
    """The published rows without payload bytes."""
    df.drop("image").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_report(report: DataFrame, excluded: DataFrame, folder: str) -> None:
    """The report object, and the ids per exclusion class as a table of their own.

    The id lists can be as long as the data, so they are never gathered into one object.
    """
    report.write.mode("overwrite").json(f"{folder}/report")
    excluded.write.mode("overwrite").partitionBy("class").parquet(f"{folder}/excluded")


def sidecar_json(columns: list[str]) -> Column:
    """One record as JSON; null fields are kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_sidecars(df: DataFrame, folder: str, stem: str, columns: list[str]) -> DataFrame:
    """One JSON file per record beside its payload; returns the written names and sizes.

    The list of a write is kept in `_written/`, below the folder.
    """
    rows = df.select(
        F.concat(F.col(stem), F.lit(".json")).alias("name"), sidecar_json(columns).cast("binary").alias("content")
    )
    log = f"{folder.rstrip('/')}/_written/{uuid.uuid4().hex}"
    save(rows, RecordSource, folder, log)
    return written(df.sparkSession, log).select("name", "bytes")


def write_sidecar_lines(df: DataFrame, path: str, day: str, columns: list[str]) -> None:
    """The same records as JSON lines, one folder per day: for large sets, in few files."""
    lines = df.select(F.col(day).alias("day"), sidecar_json(columns).alias("value"))
    lines.write.mode("overwrite").partitionBy("day").text(path)


def footer_of(manifest: DataFrame, folder: str) -> DataFrame:
    """(shard, row_groups, rows, features): what the footer of the file of each shard of a manifest says."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for batch in batches:
            groups, rows, features = [], [], []
            for name in batch.column("file").to_pylist():
                with system.open_input_file(f"{base}/{name}") as source:
                    meta = pq.ParquetFile(source).metadata
                groups.append(meta.num_row_groups)
                rows.append(meta.num_rows)
                described = json.loads(meta.metadata.get(S.FEATURES_KEY, b"{}"))
                features.append(len(described.get("info", {}).get("features", {})))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), *[pa.array(v, pa.int64()) for v in (groups, rows, features)]],
                ["shard", "row_groups", "rows", "features"],
            )

    return manifest.select("shard", "file").mapInArrow(
        read, "shard string, row_groups bigint, rows bigint, features bigint"
    )


def append_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").parquet(path)


def write_sections(sections: DataFrame, folder: str, keys: Sequence[str]) -> None:
    """The texts as a table of (keys, idx, section_id, text), byte for byte, and a manifest without them.

    A file per section would make as many files as there are sections; the table keeps which
    document each text belongs to and lets a document be put together again.
    """
    sections.select(*keys, "idx", "section_id", "text").write.mode("overwrite").parquet(f"{folder}/text")
    sections.drop("text").write.mode("overwrite").json(f"{folder}/manifest")
