"""Scans of sidecars, payloads, scores, id lists and text trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sievework.schema import RECIPE_COLUMNS, SCORE_SCHEMA, SIDECAR_SCHEMA
from sievework.sources import commits
from sievework.sources.files import open_folder


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def scan_sidecar_text(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, raw): the JSON text of each sidecar."""
    return (
        spark.read.option("pathGlobFilter", "*.json")
        .text(folder, wholetext=True)
        .select(_stem(F.col("_metadata.file_name")).alias("stem"), F.col("value").alias("raw"))
    )


def parse_sidecars(df: DataFrame, raw: str = "raw", policy: str = "default") -> DataFrame:
    """Parses JSON text to a `meta` struct.

    `default` keeps broken rows with a null struct, `skip` marks them in `broken` so they can be
    counted and filtered, `fail` ends the job.
    """
    if policy == "fail":
        return df.withColumn("meta", F.from_json(raw, SIDECAR_SCHEMA, {"mode": "FAILFAST"}))
    schema = T.StructType([*SIDECAR_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    parsed = df.withColumn(
        "meta", F.from_json(raw, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    )
    broken = F.col(raw).isNull() | F.col("meta").isNull() | F.col("meta._corrupt").isNotNull()
    if policy == "default":
        return parsed.withColumn("meta", F.col("meta").dropFields("_corrupt"))
    if policy == "skip":
        return parsed.withColumn("broken", broken).withColumn(
            "meta", F.when(~F.col("broken"), F.col("meta").dropFields("_corrupt"))
        )
    raise ValueError(f"unknown policy {policy!r}")


def scan_sidecars(spark: SparkSession, folder: str, policy: str = "default") -> DataFrame:
    return parse_sidecars(scan_sidecar_text(spark, folder), policy=policy)


def scan_payloads(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(stem, name, length, mtime) of each `*.png`; bytes are read only when asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    columns = [
        _stem(name).alias("stem"),
        name.alias("name"),
        F.col("length"),
        F.col("modificationTime").alias("mtime"),
    ]
    return files.select(*columns, *(["content"] if content else []))


def payload_probe(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds `readable`, `width`, `height` from the first bytes of a PNG."""
    # The PNG signature; width and height are big-endian at bytes 17 and 21.
    signature = F.unhex(F.lit("89504E470D0A1A0A"))
    data = F.col(content)

    def number(start: int) -> Column:
        return F.conv(F.hex(F.substring(data, start, 4)), 16, 10).cast("bigint")

    ok = F.coalesce((F.length(data) >= 33) & (F.substring(data, 1, 8) == signature), F.lit(False))
    return (
        df.withColumn("readable", ok)
        .withColumn("width", F.when(F.col("readable"), number(17)))
        .withColumn("height", F.when(F.col("readable"), number(21)))
    )


def scan_scores(spark: SparkSession, path: str, resume: bool = False) -> DataFrame:
    """The score table. When resuming, a missing table means that nothing is scored yet."""
    try:
        return spark.read.schema(SCORE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if resume and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SCORE_SCHEMA)
        raise


def ids_of(df: DataFrame, text: str) -> DataFrame:
    """Distinct ids of text cells that list them between white space."""
    return (
        df.select(F.explode(F.split(F.col(text), r"(?U)[\s\x1C-\x1F]+")).alias("id"))
        .filter("id <> ''")
        .distinct()
    )


def scan_id_list(spark: SparkSession, path: str) -> DataFrame:
    return ids_of(spark.read.text(path), "value")


MANIFEST = "shard int, name string, rows bigint, bytes bigint, fingerprint string, file string, action string"


def build_folder(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/builds/{name}"


def scan_metadata(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows without payload bytes, and the build report: of the current build, or of a folder that holds just one."""
    name = commits.current(folder)
    own = folder if name is None else build_folder(folder, name)
    return spark.read.parquet(f"{own}/metadata"), spark.read.json(f"{own}/report")


def open_build(spark: SparkSession, folder: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest) of the current build, or of an earlier one by its name.

    The rows have `shard`, the published name of their shard, and the columns of the shard files;
    only files of the build's manifest are read.
    """
    name = name or commits.current(folder)
    if name is None:
        raise FileNotFoundError(f"no build in {folder}")
    manifest = spark.read.parquet(f"{build_folder(folder, name)}/manifest")
    named = manifest.select(F.col("name").alias("shard"), "file")
    fields = ", ".join(f"{c} {kind}" for c, kind in RECIPE_COLUMNS)
    reader = spark.read.schema(f"image struct<bytes binary, path string>, {fields}")
    paths = [f"{folder.rstrip('/')}/data/{r.file}" for r in named.select("file").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], f"shard string, image struct<bytes binary, path string>, {fields}"), manifest
    rows = reader.parquet(*paths).withColumn("file", F.col("_metadata.file_name"))
    return rows.join(named, "file").select("shard", *[c for c in rows.columns if c != "file"]), manifest


def build_actions(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, rows, fingerprint, file, action): what the current build did with each shard, and with those of the build before."""
    return spark.read.parquet(f"{build_folder(folder, commits.current(folder))}/actions")


def stored_files(names: DataFrame, folder: str) -> DataFrame:
    """(file, bytes) of those of the names (column `file`) that are there; looked up in the tasks."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [(n, i.size) for n, i in zip(own, system.get_file_info([f"{base}/{n}" for n in own])) if i.is_file]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], ["file", "bytes"])

    return names.select("file").mapInArrow(look, "file string, bytes bigint")


def scan_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, slug, text) of `*.md` files at any depth below `root`, but not directly in it."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .text(root, wholetext=True)
    )
    # The root as its file system names it, so that relative roots and roots without host work too.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = system.makeQualified(hadoop).toUri().getPath().rstrip("/") + "/"
    # File paths come as percent-encoded URIs; url_decode would also turn `+` into a blank.
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    whole = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    path = F.when(F.startswith(whole, F.lit(base)), F.substr(whole, F.lit(len(base) + 1))).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {base}: "), whole))
    )
    return files.select(
        path.alias("path"),
        _stem(F.element_at(F.split(path, "/"), -1)).alias("slug"),
        F.col("value").alias("text"),
    ).filter(F.contains("path", F.lit("/")))
