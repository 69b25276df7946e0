"""Tables kept as files clustered by a key, with a catalogue of what each file holds.

Every batch of rows is range-sorted by the key and written as a run of files of about `rows_per_file`
rows; the catalogue has (file, low, high, rows) of each file. A reader takes only the files whose
span of keys it needs. Late rows make runs of their own, whose spans may overlap those of others;
`compact` writes all rows as one run. Runs are never changed, and a commit names those that count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievework.sources import commits


# Files that a task writes one after the other, once there are several for each core.
FILES_PER_TASK, TASKS_PER_CORE = 64, 4


def writing_tasks(files: int, cores: int) -> int:
    """Into how many ranges the rows of so many files are sorted.

    A range for each file would draw a sample for each on the driver, start a task for a few rows,
    and shuffle blocks that grow with the square of the table.
    """
    return min(files, max(TASKS_PER_CORE * cores, -(-files // FILES_PER_TASK)))


def _runs(folder: str) -> list[str]:
    found = commits.commits(folder)
    return commits.content(folder, *found[-1])["runs"] if found else []


def _write_run(rows: DataFrame, folder: str, key: str, order: Sequence[Column | str], rows_per_file: int) -> str | None:
    spark, name = rows.sparkSession, uuid.uuid4().hex
    total = rows.count()
    if not total:
        return None
    files = -(-total // rows_per_file)
    tasks = writing_tasks(files, spark.sparkContext.defaultParallelism)
    writer = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).write
    # A task's rows come in order, so its files are cut at every `rows_per_file` of them.
    writer = writer.option("maxRecordsPerFile", rows_per_file) if tasks < files else writer
    writer.parquet(f"{folder}/{name}/rows")
    written = spark.read.schema(rows.schema).parquet(f"{folder}/{name}/rows").select(F.col("_metadata.file_name").alias("file"), F.col(key).alias("key"))
    spans = written.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"), F.count_if(F.col("key").isNull()).alias("nulls"))
    spans.select(F.concat(F.lit(f"{name}/rows/"), "file").alias("file"), "low", "high", "rows", "nulls").coalesce(1).write.parquet(f"{folder}/{name}/catalogue")
    return name


def append(rows: DataFrame, folder: str, key: str, order: Sequence[Column | str], rows_per_file: int = 100_000) -> None:
    """Adds rows; they show when all of them are written. `order` begins with the key and splits ties of it."""
    name = _write_run(rows, folder, key, order, rows_per_file)
    if name is not None:
        commits.commit(folder, name, {"runs": [*_runs(folder), name]})


def compact(spark: SparkSession, folder: str, key: str, order: Sequence[Column | str], rows_per_file: int = 100_000) -> None:
    """One run of all rows in place of the runs there are, whose files stay for their readers."""
    if len(_runs(folder)) > 1:
        name = _write_run(rows_of(spark, folder), folder, key, order, rows_per_file)
        commits.commit(folder, name, {"runs": [name]})


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(file, low, high, rows, nulls) of all files, one row each; `nulls` counts rows without a key."""
    runs = _runs(folder)
    if not runs:
        raise FileNotFoundError(f"no table in {folder}")
    return spark.read.parquet(*[f"{folder}/{r}/catalogue" for r in runs])


def rows_of(spark: SparkSession, folder: str, wanted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of the files that `wanted` leaves of the catalogue, or of all."""
    if wanted is None:
        return spark.read.parquet(*[f"{folder}/{r}/rows" for r in _runs(folder)])
    files = [f"{folder}/{r.file}" for r in wanted(catalogue(spark, folder)).select("file").toLocalIterator()]
    schema = spark.read.parquet(f"{folder}/{_runs(folder)[-1]}/rows").schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
