"""Structured Streaming jobs: the feed, its high-water rule, totals, scoring and job planning.

State that grows with the stream (marks, totals, ids) lies in Spark's state store: a micro-batch
looks up the keys it has, and costs the same however long the stream has run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from sievework.sources import commits
from sievework.sources.files import remove_folder

# Deltas of a totals table that a reader puts together before they are merged.
DELTAS = 8
# Ids that a task remembers while it leaves out repeated ones.
SEEN = 200_000


def record_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None,
    pattern: str = "*.parquet",
) -> DataFrame:
    """Stream over the Parquet files of a folder whose names match the pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _start(writer, poll_seconds: int | None) -> StreamingQuery:
    trigger = {"availableNow": True} if poll_seconds is None else {"processingTime": f"{poll_seconds} seconds"}
    return writer.trigger(**trigger).start()


def stream_feed(
    records: DataFrame, sink: str, checkpoint: str, poll_seconds: int | None = 5
) -> StreamingQuery:
    """Appends new records newest first, each micro-batch in its own folder.

    A replayed batch overwrites its folder, so the sink holds every record once. Without
    `poll_seconds` the query ends when all input is read.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        batch.orderBy(F.col("mtime").desc(), "name").write.mode("overwrite").parquet(
            f"{sink}/batch={number}"
        )

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return _start(writer, poll_seconds)


def stream_high_water(
    records: DataFrame, sink: str, checkpoint: str, poll_seconds: int | None = 5, feed: str | None = None, strict: bool = True
) -> StreamingQuery:
    """Delivers rows above the highest mtime of earlier micro-batches; others come late.

    `strict` never delivers late rows; without it all rows are delivered, with a column `late`. With
    `feed` each value of that column has a mark of its own (null is a feed like any other), without
    it all rows share one. A null mtime is not above any mark and moves none.
    """
    if feed is not None:
        return _marked_feeds(records, sink, checkpoint, poll_seconds, feed, strict)
    return _one_mark(records, sink, checkpoint, poll_seconds, strict)


def _one_mark(records: DataFrame, sink: str, checkpoint: str, poll_seconds: int | None, strict: bool) -> StreamingQuery:
    """Each batch leaves its mark, one row, in a folder beside the sink, so the next batch reads one
    row however long the feed has run, and a replayed batch sees the same mark."""
    spark, marks = records.sparkSession, f"{sink.rstrip('/')}-marks"

    def deliver(batch: DataFrame, number: int) -> None:
        mark = F.lit(None).cast(batch.schema["mtime"].dataType)
        if number > 0:
            mark = F.lit(spark.read.parquet(f"{marks}/batch={number - 1}").first()["mark"]).cast(batch.schema["mtime"].dataType)
        folder = f"{sink}/batch={number}"
        fresh = mark.isNull() | F.coalesce(F.col("mtime") > mark, F.lit(False))
        (batch.filter(fresh) if strict else batch.withColumn("late", ~fresh)).write.mode("overwrite").parquet(folder)
        # The mark only rises: what was delivered tells the new one.
        highest = spark.read.schema(batch.schema).parquet(folder).agg(F.greatest(F.max("mtime"), mark).alias("mark"))
        highest.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={number}")

    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return _start(writer, poll_seconds)


def _marked_feeds(records: DataFrame, sink: str, checkpoint: str, poll_seconds: int | None, feed: str, strict: bool) -> StreamingQuery:
    """The mark of each feed is keyed state. A feed's rows of a batch pass one task in chunks; none are held."""
    out = records.schema if strict else StructType([*records.schema.fields, StructField("late", BooleanType())])

    def deliver(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        highest = before
        for chunk in chunks:
            times = chunk["mtime"]
            late = ~(times > before) if before is not None else pd.Series(False, index=chunk.index)
            if times.notna().any():
                highest = float(times.max()) if highest is None else max(highest, float(times.max()))
            rows = chunk[~late] if strict else chunk.assign(late=late)
            if len(rows):
                yield rows
        if highest is not None and highest != before:
            state.update((highest,))

    marked = records.groupBy(feed).applyInPandasWithState(deliver, out, "mark double", "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return _start(marked.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write), poll_seconds)


def stream_totals(records: DataFrame, keys: list[str | Column], sink: str, checkpoint: str,
                  poll_seconds: int | None = 5) -> StreamingQuery:
    """Running count per key as a table below `sink`, brought up to date at every trigger; read it with `totals_of`.

    A batch writes the keys whose count it has changed to a folder of its own and then commits the
    folders that make up the table; every `DELTAS` batches they are merged into one. Nothing is
    overwritten, and the folders of the last 2 * `DELTAS` tables stay for their readers.
    """
    spark = records.sparkSession
    counts = records.groupBy(*keys).count().withColumnRenamed("count", "n")

    def deliver(batch: DataFrame, number: int) -> None:
        own, parts = f"table-{number}-{uuid.uuid4().hex[:8]}", _totals_parts(sink, number)
        changed = batch.withColumn("batch", F.lit(number).cast("bigint"))
        if len(parts) < DELTAS:
            changed.write.parquet(f"{sink}/{own}")
            commits.commit(sink, f"{number}", {"parts": [*parts, own]})
            return
        whole = spark.read.parquet(*[f"{sink}/{p}" for p in parts]).unionByName(changed)
        _newest(whole).withColumn("batch", F.lit(number).cast("bigint")).write.parquet(f"{sink}/{own}")
        commits.commit(sink, f"{number}", {"parts": [own]})
        _forget_tables(sink, 2 * DELTAS)

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return _start(writer, poll_seconds)


def _totals_parts(sink: str, before: int | None = None) -> list[str]:
    """The folders of the newest table, or of the newest made before a batch."""
    for number, name in reversed(commits.commits(sink)):
        if before is None or int(name) < before:
            return commits.content(sink, number, name)["parts"]
    return []


def _forget_tables(sink: str, keep: int) -> None:
    """Forgets all but the newest tables, and removes the folders that only the others have."""
    found = commits.commits(sink)
    kept = {p for number, name in found[-keep:] for p in commits.content(sink, number, name)["parts"]}
    gone = {p for number, name in found[:-keep] for p in commits.content(sink, number, name)["parts"]} - kept
    commits.forget(sink, keep)
    for part in gone:
        remove_folder(f"{sink}/{part}")


def _newest(rows: DataFrame) -> DataFrame:
    """The row of the highest batch per key; the keys are all columns but `n` and `batch`."""
    keys = [c for c in rows.columns if c not in ("n", "batch")]
    return rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def totals_of(spark: SparkSession, sink: str) -> DataFrame:
    """The totals of the newest committed batch."""
    parts = _totals_parts(sink)
    if not parts:
        raise FileNotFoundError(f"no totals in {sink}")
    return _newest(spark.read.parquet(*[f"{sink}/{p}" for p in parts]))


def stream_append(
    records: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
    poll_seconds: int | None = 5,
) -> StreamingQuery:
    """Row-wise jobs (scoring, planning): each finished row stays when the stream is stopped.

    The source remembers its files, so a restart goes on with what is new.
    """
    writer = (
        transform(records).writeStream.outputMode("append").format("parquet")
        .option("path", sink).option("checkpointLocation", checkpoint)
    )
    return _start(writer, poll_seconds)


def first_of_task(records: DataFrame, key: str) -> DataFrame:
    """Leaves out rows whose key a task has just had, so that a key of very many rows is not shuffled with all of them."""
    at = records.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keep = []
            for k in batch.column(at).to_pylist():
                keep.append(k not in seen)
                seen.add(k)
            yield batch.filter(pa.array(keep, pa.bool_()))
            if len(seen) > SEEN:
                seen.clear()

    return records.mapInArrow(run, records.schema)


def score_new(
    records: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str,
    key: str = "id", poll_seconds: int | None = 5,
) -> StreamingQuery:
    """Scores each id once, however often it comes; a restart goes on with the ids it has not seen.

    The ids are kept in the state store, where a batch looks up its own. A replayed batch sees the
    ids as they were and overwrites its folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    todo = first_of_task(records, key).dropDuplicates([key])
    return _start(todo.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run), poll_seconds)
