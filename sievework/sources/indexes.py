"""An endless stream of indexes with offsets of its own: starts anywhere, stops and goes on without loss.

The offset is the next index. It is Spark's checkpoint that remembers it: on a restart Spark asks
for the partitions of the last offset it has seen before it asks for a new one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

CHUNK = 10_000


@dataclass
class Span(InputPartition):
    first: int
    end: int


class IndexReader(DataSourceStreamReader):
    def __init__(self, start: int, end: int | None, per_trigger: int, partitions: int) -> None:
        self.start, self.end, self.per_trigger, self.spans = start, end, per_trigger, partitions
        self.next: int | None = None

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        """Up to `per_trigger` further than what has been planned; asking again changes nothing."""
        at = self.start if self.next is None else self.next
        wanted = at + self.per_trigger
        return {"next": wanted if self.end is None else max(at, min(wanted, self.end))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = start["next"], end["next"]
        self.next = last
        step = max(1, -(-(last - first) // self.spans))
        return [Span(at, min(at + step, last)) for at in range(first, last, step)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        for at in range(partition.first, partition.end, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(range(at, min(at + CHUNK, partition.end)), pa.int64())], ["index"])


class IndexSource(DataSource):
    """`index` from option `start` on, `perTrigger` in each micro-batch over `partitions` tasks, endless unless `end` is given."""

    @classmethod
    def name(cls) -> str:
        return "sievework_indexes"

    def schema(self) -> str:
        return "index bigint"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        options = self.options
        end = options.get("end")
        return IndexReader(
            int(options.get("start", 0)), None if end is None else int(end), int(options.get("pertrigger", 1000)), int(options.get("partitions", 8))
        )
