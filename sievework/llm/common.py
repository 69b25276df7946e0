"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What ends a word: ASCII white space. bytes.split() without arguments cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

# Rows handed on at once by operators that compute in Python; texts may be long.
SLICE = 256


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `rows`, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_rows(
    df: DataFrame,
    columns: Sequence[str],
    schema: str | T.StructType,
    rows: Callable[[Iterator[tuple]], Iterator[tuple]],
    batch: int = 4096,
) -> DataFrame:
    """`rows` turns the tuples of `columns` into tuples of `schema`, a partition at a time, by Arrow batches.

    Only `columns` are read, by position, so other columns and their names do not matter.
    """
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    target = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for part in slices(batches):
                yield from zip(*(part.column(i).to_pylist() for i in range(part.num_columns)))

        def flush(held: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*held), target)]
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        held: list[tuple] = []
        for row in rows(tuples()):
            held.append(row)
            if len(held) >= batch:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    return df.select(*[df[c].alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(run, struct)


def put_bounded(cache: dict, key, value, limit: int) -> None:
    """Adds an entry to a worker's cache, which starts anew when it is full."""
    if len(cache) >= limit:
        cache.clear()
    cache[key] = value


def unused(df: DataFrame, *names: str) -> list[str]:
    """The given column names, lengthened where the table has one of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
