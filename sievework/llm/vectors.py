"""What the two embedding operators share: usable vectors, and grouped Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v array<double>) of vectors that have a direction: not null, not zero, no null or non-finite parts.

    Vectors of another length than the most frequent one (the shorter of equals) and null keys are left out.
    """
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.filter(F.size("v") == (size["n"] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first `keys` columns; rows must come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            own = tuple(c[s] for c in columns)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = own
    if held:
        yield pa.Table.from_batches(held)
