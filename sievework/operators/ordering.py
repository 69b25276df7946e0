"""Positions, ranks and running sums over a total order, without a single-task window.

`row_number() over (order by ...)` pulls all rows into one task, and a window partitioned by a key
pulls each key into one task. Here the rows are range partitioned and sorted, so that a key of any
size is spread over many tasks; the position is the rows in earlier partitions (one number per
partition, hence a broadcast bounded by the partition count) plus the index in the partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.session import freeze

_MID = "__range_id"
_PART = "__range_part"
_BASE = "__rows_before"
# monotonically_increasing_id(): partition number above bit 33, row index below.
_INDEX_BITS = 33


def _ordered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return freeze(ranged.withColumn(_MID, F.monotonically_increasing_id())).withColumn(
        _PART, F.shiftright(F.col(_MID), _INDEX_BITS)
    )


def _before(per_part: DataFrame, amounts: Sequence[str]) -> DataFrame:
    """Sums of `amounts` over earlier partitions; input is one row per partition."""
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(_BASE + a) for a in amounts]
    return per_part.select(_PART, *sums)


def ordered_positions(df: DataFrame, order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """Adds the 0-based position in `order`, which must leave no ties."""
    rows = _ordered(df, order)
    base = _before(rows.groupBy(_PART).agg(F.count("*").alias("__n")), ["__n"])
    index = F.col(_MID).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (
        rows.join(F.broadcast(base), _PART)
        .withColumn(name, F.col(_BASE + "__n") + index)
        .drop(_MID, _PART, _BASE + "__n")
    )


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on `keys` that also matches nulls."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins a table with one row per key to the rows.

    No hint: Spark broadcasts the per-key side when its measured size allows it, else it shuffles
    and splits a skewed key on the row side.
    """
    keyed = per_key.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[c for c in per_key.columns if c not in keys],
    )
    on = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(keyed[f"__k_{k}"]) for k in keys))
    return rows.join(keyed, on, how).drop(*[f"__k_{k}" for k in keys])


def positions_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "pos",
    size: str | None = None,
) -> DataFrame:
    """Adds the 0-based position inside each key, and the key's row count as `size` if named."""
    placed = ordered_positions(df, [*keys, *order], "__place")
    spans = placed.groupBy(*keys).agg(
        F.min("__place").alias("__key_start"), F.count("*").alias(size or "__size")
    )
    out = attach(placed, spans, keys).withColumn(name, F.col("__place") - F.col("__key_start"))
    return out.drop("__place", "__key_start", *([] if size else ["__size"]))


def running_sums(
    df: DataFrame, order: Sequence[Column | str], amounts: dict[str, Column]
) -> DataFrame:
    """Adds the inclusive running sum of each amount in `order`, which must leave no ties."""
    rows = _ordered(df.withColumns(amounts), order)
    base = _before(rows.groupBy(_PART).agg(*[F.sum(a).alias(a) for a in amounts]), list(amounts))
    inside = Window.partitionBy(_PART).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumns({a: F.sum(a).over(inside) for a in amounts})
        .join(F.broadcast(base), _PART)
        .withColumns({a: F.col(_BASE + a) + F.col(a) for a in amounts})
        .drop(_MID, _PART, *[_BASE + a for a in amounts])
    )



def carried_forward(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Fills nulls of the column `name` with its last value before them in `order`.

    The rows are range-sorted; within a partition the value is carried by a window over the
    partition's rows, and what a partition ends with is carried over to those after it as one row
    per partition. Ties in `order` may come in any order.
    """
    rows = _ordered(df, order)
    inside = Window.partitionBy(_PART).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(name).isNotNull(), F.struct(F.col(_MID).alias("at"), F.col(name).alias("value")))
    ends = rows.groupBy(_PART).agg(F.max_by(known, F.when(F.col(name).isNotNull(), F.col(_MID))).alias("end"))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select(_PART, F.last("end", ignorenulls=True).over(earlier).alias(_BASE))
    filled = rows.withColumn(name, F.last(name, ignorenulls=True).over(inside)).join(F.broadcast(base), _PART)
    return filled.withColumn(name, F.coalesce(name, f"{_BASE}.value")).drop(_MID, _PART, _BASE)
