"""Picks for contact sheets: best per group, fill rows, evenly spread rows, layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sievework.operators.ordering import ordered_positions, positions_within


def best_per_group(df: DataFrame, group: str, score: str, key: str = "id") -> DataFrame:
    """Row with the highest score per group; the smallest key wins a tie, null scores lose.

    Spark keeps one row per group in every task before the shuffle, so group size does not matter.
    """
    ranked = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(key))
    known = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(group).isNotNull())
    return known.withColumn("__rank", F.row_number().over(ranked)).filter("__rank = 1").drop("__rank")


def drop_picked(df: DataFrame, picks: DataFrame, key: str = "id") -> DataFrame:
    return df.join(picks.select(key), key, "left_anti")


def fill_top_k(df: DataFrame, picks: DataFrame, score: str, key: str = "id", columns: int = 4) -> DataFrame:
    """Next-best rows that complete the last row of the sheet: fewer than `columns` of them."""
    missing = picks.agg(F.pmod(-F.count("*"), F.lit(columns)).alias("k"))
    best = [F.col(score).desc_nulls_last(), F.col(key)]
    head = drop_picked(df, picks, key).orderBy(*best).limit(columns - 1)
    ranked = head.withColumn("__rank", F.row_number().over(Window.orderBy(*best)))
    return ranked.filter(F.col("__rank") <= missing.scalar()).drop("__rank")


def even_sample(df: DataFrame, keys: Sequence[str], score: str, key: str = "id", k: int = 8) -> DataFrame:
    """k rows per group at evenly spaced ranks of the score, halves rounded to even.

    Short groups repeat rows. Adds `slot` (0..k-1) and `rank`.
    """
    order = [F.col(score).asc_nulls_last(), F.col(key)]
    ranked = positions_within(df, keys, order, "rank", size="__size")
    wanted = F.filter(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.rint(i * (F.col("__size") - 1) / F.lit(k - 1)) == F.col("rank"),
    )
    return ranked.withColumn("slot", F.explode(wanted)).drop("__size")


def sheet_layout(
    picks: DataFrame,
    order: Sequence,
    width: str = "width",
    height: str = "height",
    columns: int = 4,
    tile: int = 400,
    gap: int = 4,
) -> DataFrame:
    """Grid place, offsets and centred square crop box of each pick, and the sheet size."""
    placed = ordered_positions(picks, order, "slot")
    n = picks.agg(F.count("*").alias("n")).scalar()
    i = F.col("slot")
    rows = F.floor((n + (columns - 1)) / columns)
    side = F.least(width, height)
    left = F.floor((F.col(width) - side) / 2)
    top = F.floor((F.col(height) - side) / 2)
    return placed.withColumns(
        {
            "grid_column": i % columns,
            "grid_row": F.floor(i / columns),
            "x": (i % columns) * (tile + gap),
            "y": F.floor(i / columns) * (tile + gap),
            "sheet_width": F.lit(columns * tile + (columns - 1) * gap).cast("bigint"),
            "sheet_height": rows * tile + (rows - 1) * gap,
            "crop_left": left,
            "crop_top": top,
            "crop_right": left + side,
            "crop_bottom": top + side,
        }
    )
