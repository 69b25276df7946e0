"""Counts, summaries and spreads per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievework.operators.ordering import ordered_positions
from sievework.operators.quantiles import exact_quantiles


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    return (
        df.filter(F.col(category).isNotNull())
        .groupBy(category)
        .agg(F.count("*").alias("n"))
        .orderBy("n", category)
    )


def category_summary(
    df: DataFrame, category: str = "category", prompt: str = "prompt_id", score: str = "score"
) -> DataFrame:
    """Rows, distinct prompts and median score per category, most rows first; null is no category."""
    known = df.filter(F.col(category).isNotNull())
    counts = known.groupBy(category).agg(
        F.count("*").alias("n_rows"), F.count_distinct(prompt).alias("n_prompts")
    )
    median = exact_quantiles(known, [category], score, {"median_score": 0.5})
    return counts.join(median, category, "left").orderBy(F.desc("n_rows"), category)


def size_counts(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("width", "height")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "width", "height")
    )


def per_prompt_counts(df: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """Number of prompts; least, truncated median and most rows per prompt."""
    per_prompt = df.filter(F.col(prompt).isNotNull()).groupBy(prompt).agg(F.count("*").alias("n"))
    median = exact_quantiles(per_prompt, [], "n", {"m": 0.5})
    return per_prompt.agg(
        F.count("*").alias("n_prompts"),
        F.min("n").alias("min_n"),
        median.scalar().cast("bigint").alias("median_n"),
        F.max("n").alias("max_n"),
    )


def seed_spread(df: DataFrame, prompt: str = "prompt_id", score: str = "score", min_n: int = 20) -> DataFrame:
    """n, p10, p50, p90 of the score per prompt with at least `min_n` rows (null scores count)."""
    sizes = (
        df.filter(F.col(prompt).isNotNull())
        .groupBy(prompt)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_n)
    )
    quantiles = exact_quantiles(df, [prompt], score, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return sizes.join(quantiles, prompt, "left")


def spread_median(spread: DataFrame) -> DataFrame:
    gaps = spread.select((F.col("p90") - F.col("p10")).alias("gap"))
    return exact_quantiles(gaps, [], "gap", {"spread_median": 0.5})


def sweep_prompt(spread: DataFrame, prompt: str = "prompt_id", min_n: int = 200, explicit=None) -> DataFrame:
    """The prompt with the widest p10-p90 range; no row when none has `min_n` rows."""
    ranged = spread.withColumn("spread", F.col("p90") - F.col("p10"))
    if explicit is not None:
        return ranged.filter(F.col(prompt) == explicit)
    wide = ranged.filter(F.col("n") >= min_n)
    return wide.orderBy(F.col("spread").desc_nulls_last(), prompt).limit(1)


def spread_series(spread: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """The spread with `x`, its 0-based rank by median."""
    return ordered_positions(spread, [F.col("p50").asc_nulls_last(), F.col(prompt)], "x")


def date_span(df: DataFrame, created: str = "created_at") -> DataFrame:
    return df.agg(
        F.substring(F.min(created), 1, 10).alias("first_day"),
        F.substring(F.max(created), 1, 10).alias("last_day"),
    )


def recipe_constants(df: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """First row's value (by id) of each column, and whether all rows agree with it."""
    first = df.agg(F.min_by(F.struct(*columns), F.col(key)).alias("__first"), *[
        flag
        for c in columns
        for flag in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"), F.count(c).alias(f"__n_{c}"))
    ], F.count("*").alias("__n"))

    def same(c: str) -> Column:
        full = F.col(f"__n_{c}").isin(0) | (F.col(f"__n_{c}") == F.col("__n"))
        return full & F.col(f"__lo_{c}").eqNullSafe(F.col(f"__hi_{c}"))

    return first.select(*[
        out for c in columns for out in (F.col(f"__first.{c}").alias(c), same(c).alias(f"{c}_constant"))
    ])


def throughput(df: DataFrame, ts: str, size: str) -> DataFrame:
    """Rows and bytes per hour."""
    return df.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour")).agg(
        F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes")
    )


def retention_summary(df: DataFrame, reason: str, size: str) -> DataFrame:
    """Objects and bytes per reason, and a total row."""
    label = F.when(F.grouping(reason) == 1, "Total").otherwise(F.col(reason))
    return df.rollup(reason).agg(
        label.alias("label"), F.count("*").alias("objects"), F.sum(size).alias("n_bytes")
    ).select("label", "objects", "n_bytes")
