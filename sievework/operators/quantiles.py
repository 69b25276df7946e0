"""Exact linear-interpolation quantiles whose groups may be of any size and whose values may lie anywhere.

Rows are first counted per (key, value). The counted values are range-sorted over the cluster with
running counts (`ordering.running_sums`), so neither a key with most of the values nor values that
lie close together meet in one task; a key's own counts begin where its smallest value does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievework.operators.ordering import attach, running_sums
from sievework.session import freeze


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per key with a column per entry of `probs`; null keys, null and NaN values are skipped."""
    grouped = list(keys) or ["__all"]
    v = F.col(value).cast("double")
    source = df if keys else df.withColumn("__all", F.lit(1))
    known = F.col("__v").isNotNull() & ~F.isnan("__v")
    for key in grouped:
        known = known & F.col(key).isNotNull()
    counted = source.select(*grouped, v.alias("__v")).filter(known).groupBy(*grouped, "__v").agg(F.count("*").alias("__c"))
    summed = freeze(running_sums(counted, [*grouped, "__v"], {"__end": F.col("__c")}))
    spans = summed.groupBy(*grouped).agg(F.min(F.col("__end") - F.col("__c")).alias("__start"), F.sum("__c").alias("__n"))
    rows = attach(summed, spans, grouped).withColumn("__end", F.col("__end") - F.col("__start"))

    def covers(position: Column) -> Column:
        return (position < F.col("__end")) & (position >= F.col("__end") - F.col("__c"))

    picks = []
    for name, p in probs.items():
        target = (F.col("__n") - 1) * F.lit(float(p))
        picks += [
            F.max(F.when(covers(F.floor(target)), F.col("__v"))).alias(f"__lo_{name}"),
            F.max(F.when(covers(F.ceil(target)), F.col("__v"))).alias(f"__hi_{name}"),
        ]
    found = rows.groupBy(*grouped).agg(F.max("__n").alias("__n"), *picks)
    out = []
    for name, p in probs.items():
        target = (F.col("__n") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        between = low + (high - low) * (target - F.floor(target))
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return found.select(*keys, *out)
