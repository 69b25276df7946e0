"""Reproducible draws: every number is a hash of the seed, the row index and a purpose."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def _hash32(seed: int | str, index: Column, purpose: str) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), index.cast("string"), F.lit(purpose))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, index: Column, purpose: str) -> Column:
    """Double in [0, 1)."""
    return _hash32(seed, index, purpose) / F.lit(float(2**32))


def cumulative_weights(weights: Mapping[str, float]) -> list[tuple[str, float, float]]:
    """Half-open interval [low, high) per name, in name order."""
    out, low = [], 0.0
    for name in sorted(weights):
        high = low + weights[name]
        out.append((name, low, high))
        low = high
    return out


def weighted_choice(u: Column, weights: Mapping[str, float]) -> Column:
    """Name whose interval holds `u` times the total weight."""
    spans = cumulative_weights(weights)
    at = u * F.lit(spans[-1][2])
    out = None
    for name, _, high in spans[:-1]:
        out = F.when(at < high, name) if out is None else out.when(at < high, name)
    return F.lit(spans[-1][0]) if out is None else out.otherwise(spans[-1][0])


def seed_schedule(index: Column, base: int | None = None, draw_seed: int | str = 0) -> Column:
    """`base + index`, or without a base an independent draw in 0..2^31-1."""
    if base is not None:
        return F.lit(base).cast("bigint") + index
    return F.pmod(_hash32(draw_seed, index, "seed"), F.lit(2**31))
