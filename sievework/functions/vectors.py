"""Array arithmetic on embeddings and logits, in built-in higher-order functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from sievework.functions.binding import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2_normalize(vector: Column, width: int | None = None) -> Column:
    """Vector over its norm as doubles; entries are null for a zero vector.

    A wrong width fails the job when `width` is given.
    """
    wide = vector.cast("array<double>")
    scaled = let(
        F.sqrt(_sum(F.transform(wide, lambda x: x * x))),
        lambda norm: F.transform(wide, lambda x: F.try_divide(x, norm)),
    )
    if width is None:
        return scaled
    return F.when(F.assert_true(F.size(vector) == width).isNull(), scaled)


def collapse_layers(
    layers: Sequence[tuple[Sequence[Sequence[float]], Sequence[float]]],
) -> tuple[list[float], float]:
    """Linear layers without activation are one affine map: its weights and bias."""
    import numpy as np

    weight, bias = None, None
    for w, b in layers:
        w, b = np.asarray(w, dtype="float64"), np.asarray(b, dtype="float64")
        weight, bias = (w, b) if weight is None else (w @ weight, w @ bias + b)
    return weight[0].tolist(), float(bias[0])


def linear_head(vector: Column, weights: Sequence[float], bias: float) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return _sum(F.zip_with(vector.cast("array<double>"), w, lambda x, y: x * y)) + F.lit(float(bias))


def softmax_prob(logits: Column, labels: Sequence[str], label: str) -> Column:
    """Probability of one label; the largest logit is subtracted first."""
    wide = logits.cast("array<double>")
    powers = let(F.array_max(wide), lambda top: F.transform(wide, lambda x: F.exp(x - top)))
    return let(powers, lambda p: F.element_at(p, labels.index(label) + 1) / _sum(p))


def round_score(value: Column, digits: int) -> Column:
    return F.bround(value, digits)
