"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, with `value` evaluated once however often `body` uses it.

    Inside higher-order functions an expression is otherwise evaluated again for every element. It
    is a fold over nothing: the start value is bound for the finishing function without a copy.
    """
    nothing = F.array().cast("array<boolean>")
    return F.aggregate(nothing, value, lambda bound, _: bound, body)
