"""Artifact names: `timestamp_model_category_slug_sSEED`, and the older form without the model."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from sievework.schema import CATEGORIES, MODELS


def slugify(text: Column, max_len: int = 50) -> Column:
    """Lower-case words joined by `-`. The cut comes last, so a slug may end in `-`."""
    dashed = F.btrim(F.regexp_replace(text, "[^a-zA-Z0-9]+", "-"), F.lit("-"))
    cut = F.substring(F.lower(dashed), 1, max_len)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("image"))


def _any_of(words: Iterable[str]) -> str:
    # Longest first: one category may start with another one and `_`.
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def parse_artifact_name(
    stem: Column, categories: Iterable[str] = CATEGORIES, models: Iterable[str] = MODELS
) -> Column:
    """Struct (ts, category, slug, seed, seed_text) of an old-form stem, or null."""
    pattern = (
        rf"(?d)^(\d{{8}}-\d{{6}})_(?!(?:{_any_of(models)})_)({_any_of(categories)})_(.*)_s(\d+)$"
    )

    def part(n: int) -> Column:
        return F.regexp_extract(stem, pattern, n)

    seed_text = F.regexp_replace(part(4), r"^0+(?=\d)", "")
    return F.when(
        stem.rlike(pattern),
        F.struct(
            part(1).alias("ts"),
            part(2).alias("category"),
            part(3).alias("slug"),
            seed_text.try_cast("bigint").alias("seed"),
            seed_text.alias("seed_text"),
        ),
    )


def is_new_format(stem: Column, models: Iterable[str] = MODELS) -> Column:
    return F.split_part(stem, F.lit("_"), F.lit(2)).isin(*models)


def build_artifact_name(
    ts: Column, model: Column, category: Column, slug: Column, seed: Column
) -> Column:
    shown = F.coalesce(F.nullif(category, F.lit("")), F.lit("custom"))
    return F.concat_ws("_", ts, model, shown, slug, F.concat(F.lit("s"), seed.cast("string")))


def created_at(artifact_id: Column) -> Column:
    """ISO local time from the timestamp an id starts with."""
    ts = F.split_part(artifact_id, F.lit("_"), F.lit(1))

    def cut(start: int, size: int) -> Column:
        return F.substring(ts, start, size)

    return F.concat(
        cut(1, 4), F.lit("-"), cut(5, 2), F.lit("-"), cut(7, 2), F.lit("T"),
        cut(10, 2), F.lit(":"), cut(12, 2), F.lit(":"), cut(14, 2),
    )
