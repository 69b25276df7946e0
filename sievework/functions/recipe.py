"""Recipe fields as column expressions. Lookup tables are literals, so no join is needed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from sievework import schema as S


def lookup(key: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """Value of a small literal table by key."""
    if not table:
        return default if default is not None else F.lit(None)
    out = None
    for k, v in table.items():
        value = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out.otherwise(default) if default is not None else out


def decorate_prompt(subject: Column) -> Column:
    return F.concat(subject, F.lit(", "), F.lit(S.PROMPT_SUFFIX))


def freeu_struct(values: Mapping[str, float] = S.FREEU) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def model_attribution(model: Column, repos: Mapping[str, str] = S.MODEL_REPOS) -> dict[str, Column]:
    """Attribution recorded for a new artifact of `model`."""
    tuned = model.isin("sdxl-refined", "sdxl-base", "juggernaut")
    refined = model == "sdxl-refined"
    return {
        "vae": F.when(tuned, F.lit(S.VAE)).otherwise("default"),
        "scheduler": F.when(tuned, F.lit(S.SCHEDULER)).otherwise("default"),
        "freeu": F.when(tuned, freeu_struct()),
        "aesthetic_score": F.when(refined, F.lit(S.AESTHETIC_SCORE)),
        "negative_aesthetic_score": F.when(refined, F.lit(S.NEGATIVE_AESTHETIC_SCORE)),
        "model_repo": lookup(model, repos, F.lit("unknown")),
    }


# One entry per era: first name timestamp, then the values that hold from it on.
ERAS: list[tuple[str, dict[str, object]]] = [
    (
        "",
        {
            "vae": "default",
            "scheduler": S.OLD_SCHEDULER,
            "freeu": None,
            "aesthetic_score": None,
            "negative_aesthetic_score": None,
            "pipeline_version": 1,
        },
    ),
    (
        S.ERA_START,
        {
            "vae": S.VAE,
            "scheduler": S.SCHEDULER,
            "freeu": S.FREEU,
            "aesthetic_score": S.AESTHETIC_SCORE,
            "negative_aesthetic_score": S.NEGATIVE_AESTHETIC_SCORE,
            "pipeline_version": 2,
        },
    ),
]

_ERA_TYPES = {
    "vae": "string",
    "scheduler": "string",
    "freeu": "struct<b1:double,b2:double,s1:double,s2:double>",
    "aesthetic_score": "double",
    "negative_aesthetic_score": "double",
    "pipeline_version": "int",
}


def era_attribution(
    ts: Column, eras: Sequence[tuple[str, Mapping[str, object]]] = ERAS
) -> dict[str, Column]:
    """As-of lookup: the last era whose start is not after `ts` (text order, start included)."""
    newest_first = sorted(eras, key=lambda era: era[0], reverse=True)
    out = {}
    for field, kind in _ERA_TYPES.items():
        case = None
        for start, values in newest_first:
            raw = values[field]
            value = freeu_struct(raw) if isinstance(raw, Mapping) else F.lit(raw)
            hit, value = ts >= start, value.cast(kind)
            case = F.when(hit, value) if case is None else case.when(hit, value)
        out[field] = case
    return out


def fill_absent(raw: Column, parsed: Mapping[str, Column], fills: Mapping[str, Column]) -> dict[str, Column]:
    """Per field: the fill where the JSON key is absent; an explicit null stays null."""
    keys = F.json_object_keys(raw)
    return {
        field: F.when(F.array_contains(keys, field), parsed[field]).otherwise(value)
        for field, value in fills.items()
    }


def size_for(
    category: Column,
    width: Column | None = None,
    height: Column | None = None,
    sizes: Mapping[str, tuple[int, int]] = S.CATEGORY_SIZES,
) -> dict[str, Column]:
    """Width and height by category; a given size wins only if both parts are given and not 0."""
    width = F.lit(None).cast("int") if width is None else width
    height = F.lit(None).cast("int") if height is None else height
    given = (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)
    out = {}
    for i, (name, own) in enumerate((("width", width), ("height", height))):
        by_category = lookup(
            category, {k: v[i] for k, v in sizes.items()}, F.lit(S.DEFAULT_SIZE[i])
        )
        out[name] = F.when(given, own).otherwise(by_category).cast("int")
    return out


def effective_params(model: Column, steps: Column, guidance: Column, negative: Column) -> dict[str, Column]:
    """What a run uses, against what the record keeps: one model caps steps and drops guidance."""
    distilled = model == "flux"
    capped = F.when(F.coalesce(steps, F.lit(0)) == 0, S.FLUX_MAX_STEPS).otherwise(
        F.least(steps, F.lit(S.FLUX_MAX_STEPS))
    )
    return {
        "requested_steps": steps,
        "effective_steps": F.when(distilled, capped).otherwise(steps),
        "requested_guidance": guidance,
        "effective_guidance": F.when(distilled, F.lit(0.0)).otherwise(guidance),
        "effective_negative": F.when(~distilled, negative),
    }
