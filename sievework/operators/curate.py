"""Pairing, exclusion classes, the rename plan and the published row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievework import schema as S
from sievework.functions import names, recipe
from sievework.operators.ordering import carried_forward
from sievework.session import freeze


def pair_inner(payloads: DataFrame, sidecars: DataFrame, key: str = "id") -> DataFrame:
    return payloads.join(sidecars, key)


def missing_pair_anti(payloads: DataFrame, sidecars: DataFrame, key: str = "id") -> DataFrame:
    return payloads.join(sidecars, key, "left_anti").orderBy(key)


def score_left_join(rows: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(scores, key, "left")


def manual_exclusion(rows: DataFrame, listed: DataFrame, key: str = "id", keep: bool = True) -> DataFrame:
    """Rows that are not in the exclusion list (`keep`), or only those that are."""
    return rows.join(listed.select(key), key, "left_anti" if keep else "left_semi")


def resume_work(payloads: DataFrame, done: DataFrame, order: str, key: str = "id", limit: int = 0) -> DataFrame:
    """Payloads not yet scored in `order`; at most `limit` of them when it is positive."""
    todo = payloads.join(done.select(key), key, "left_anti").orderBy(order)
    return todo.limit(limit) if limit > 0 else todo


def over_threshold(prob: Column, threshold: float) -> Column:
    """True at or over the threshold; false for null and NaN, which Spark would sort highest."""
    return F.coalesce((prob >= threshold) & ~F.isnan(prob), F.lit(False))


def score_duplicates(scores: DataFrame, key: str = "id") -> DataFrame:
    """(key, n): ids that are scored more than once."""
    return scores.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def unique_scores(scores: DataFrame, key: str = "id") -> DataFrame:
    """The scores; the job fails when it meets an id that is scored twice."""
    values = [c for c in scores.columns if c != key]
    first = [F.first(F.struct(*values)).alias("__row"), F.count("*").alias("__n")]
    message = F.concat(F.lit("scored more than once: "), F.col(key).cast("string"))
    checked = F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(message))
    return scores.groupBy(key).agg(*first).select(key, checked.alias("__row")).select(key, "__row.*")


def exclusion_class(
    payloads: DataFrame,
    sidecars: DataFrame,
    scores: DataFrame,
    manual: DataFrame,
    threshold: float = 0.5,
    key: str = "id",
) -> DataFrame:
    """Adds `class`: the first that holds of no_sidecar, manual, not_scored, nsfw, else kept.

    The threshold is tested on the double score; narrowing to float comes after it. The sidecar
    listing and the manual list are sets, so repeated ids change nothing; a repeated score fails.
    """
    joined = (
        payloads.join(sidecars.select(key).distinct().withColumn("__sidecar", F.lit(True)), key, "left")
        .join(manual.select(key).distinct().withColumn("__manual", F.lit(True)), key, "left")
        .join(unique_scores(scores, key).withColumn("__scored", F.lit(True)), key, "left")
    )
    case = (
        F.when(F.col("__sidecar").isNull(), "no_sidecar")
        .when(F.col("__manual").isNotNull(), "manual")
        .when(F.col("__scored").isNull(), "not_scored")
        .when(over_threshold(F.col("nsfw_prob"), threshold), "nsfw")
        .otherwise("kept")
    )
    return joined.withColumn("class", case).drop("__sidecar", "__manual", "__scored")


def counts_with_zeros(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Count per value of a fixed list, zeros included, in one aggregate."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    pairs = F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("n")) for v in values])
    return counts.select(F.inline(pairs))


def build_report(classified: DataFrame, prompts: DataFrame, manifest: DataFrame, threshold: float) -> DataFrame:
    """One row: rows, prompts, shards, shard bytes, threshold, count per exclusion class."""
    counts = classified.agg(
        F.count_if(F.col("class") == "kept").alias("rows"),
        F.create_map(
            *[x for c in S.EXCLUSION_CLASSES for x in (F.lit(c), F.count_if(F.col("class") == c))]
        ).alias("excluded_counts"),
    )
    shards = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"))
    return counts.select(
        "rows",
        prompts.agg(F.count("*")).scalar().alias("prompts"),
        shards.select("n").scalar().alias("shards"),
        shards.select("b").scalar().alias("shard_bytes"),
        F.lit(float(threshold)).alias("nsfw_threshold"),
        "excluded_counts",
    )


def caption_field(extra: Column, name: str) -> Column:
    """A text of the caption in an open map; null where there is none, or where it is no text."""
    return F.try_variant_get(extra, f"$.meme.{name}", "string")


def flatten_recipe(rows: DataFrame, meta: str = "meta", keep_extra: bool = False) -> DataFrame:
    """(id, meta, prompt_id, scores) -> the published row. Scores are narrowed here, last.

    With `keep_extra` the row ends in the whole open map, as a variant.
    """
    m, freeu = f"{meta}.", f"{meta}.freeu."
    extra = F.col(f"{meta}.extra")
    source = {
        "id": "id",
        "prompt_id": "prompt_id",
        "prompt": m + "prompt_full",
        "freeu_b1": freeu + "b1",
        "freeu_b2": freeu + "b2",
        "freeu_s1": freeu + "s1",
        "freeu_s2": freeu + "s2",
        "refiner_aesthetic_score": m + "aesthetic_score",
        "refiner_negative_aesthetic_score": m + "negative_aesthetic_score",
        "caption_top": caption_field(extra, "top_text"),
        "caption_bottom": caption_field(extra, "bottom_text"),
        "caption_format": caption_field(extra, "format"),
        "laion_aesthetic": "laion_aesthetic",
        "nsfw_prob": "nsfw_prob",
    }
    columns = []
    for name, kind in S.RECIPE_COLUMNS:
        value = names.created_at(F.col("id")) if name == "created_at" else source.get(name, m + name)
        columns.append((F.col(value) if isinstance(value, str) else value).cast(kind).alias(name))
    return rows.select(*columns, *([extra.alias("extra")] if keep_extra else []))


def era_asof(rows: DataFrame, at: str, eras: DataFrame, start: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds `era`, the row of `eras` (a struct of its other columns) that holds at each row's `at`.

    That is the era of the latest `start` that is not after it, among those of the same values of
    `by` (nulls match nulls), or null before the first. A null `at` has no era, and an era with a
    null start never begins; of several eras with one start the greatest row holds. Both tables may
    have any size, and an era or a time that most rows share is spread over many tasks: rows and
    eras are range-sorted together, and what holds at the end of a partition is carried over to the
    next, one row per partition.
    """
    values = [c for c in eras.columns if c not in (start, *by)]
    begun = eras.filter(F.col(start).isNotNull()).groupBy(*by, start).agg(F.max(F.struct(*values)).alias("__era"))
    left = rows.select(
        F.struct(*rows.columns).alias("__row"), *[F.col(c).alias(f"__k_{c}") for c in by], F.col(at).alias("__at"),
        F.lit(1).alias("__kind"), F.xxhash64(*[c for c, kind in rows.dtypes if kind != "variant" and "map<" not in kind]).alias("__tie"),
    )
    right = begun.select(
        *[F.col(c).alias(f"__k_{c}") for c in by], F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("bigint").alias("__tie"), "__era",
    )
    keys = [f"__k_{c}" for c in by]
    both = left.unionByName(right, allowMissingColumns=True)
    # The key travels with the era: one carried over from another key does not hold.
    both = both.withColumn("__held", F.when(F.col("__kind") == 0, F.struct(*keys, F.col("__at").alias("__from"), "__era")))
    carried = carried_forward(both, [*keys, "__at", "__kind", "__tie"], "__held")
    holds = F.col("__held").isNotNull() & F.col("__at").isNotNull()
    for k in keys:
        holds = holds & F.col(f"__held.{k}").eqNullSafe(F.col(k))
    out = carried.filter(F.col("__kind") == 1).select("__row.*", F.when(holds, F.col("__held.__era")).alias("era"))
    return out




def _fills(ts: str, eras, repos) -> dict[str, Column]:
    """What an absent attribution field is filled with, by era and model; reads `__meta`."""
    fills = recipe.era_attribution(F.col(ts), eras)
    model = F.coalesce(F.nullif(F.col("__meta.model"), F.lit("")), F.lit(S.DEFAULT_MODEL))
    fills["model_repo"] = recipe.lookup(model, repos, F.lit("unknown"))
    return fills


def attribution_backfill(
    df: DataFrame, raw: str, ts: str, name: str = "backfilled", eras=recipe.ERAS, repos=S.OLD_MODEL_REPOS
) -> DataFrame:
    """Adds `name`: the whole JSON object with the absent attribution keys put at its end.

    What the object holds stays as it is, byte for byte: unknown keys, explicit nulls and their
    order. Text that is no JSON object stays unchanged.
    """
    rows = df.withColumns({"__meta": F.from_json(raw, S.SIDECAR_SCHEMA), "__keys": F.json_object_keys(raw)})

    def added(key: str, value: Column) -> Column:
        written = F.to_json(F.struct(value.alias(key)), {"ignoreNullFields": "false"})
        return F.when(~F.array_contains("__keys", key), F.substr(written, F.lit(2), F.length(written) - 2))

    pieces = F.array_compact(F.array(*[added(k, v) for k, v in _fills(ts, eras, repos).items()]))
    body = F.rtrim(F.col(raw), F.lit(" \t\r\n"))
    open_ = F.substr(body, F.lit(1), F.length(body) - 1)
    comma = F.when(F.size("__keys") > 0, ",").otherwise("")
    merged = F.concat(open_, comma, F.array_join("__new", ","), F.lit("}"))
    filled = rows.withColumn("__new", pieces)
    result = F.when(F.size("__new") > 0, merged).otherwise(F.col(raw))
    return filled.withColumn(name, F.when(F.col("__keys").isNull(), F.col(raw)).otherwise(result)).drop("__meta", "__keys", "__new")


def attribution_fill(
    df: DataFrame, raw: str, ts: str, eras=recipe.ERAS, repos=S.OLD_MODEL_REPOS
) -> DataFrame:
    """Adds the attribution fields: kept where the JSON has the key, else by era and model."""
    parsed = F.from_json(raw, S.SIDECAR_SCHEMA)
    rows = df.withColumn("__meta", parsed)
    fills = _fills(ts, eras, repos)
    filled = recipe.fill_absent(F.col(raw), {k: F.col(f"__meta.{k}") for k in fills}, fills)
    return rows.withColumns(filled).drop("__meta")


def rename_plan(
    payloads: DataFrame,
    sidecars: DataFrame,
    categories: Iterable[str] = S.CATEGORIES,
    models: Iterable[str] = S.MODELS,
    dry_run: bool = False,
) -> DataFrame:
    """(stem, outcome, new_stem) per payload; payloads has `stem`, sidecars has `stem` and `raw`.

    A target is taken if a file has that name already, or if an earlier row of this run (by file
    name) moves there. The dry run does not see the second kind.
    """
    parsed = names.parse_artifact_name(F.col("stem"), categories, models)
    json = sidecars.select("stem", "raw", F.lit(True).alias("__json"))
    rows = payloads.select("stem").join(json, "stem", "left").withColumn("__p", parsed)
    model = F.coalesce(
        F.nullif(F.get_json_object("raw", "$.model"), F.lit("")), F.lit(S.DEFAULT_MODEL)
    )
    target = names.build_artifact_name(
        F.col("__p.ts"), model, F.col("__p.category"), F.col("__p.slug"), F.col("__p.seed_text")
    )
    early = (
        F.when(names.is_new_format(F.col("stem"), models), "already_new")
        .when(F.col("__p").isNull(), "unparseable")
        .when(F.col("__json").isNull(), "missing_json")
        .when(F.try_parse_json("raw").isNull(), "json_unreadable")
    )
    # Written once: the claims below and the plan itself both read it.
    rows = freeze(
        rows.select("stem", early.alias("__early"), F.when(early.isNull(), target).alias("new_stem"))
    )
    # One row per name that is wanted or taken: the first claimant, and whether it exists already.
    claims = rows.filter(F.col("new_stem").isNotNull()).select(
        F.col("new_stem").alias("__name"),
        F.concat("stem", F.lit(".png")).alias("__by"),
        F.lit(False).alias("__exists"),
    )
    taken = payloads.select("stem").unionByName(sidecars.select("stem")).select(
        F.col("stem").alias("__name"), F.lit(None).cast("string").alias("__by"), F.lit(True).alias("__exists")
    )
    targets = claims.unionByName(taken).groupBy("__name").agg(
        F.min("__by").alias("__first"), F.max("__exists").alias("__exists")
    )
    targets = targets.filter(F.col("__first").isNotNull()).withColumnRenamed("__name", "new_stem")
    late = F.col("__exists") if dry_run else (
        F.col("__exists") | (F.concat("stem", F.lit(".png")) > F.col("__first"))
    )
    # Rows decided early have no target; kept out of the join, they cannot pile up on one null key.
    decided = rows.filter(F.col("new_stem").isNull()).select(
        "stem", F.col("__early").alias("outcome"), F.lit(None).cast("string").alias("new_stem")
    )
    wanted = rows.filter(F.col("new_stem").isNotNull()).join(targets, "new_stem").select(
        "stem",
        F.when(late, "collision").otherwise("renamed").alias("outcome"),
        F.when(~late, F.col("new_stem")).alias("new_stem"),
    )
    return decided.unionByName(wanted)
