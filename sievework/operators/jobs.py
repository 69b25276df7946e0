"""Job planning: draws, seeds, sizes, full recipe records and artifact names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievework import schema as S
from sievework.functions import draws, names, recipe
from sievework.operators.ordering import positions_within
from sievework.session import freeze
from sievework.sources.indexes import IndexSource


def index_source(
    spark: SparkSession, n: int | None = None, start: int = 0, end: int | None = None, per_trigger: int = 1000, partitions: int = 8
) -> DataFrame:
    """Indexes 0..n-1, or without `n` a stream of them from `start` on, endless unless `end` is given.

    A stream takes `per_trigger` indexes in each micro-batch; stopped and started again with its
    checkpoint, it goes on where it was, so that no index is lost or comes twice.
    """
    if n is not None:
        return spark.range(n).withColumnRenamed("id", "index")
    spark.dataSource.register(IndexSource)
    options = {"start": start, "perTrigger": per_trigger, "partitions": partitions} | ({} if end is None else {"end": end})
    return spark.readStream.format(IndexSource.name()).options(**options).load()


def prompt_bank(subjects: DataFrame) -> DataFrame:
    """(category, subject, position, size) of a table of subjects; positions are in subject order.

    Written once: draws look it up again and again.
    """
    bank = subjects.select("category", "subject").distinct()
    return freeze(positions_within(bank, ["category"], ["subject"], "position", size="size"))


def bank_sizes(bank: DataFrame) -> DataFrame:
    return bank.groupBy("category").agg(F.first("size").alias("size"))


def weighted_draw(
    indexes: DataFrame,
    bank: DataFrame,
    weights: Mapping[str, float],
    seed: int | str,
    category: str | None = None,
) -> DataFrame:
    """Adds the drawn `category` and `subject`: category by weight, subject evenly inside it.

    The weight intervals are a literal, so the first draw is a projection. The second is an equi
    join on (category, position); positions spread a large category over many keys. A drawn
    category without subjects fails the job, so there is one row out for each index.
    """
    if category is not None and category not in weights:
        raise ValueError(f"unknown category {category!r}")
    drawn = F.lit(category) if category is not None else draws.weighted_choice(
        draws.uniform(seed, F.col("index"), "c"), weights
    )
    rows = indexes.withColumn("category", drawn).join(bank_sizes(bank), "category", "left")
    # The size is used below only where the check has passed.
    missing = F.concat(F.lit("no subject in category "), F.coalesce("category", F.lit("null")))
    size = F.coalesce("size", F.raise_error(missing).cast("bigint"))
    at = F.floor(draws.uniform(seed, F.col("index"), "s") * size)
    subjects = bank.select("category", "position", "subject")
    return rows.withColumn("position", at).join(subjects, ["category", "position"], "left").drop("position", "size")


def custom_subject(indexes: DataFrame, subject: str) -> DataFrame:
    """A given subject in place of a draw; its category is `custom`."""
    return indexes.withColumns({"category": F.lit("custom"), "subject": F.lit(subject)})


def plan_jobs(
    drawn: DataFrame,
    model: str = S.DEFAULT_MODEL,
    base_seed: int | None = None,
    draw_seed: int | str = 0,
    steps: int = 40,
    refiner_steps: int = 15,
    guidance: float = 6.5,
    high_noise_frac: float = 0.8,
    width: int | None = None,
    height: int | None = None,
    ts: Column | None = None,
    sizes: Mapping[str, tuple[int, int]] = S.CATEGORY_SIZES,
) -> DataFrame:
    """Drawn rows (index, category, subject) -> the 21-field record and the artifact name."""
    for value in (width, height):
        if value is not None and value % 8:
            raise ValueError("width and height must be multiples of 8")
    size = recipe.size_for(
        F.col("category"), F.lit(width).cast("int"), F.lit(height).cast("int"), sizes
    )
    attribution = recipe.model_attribution(F.lit(model))
    record = drawn.withColumn("seed", draws.seed_schedule(F.col("index"), base_seed, draw_seed)).select(
        "index",
        F.lit(model).alias("model"),
        F.col("subject").alias("prompt_subject"),
        recipe.decorate_prompt(F.col("subject")).alias("prompt_full"),
        F.lit(S.NEGATIVE_PROMPT).alias("negative_prompt"),
        "category",
        "seed",
        F.lit(steps).alias("steps"),
        F.lit(refiner_steps).alias("refiner_steps"),
        F.lit(float(guidance)).alias("guidance_scale"),
        size["width"].alias("width"),
        size["height"].alias("height"),
        F.lit(float(high_noise_frac)).alias("high_noise_frac"),
        F.lit(0.0).alias("elapsed_seconds"),
        *[attribution[k].alias(k) for k in ("model_repo", "vae", "scheduler", "freeu",
                                            "aesthetic_score", "negative_aesthetic_score")],
        F.lit(2).alias("pipeline_version"),
        F.create_map().cast("map<string,string>").alias("extra"),
    )
    stamp = F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss") if ts is None else ts
    return record.withColumn(
        "stem",
        names.build_artifact_name(
            stamp, F.col("model"), F.col("category"), names.slugify(F.col("prompt_subject")), F.col("seed")
        ),
    )


def validate_jobs(
    jobs: DataFrame, categories: Iterable[str] = S.CATEGORIES, models: Iterable[str] = S.MODELS
) -> DataFrame:
    """Adds `violations`: which of width, height, category and model are not acceptable."""
    checks = F.array(
        F.when(F.col("width") % 8 != 0, "width"),
        F.when(F.col("height") % 8 != 0, "height"),
        F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "category"),
        F.when(~F.coalesce(F.col("model").isin(*models), F.lit(False)), "model"),
    )
    return jobs.withColumn("violations", F.filter(checks, lambda v: v.isNotNull()))


def batch_variations(prompts: DataFrame, index: str, n: int, base_seed: int) -> DataFrame:
    """n rows per prompt on one seed schedule: seed = base + running index."""
    rows = prompts.withColumn("variation", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn(
        "seed", F.lit(base_seed).cast("bigint") + F.col(index) * F.lit(n) + F.col("variation")
    )
