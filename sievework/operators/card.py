"""What a published dataset's card states, as one table of facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievework import schema as S
from sievework.operators.ordering import ordered_positions
from sievework.operators.quantiles import exact_quantiles
from sievework.operators.stats import recipe_constants, seed_spread, spread_median
from sievework.session import freeze

COLUMNS = ["block", "rank", "label", "n", "m", "value"]


def _facts(df: DataFrame, block: str, rank: Column, label: Column, n: Column | None = None, m: Column | None = None, value: Column | None = None) -> DataFrame:
    """(block, rank, label, n, m, value): a name, up to two counts and a number."""
    count = [F.lit(None).cast("bigint") if c is None else c.cast("bigint") for c in (n, m)]
    number = F.lit(None).cast("double") if value is None else value.cast("double")
    return df.select(F.lit(block).alias("block"), rank.cast("bigint").alias("rank"), label.alias("label"), count[0].alias("n"), count[1].alias("m"), number.alias("value"))


def _row_facts(row: DataFrame, block: str, entries: Sequence[tuple]) -> DataFrame:
    """A fact per entry (label, n, value) of a table of one row; entries are expressions over it."""
    cells = [
        F.struct(F.lit(i + 1).cast("bigint").alias("rank"), label.cast("string").alias("label"), (F.lit(None) if n is None else n).cast("bigint").alias("n"),
                 (F.lit(None) if value is None else value).cast("double").alias("value"))
        for i, (label, n, value) in enumerate(entries)
    ]
    listed = row.select(F.inline(F.array(*cells)))
    return _facts(listed, block, F.col("rank"), F.col("label"), F.col("n"), None, F.col("value"))


def dataset_card(
    rows: DataFrame,
    report: DataFrame,
    main: Column,
    constants: Sequence[str],
    prompt: str = "prompt_id",
    score: str = "score",
    caption: str = "caption",
    created: str = "created_at",
    min_seeds: int = 20,
) -> DataFrame:
    """(block, rank, label, n, m, value) of all that a card tells of the published rows and of their build.

    Blocks: `head` (rows, prompts, rows of the main recipe, which `main` tells, captions), `days`
    (first and last), `seeds` (least, median and most rows of a prompt), `spread` (prompts with
    `min_seeds` rows; the median of their p10 to p90 gaps), `category` (rows, prompts, median score,
    most rows first), `size`, `recipe` (first value by id of each of `constants` in the main recipe,
    n = 1 if all rows agree), `files` (shards, GiB) and `removed` (rows of each exclusion class).

    All counts come from one pass: rows are counted per (category, size, prompt), and the small
    table of these counts is rolled up. Scores are read again for their quantiles, and the rows of
    the main recipe for its values, so give it rows that are written, not ones that are costly to
    make. Rows with a null category or prompt count in `head` and `size` only.
    """
    counted = rows.groupBy("category", "width", "height", prompt).agg(
        F.count("*").alias("n"), F.count_if(main).alias("main"), F.count(caption).alias("captions"), F.min(created).alias("first"), F.max(created).alias("last")
    )
    counted = freeze(counted)
    head = counted.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "main", "captions")], F.count_distinct(prompt).alias("prompts"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    blocks = [
        _row_facts(head, "head", [(F.lit(label), F.col(c), None) for label, c in (("rows", "n"), ("prompts", "prompts"), ("main recipe", "main"), ("captions", "captions"))]),
        _row_facts(head, "days", [(F.substring("first", 1, 10), None, None), (F.substring("last", 1, 10), None, None)]),
    ]
    per_prompt = counted.filter(F.col(prompt).isNotNull()).groupBy(prompt).agg(F.sum("n").alias("n"))
    median = exact_quantiles(per_prompt, [], "n", {"m": 0.5})
    seeds = per_prompt.agg(F.min("n").alias("least"), F.max("n").alias("most")).withColumn("median", median.scalar().cast("bigint"))
    blocks.append(_row_facts(seeds, "seeds", [(F.lit(c), F.col(c), None) for c in ("least", "median", "most")]))
    spread = freeze(seed_spread(rows, prompt, score, min_seeds))
    gaps = spread.agg(F.count("*").alias("n")).withColumn("gap", spread_median(spread).scalar())
    blocks.append(_row_facts(gaps, "spread", [(F.lit("prompts"), F.col("n"), F.col("gap"))]))
    known = counted.filter("category IS NOT NULL").groupBy("category").agg(F.sum("n").alias("n"), F.count_distinct(prompt).alias("m"))
    scored = exact_quantiles(rows.filter("category IS NOT NULL"), ["category"], score, {"median": 0.5})
    categories = ordered_positions(known.join(scored, "category", "left"), [F.desc("n"), F.col("category")], "rank")
    blocks.append(_facts(categories, "category", F.col("rank") + 1, F.col("category"), F.col("n"), F.col("m"), F.col("median")))
    sizes = counted.groupBy("width", "height").agg(F.sum("n").alias("n"))
    sizes = ordered_positions(sizes, [F.desc("n"), F.col("width"), F.col("height")], "rank")
    shape = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    blocks.append(_facts(sizes, "size", F.col("rank") + 1, shape, F.col("n")))
    first = recipe_constants(rows.filter(main), list(constants))
    told = [(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))), F.col(f"{c}_constant").cast("bigint"), None) for c in constants]
    blocks.append(_row_facts(first, "recipe", told))
    blocks.append(_row_facts(report, "files", [(F.lit("shards"), F.col("shards"), F.col("shard_bytes") / F.lit(2.0**30))]))
    removed = [(F.lit(c), F.try_element_at("excluded_counts", F.lit(c)), F.col("nsfw_threshold") if c == "nsfw" else None) for c in S.EXCLUSION_CLASSES]
    blocks.append(_row_facts(report, "removed", removed))
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out
