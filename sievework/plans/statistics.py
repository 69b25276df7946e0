"""Counts, spreads, samples and card of the published rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework.operators import card, curate, ids, index, ordering, sample, stats
from sievework.operators.quantiles import exact_quantiles
from sievework.plans.registry import query
from sievework.plans.views import IMG, img
from sievework.session import freeze

# Rows a prompt needs to be a sweep candidate: the least that the given tables reach for most users.
SWEEP_MIN = 60

_SPREAD = IMG + """,
spread AS (
  SELECT user_id AS prompt_id, count(*) AS n, quantile_cont(score, 0.1) AS p10,
    quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.9) AS p90
  FROM img GROUP BY user_id HAVING count(*) >= 20
)"""

_PICKS = IMG + """,
nocap AS (SELECT * FROM img WHERE caption IS NULL),
best AS (
  SELECT * FROM nocap QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, id) = 1
),
rest AS (SELECT * FROM nocap WHERE id NOT IN (SELECT id FROM best)),
fill AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM rest)
  WHERE rn <= (SELECT (4 - count(*) % 4) % 4 FROM best)
)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _prompts(spark, sf):
    return img(spark, sf).withColumn("prompt_id", F.col("user_id"))


def _spread(spark, sf):
    return stats.seed_spread(_prompts(spark, sf))


def _nocap(spark, sf):
    return img(spark, sf).filter(F.col("caption").isNull()).select(
        "id", "category", "score", "width", "height"
    )


@query(
    "category_summary",
    f"""WITH {IMG} SELECT category, count(*) AS n_rows, count(DISTINCT user_id) AS n_prompts,
    round(quantile_cont(score, 0.5), 6) AS median_score FROM img GROUP BY category""",
)
def category_summary(spark, sf):
    return _rounded(stats.category_summary(_prompts(spark, sf)), "median_score")


@query(
    "mtime_quantiles",
    f"""WITH {IMG}, hot AS (SELECT CASE WHEN category = 'view' THEN category ELSE 'rest' END AS category, mtime_us::DOUBLE AS us FROM img)
    SELECT category, round(quantile_cont(us, 0.25), 3) AS q25, round(quantile_cont(us, 0.5), 3) AS q50, round(quantile_cont(us, 0.75), 3) AS q75
    FROM hot GROUP BY category""",
)
def mtime_quantiles(spark, sf):
    """Times in microseconds, which all lie close together; one category holds most rows."""
    category = F.when(F.col("category") == "view", F.col("category")).otherwise("rest")
    rows = img(spark, sf).select(category.alias("category"), F.col("mtime_us").cast("double").alias("us"))
    found = exact_quantiles(rows, ["category"], "us", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return found.select("category", *[F.round(q, 3).alias(q) for q in ("q25", "q50", "q75")])


@query("category_counts", f"WITH {IMG} SELECT category, count(*) AS n FROM img GROUP BY category")
def category_counts(spark, sf):
    return stats.category_counts(img(spark, sf))


@query(
    "size_counts",
    f"""WITH {IMG} SELECT CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, count(*) AS n
    FROM img GROUP BY width, height""",
)
def size_counts(spark, sf):
    return stats.size_counts(img(spark, sf)).withColumns(
        {c: F.col(c).cast("bigint") for c in ("width", "height")}
    )


@query(
    "per_prompt_counts",
    f"""WITH {IMG}, p AS (SELECT user_id, count(*) AS n FROM img GROUP BY user_id)
    SELECT count(*) AS n_prompts, min(n) AS min_n, CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT) AS median_n,
    max(n) AS max_n FROM p""",
)
def per_prompt_counts(spark, sf):
    return stats.per_prompt_counts(_prompts(spark, sf))


@query(
    "seed_spread",
    f"""WITH {_SPREAD} SELECT prompt_id, n, round(p10, 6) AS p10, round(p50, 6) AS p50,
    round(p90, 6) AS p90 FROM spread""",
)
def seed_spread(spark, sf):
    return _rounded(_spread(spark, sf), "p10", "p50", "p90")


@query(
    "spread_median",
    f"WITH {_SPREAD} SELECT round(quantile_cont(p90 - p10, 0.5), 6) AS spread_median FROM spread",
)
def spread_median(spark, sf):
    return _rounded(stats.spread_median(_spread(spark, sf)), "spread_median")


@query(
    "sweep_prompt",
    f"""WITH {_SPREAD} SELECT prompt_id, n, round(p90 - p10, 6) AS spread FROM spread
    WHERE n >= {SWEEP_MIN} ORDER BY p90 - p10 DESC, prompt_id LIMIT 1""",
)
def sweep_prompt(spark, sf):
    best = stats.sweep_prompt(_spread(spark, sf), min_n=SWEEP_MIN)
    return _rounded(best.select("prompt_id", "n", "spread"), "spread")


@query("facets", f"WITH {IMG} SELECT DISTINCT category AS cat FROM img")
def facets(spark, sf):
    return index.facets(img(spark, sf).withColumnRenamed("category", "cat"))


@query(
    "date_span",
    f"""WITH {IMG} SELECT substr(min(created_at), 1, 10) AS first_day, substr(max(created_at), 1, 10) AS last_day
    FROM img""",
)
def date_span(spark, sf):
    return stats.date_span(img(spark, sf))


@query(
    "non_null_counts",
    f"""WITH {IMG} SELECT count(caption) AS n_captions, count(*) FILTER (pipeline_version = 2) AS n_version_2
    FROM img""",
)
def non_null_counts(spark, sf):
    return img(spark, sf).agg(
        F.count("caption").alias("n_captions"), F.count_if(F.col("pipeline_version") == 2).alias("n_version_2")
    )


@query(
    "recipe_constants",
    f"""WITH {IMG}, v2 AS (SELECT * FROM img WHERE pipeline_version = 2)
    SELECT CAST(arg_min(width, id) AS BIGINT) AS width, min(width) = max(width) AS width_constant,
    CAST(arg_min(height, id) AS BIGINT) AS height, min(height) = max(height) AS height_constant,
    arg_min(model, id) AS model, min(model) = max(model) AS model_constant,
    CAST(arg_min(pipeline_version, id) AS BIGINT) AS pipeline_version,
    min(pipeline_version) = max(pipeline_version) AS pipeline_version_constant FROM v2""",
)
def recipe_constants(spark, sf):
    v2 = img(spark, sf).filter("pipeline_version = 2")
    out = stats.recipe_constants(v2, ["width", "height", "model", "pipeline_version"])
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("width", "height", "pipeline_version")})


@query(
    "subset_filters",
    f"""WITH {IMG}, big AS (SELECT user_id FROM img GROUP BY user_id HAVING count(*) >= 20)
    SELECT id, user_id, score FROM img WHERE caption IS NULL AND pipeline_version = 2 AND score >= 6.5
    AND user_id IN (SELECT user_id FROM big)""",
)
def subset_filters(spark, sf):
    rows = img(spark, sf)
    big = rows.groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 20").select("user_id")
    kept = rows.filter("caption IS NULL AND pipeline_version = 2 AND score >= 6.5")
    return kept.join(big, "user_id", "left_semi").select("id", "user_id", "score")


@query("best_per_group", f"WITH {_PICKS} SELECT category, id, score FROM best")
def best_per_group(spark, sf):
    return sample.best_per_group(_nocap(spark, sf), "category", "score").select("category", "id", "score")


@query("drop_picked", f"WITH {_PICKS} SELECT id, score FROM rest")
def drop_picked(spark, sf):
    rows = _nocap(spark, sf)
    picks = sample.best_per_group(rows, "category", "score")
    return sample.drop_picked(rows, picks).select("id", "score")


@query("fill_top_k", f"WITH {_PICKS} SELECT id, category, score FROM fill")
def fill_top_k(spark, sf):
    rows = _nocap(spark, sf)
    picks = sample.best_per_group(rows, "category", "score")
    return sample.fill_top_k(rows, picks, "score").select("id", "category", "score")


def _sheet(spark, sf):
    rows = _nocap(spark, sf)
    best = sample.best_per_group(rows, "category", "score").withColumn("part", F.lit(0))
    fill = sample.fill_top_k(rows, best, "score").withColumn("part", F.lit(1))
    return best.unionByName(fill)


@query(
    "union_append",
    f"WITH {_PICKS} SELECT id, 0 AS part FROM best UNION ALL SELECT id, 1 AS part FROM fill",
)
def union_append(spark, sf):
    return _sheet(spark, sf).select("id", "part")


@query(
    "sheet_layout",
    f"""WITH {_PICKS}, picks AS (
      SELECT id, width, height, 0 AS part, category AS o1, 0.0 AS o2 FROM best
      UNION ALL SELECT id, width, height, 1, '', -score FROM fill),
    p AS (SELECT *, row_number() OVER (ORDER BY part, o1, o2, id) - 1 AS slot, count(*) OVER () AS n,
      least(width, height) AS side FROM picks)
    SELECT id, slot, slot % 4 AS grid_column, slot // 4 AS grid_row, (slot % 4) * 404 AS x, (slot // 4) * 404 AS y,
      CAST(4 * 400 + 3 * 4 AS BIGINT) AS sheet_width, ((n + 3) // 4) * 400 + ((n + 3) // 4 - 1) * 4 AS sheet_height,
      CAST((width - side) // 2 AS BIGINT) AS crop_left, CAST((height - side) // 2 AS BIGINT) AS crop_top,
      CAST((width - side) // 2 + side AS BIGINT) AS crop_right,
      CAST((height - side) // 2 + side AS BIGINT) AS crop_bottom FROM p""",
)
def sheet_layout(spark, sf):
    best_first = F.when(F.col("part") == 0, F.col("category")).otherwise("")
    by_score = F.when(F.col("part") == 0, F.lit(0.0)).otherwise(-F.col("score"))
    order = [F.col("part"), best_first, by_score, F.col("id")]
    laid = sample.sheet_layout(_sheet(spark, sf), order)
    return laid.drop("part", "category", "score", "width", "height")


@query(
    "even_sample",
    f"""WITH {IMG}, r AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY score, id) - 1 AS rank,
      count(*) OVER (PARTITION BY user_id) AS n FROM img),
    s AS (SELECT unnest(range(8)) AS slot)
    SELECT r.user_id, s.slot, r.rank, r.id FROM r JOIN s ON r.rank = CAST(round_even(s.slot * (r.n - 1) / 7.0::DOUBLE, 0) AS BIGINT)""",
)
def even_sample(spark, sf):
    rows = img(spark, sf).select("user_id", "id", "score")
    out = sample.even_sample(rows, ["user_id"], "score")
    return out.select("user_id", F.col("slot").cast("bigint").alias("slot"), "rank", "id")


@query(
    "chart_series",
    f"""WITH {_SPREAD} SELECT prompt_id, row_number() OVER (ORDER BY p50, prompt_id) - 1 AS x, n,
    round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM spread""",
)
def chart_series(spark, sf):
    return _rounded(stats.spread_series(_spread(spark, sf)), "p10", "p50", "p90").select(
        "prompt_id", "x", "n", "p10", "p50", "p90"
    )


@query(
    "throughput",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n_rows,
    CAST(sum(512 + (event_id * 37) % 4096) AS BIGINT) AS n_bytes FROM events GROUP BY 1""",
)
def throughput(spark, sf):
    out = stats.throughput(img(spark, sf), "ts", "bytes")
    return out.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query(
    "run_cap",
    f"""WITH {IMG}, k AS (SELECT * FROM img QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 40),
    r AS (SELECT id, event_id, sum(bytes) OVER (ORDER BY event_id) AS running, row_number() OVER (ORDER BY event_id) AS rn FROM k)
    SELECT id, CAST(running AS BIGINT) AS running_bytes FROM r WHERE running <= 10000000 AND rn <= 4000""",
)
def run_cap(spark, sf):
    rows = img(spark, sf).select("id", "event_id", "user_id", "bytes")
    capped = ids.run_cap(
        rows, "event_id", "bytes", max_rows=4000, max_bytes=10_000_000, subject="user_id", per_subject=40
    )
    return capped.select("id", "running_bytes")


@query(
    "dataset_card",
    f"""WITH {IMG}, c AS (SELECT category, count(*) AS n, count(DISTINCT user_id) AS p, quantile_cont(score, 0.5) AS m
      FROM img GROUP BY category),
    s AS (SELECT width, height, count(*) AS n FROM img GROUP BY width, height),
    h AS (SELECT count(*) AS n, count(DISTINCT user_id) AS p, count(*) FILTER (pipeline_version = 2) AS v,
      count(caption) AS cap, min(created_at)[:10] AS f, max(created_at)[:10] AS l FROM img)
    SELECT 1 AS section, 1 AS rank, format('{{:,}}', n) || ' rows, ' || format('{{:,}}', p) || ' prompts, '
      || format('{{:,}}', v) || ' rows of the main recipe, ' || cap || ' captions, ' || f || ' to ' || l AS line FROM h
    UNION ALL
    SELECT 2, row_number() OVER (ORDER BY n DESC, category), '| ' || category || ' | ' || format('{{:,}}', n) || ' | '
      || format('{{:,}}', p) || ' | ' || printf('%.2f', m) || ' |' FROM c
    UNION ALL
    SELECT 3, row_number() OVER (ORDER BY n DESC, width, height),
      '| ' || width || ' × ' || height || ' | ' || format('{{:,}}', n) || ' |' FROM s""",
)
def dataset_card(spark, sf):
    rows = _prompts(spark, sf)

    def whole(c):
        return F.format_number(c, 0)

    def piped(*parts):
        return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))

    head = rows.agg(
        F.count("*").alias("n"),
        F.count_distinct("prompt_id").alias("p"),
        F.count_if(F.col("pipeline_version") == 2).alias("v"),
        F.count("caption").alias("cap"),
        F.min("created_at").alias("f"),
        F.max("created_at").alias("l"),
    ).select(
        F.lit(1).alias("section"),
        F.lit(1).cast("bigint").alias("rank"),
        F.concat(
            whole("n"), F.lit(" rows, "), whole("p"), F.lit(" prompts, "), whole("v"),
            F.lit(" rows of the main recipe, "), F.col("cap"), F.lit(" captions, "),
            F.substring("f", 1, 10), F.lit(" to "), F.substring("l", 1, 10),
        ).alias("line"),
    )
    categories = stats.category_summary(rows)
    categories = ordering.ordered_positions(categories, [F.desc("n_rows"), F.col("category")], "rank").select(
        F.lit(2).alias("section"),
        (F.col("rank") + 1).alias("rank"),
        piped("category", whole("n_rows"), whole("n_prompts"), F.replace(F.format_number("median_score", 2), F.lit(","), F.lit(""))).alias("line"),
    )
    sizes = ordering.ordered_positions(
        stats.size_counts(rows), [F.desc("n"), F.col("width"), F.col("height")], "rank"
    ).select(
        F.lit(3).alias("section"),
        (F.col("rank") + 1).alias("rank"),
        piped(F.concat_ws(" × ", F.col("width").cast("string"), F.col("height").cast("string")), whole("n")).alias("line"),
    )
    return head.unionByName(categories).unionByName(sizes)


_CONSTANTS = ["width", "model", "seed"]


@query(
    "dataset_card_facts",
    f"""WITH {IMG}, c AS (SELECT *, CASE WHEN k = 13 THEN 'manual' WHEN nsfw_prob >= 0.7 THEN 'nsfw' ELSE 'kept' END AS class FROM img),
    r AS (SELECT * FROM c WHERE class = 'kept'),
    per AS (SELECT user_id, count(*) AS n, quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.9) AS p90 FROM r GROUP BY user_id),
    cat AS (SELECT category, count(*) AS n, count(DISTINCT user_id) AS m, quantile_cont(score, 0.5) AS med FROM r GROUP BY category),
    sz AS (SELECT width, height, count(*) AS n FROM r GROUP BY width, height),
    v AS (SELECT * FROM r WHERE pipeline_version = 2),
    f AS (SELECT arg_min(width::VARCHAR, id) AS width, arg_min(model, id) AS model, arg_min(event_id::VARCHAR, id) AS seed,
      count(DISTINCT width) = 1 AS one_width, count(DISTINCT model) = 1 AS one_model, count(DISTINCT event_id) = 1 AS one_seed FROM v),
    x(block, rank, label, n, m, value) AS (
      SELECT 'head', 1, 'rows', count(*), NULL::BIGINT, NULL::DOUBLE FROM r
      UNION ALL SELECT 'head', 2, 'prompts', count(DISTINCT user_id), NULL, NULL FROM r
      UNION ALL SELECT 'head', 3, 'main recipe', count(*), NULL, NULL FROM v
      UNION ALL SELECT 'head', 4, 'captions', count(caption), NULL, NULL FROM r
      UNION ALL SELECT 'days', 1, min(created_at)[:10], NULL, NULL, NULL FROM r
      UNION ALL SELECT 'days', 2, max(created_at)[:10], NULL, NULL, NULL FROM r
      UNION ALL SELECT 'seeds', 1, 'least', min(n), NULL, NULL FROM per
      UNION ALL SELECT 'seeds', 2, 'median', CAST(trunc(quantile_cont(n, 0.5)) AS BIGINT), NULL, NULL FROM per
      UNION ALL SELECT 'seeds', 3, 'most', max(n), NULL, NULL FROM per
      UNION ALL SELECT 'spread', 1, 'prompts', count(*), NULL, quantile_cont(p90 - p10, 0.5) FROM per WHERE n >= 20
      UNION ALL SELECT 'category', row_number() OVER (ORDER BY n DESC, category), category, n, m, med FROM cat
      UNION ALL SELECT 'size', row_number() OVER (ORDER BY n DESC, width, height), width || 'x' || height, n, NULL, NULL FROM sz
      UNION ALL SELECT 'recipe', 1, 'width=' || width, one_width::BIGINT, NULL, NULL FROM f
      UNION ALL SELECT 'recipe', 2, 'model=' || model, one_model::BIGINT, NULL, NULL FROM f
      UNION ALL SELECT 'recipe', 3, 'seed=' || seed, one_seed::BIGINT, NULL, NULL FROM f
      UNION ALL SELECT 'files', 1, 'shards', CAST(ceil(count(*) / 500.0) AS BIGINT), NULL, sum(bytes) / pow(2, 30) FROM r
      UNION ALL SELECT 'removed', 1, 'no_sidecar', 0, NULL, NULL
      UNION ALL SELECT 'removed', 2, 'not_scored', 0, NULL, NULL
      UNION ALL SELECT 'removed', 3, 'nsfw', count(*) FILTER (class = 'nsfw'), NULL, 0.7 FROM c
      UNION ALL SELECT 'removed', 4, 'manual', count(*) FILTER (class = 'manual'), NULL, NULL FROM c)
    SELECT block, CAST(rank AS BIGINT) AS rank, label, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(value, 6) AS value FROM x""",
)
def dataset_card_facts(spark, sf):
    """All blocks of the card of a build that leaves out a manual list and what scores above a threshold."""
    rows = img(spark, sf).withColumn("prompt_id", F.col("user_id")).withColumn("seed", F.col("event_id"))
    scores = rows.select("id", F.col("score").alias("laion_aesthetic"), "nsfw_prob")
    # Report, manifest and card read both several times, so they are written once.
    classified = freeze(curate.exclusion_class(rows.select("id"), rows.select("id"), scores, rows.filter("k = 13").select("id"), 0.7))
    columns = ["id", "bytes", "category", "width", "height", "prompt_id", "score", "caption", "created_at", "pipeline_version", "model", "seed"]
    kept = freeze(rows.select(*columns).join(classified.filter("class = 'kept'").select("id"), "id"))
    manifest = ids.shard_assign(kept.select("id")).join(kept.select("id", "bytes"), "id").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    report = curate.build_report(classified, kept.select("prompt_id").distinct(), manifest, 0.7)
    facts = card.dataset_card(kept, report, F.col("pipeline_version") == 2, _CONSTANTS)
    return facts.withColumn("value", F.round("value", 6))
