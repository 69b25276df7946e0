"""Job planning, array scoring and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework import schema as S
from sievework.functions import draws, vectors
from sievework.operators import jobs, scoring
from sievework.plans.ingest import _ATTRIBUTION, _zlib_decoder, _zlib_encoder
from sievework.plans.registry import query, table
from sievework.plans.views import index
from sievework.session import work_path
from sievework.streaming import feeds

WEIGHTS = {"ECONOMY": 1.5, "LARGE": 0.5, "MEDIUM": 2.0, "PROMO": 1.0, "SMALL": 0.25, "STANDARD": 2.75}
SIZES = {"LARGE": (1344, 768), "SMALL": (832, 1216)}
SEED = 7

_BANK = """
bank0 AS (SELECT DISTINCT p_type AS category, p_name || ' ' || p_brand AS subject FROM part),
bank AS (
  SELECT category, subject, row_number() OVER (PARTITION BY category ORDER BY subject) - 1 AS position,
    count(*) OVER (PARTITION BY category) AS size FROM bank0
)"""


def _u(purpose: str, index: str = "index") -> str:
    return f"CAST('0x' || substr(md5('{SEED}:' || {index} || ':{purpose}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


_SPANS = ", ".join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in draws.cumulative_weights(WEIGHTS))
_DRAWN = _BANK + f""",
spans(category, low, high) AS (VALUES {_SPANS}),
u AS (SELECT o_orderkey AS index, ({_u('c', 'o_orderkey')}) * {sum(WEIGHTS.values())} AS at, {_u('s', 'o_orderkey')} AS u2 FROM orders),
drawn AS (
  SELECT u.index, s.category, b.subject FROM u JOIN spans s ON u.at >= s.low AND u.at < s.high
  JOIN bank b ON b.category = s.category AND b.position = CAST(floor(u.u2 * b.size) AS BIGINT)
)"""


def _bank(spark, sf) -> DataFrame:
    subjects = table(spark, sf, "part").select(
        F.col("p_type").alias("category"), F.concat_ws(" ", "p_name", "p_brand").alias("subject")
    )
    return jobs.prompt_bank(subjects)


def _drawn(spark, sf) -> DataFrame:
    indexes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"))
    return jobs.weighted_draw(indexes, _bank(spark, sf), WEIGHTS, SEED)


@query("index_source", "SELECT CAST(range AS BIGINT) AS index FROM range((SELECT count(*) FROM part))")
def index_source(spark, sf):
    return jobs.index_source(spark, table(spark, sf, "part").count())


@query("prompt_bank", f"WITH {_BANK} SELECT category, subject, position, size FROM bank")
def prompt_bank(spark, sf):
    return _bank(spark, sf)


@query("weighted_draw", f"WITH {_DRAWN} SELECT index, category, subject FROM drawn")
def weighted_draw(spark, sf):
    return _drawn(spark, sf).select("index", "category", "subject")


@query(
    "cumulative_weights",
    f"""WITH {_DRAWN} SELECT s.category, s.low, s.high, count(u.index) AS draws FROM spans s
    LEFT JOIN u ON u.at >= s.low AND u.at < s.high GROUP BY ALL""",
)
def cumulative_weights(spark, sf):
    spans = spark.createDataFrame(draws.cumulative_weights(WEIGHTS), "category string, low double, high double")
    counts = _drawn(spark, sf).groupBy("category").agg(F.count("*").alias("draws"))
    return spans.join(counts, "category", "left").withColumn("draws", F.coalesce("draws", F.lit(0)))


@query(
    "seed_schedule",
    f"""SELECT o_orderkey AS index, 1000 + o_orderkey AS fixed_seed,
    CAST('0x' || substr(md5('{SEED}:' || o_orderkey || ':seed'), 1, 8) AS BIGINT) % 2147483648 AS drawn_seed FROM orders""",
)
def seed_schedule(spark, sf):
    i = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        i.alias("index"),
        draws.seed_schedule(i, base=1000).alias("fixed_seed"),
        draws.seed_schedule(i, draw_seed=SEED).alias("drawn_seed"),
    )


_RECORDS = f"""
r AS (SELECT *, 'sdxl-refined' AS model, 1000 + index AS seed,
    CASE category WHEN 'LARGE' THEN 1344 WHEN 'SMALL' THEN 832 ELSE 1024 END AS width,
    CASE category WHEN 'LARGE' THEN 768 WHEN 'SMALL' THEN 1216 ELSE 1024 END AS height,
    lower(trim(regexp_replace(subject, '[^a-zA-Z0-9]+', '-', 'g'), '-')) AS slug FROM drawn)"""


def _planned(drawn: DataFrame) -> DataFrame:
    return jobs.plan_jobs(drawn, base_seed=1000, ts=F.lit("20260601-000000"), sizes=SIZES)


@query(
    "plan_jobs",
    f"""WITH {_DRAWN}, {_RECORDS} SELECT index, model, subject AS prompt_subject, subject || ', {S.PROMPT_SUFFIX}' AS prompt_full,
    '{S.NEGATIVE_PROMPT}' AS negative_prompt, category, seed, CAST(40 AS BIGINT) AS steps, CAST(15 AS BIGINT) AS refiner_steps,
    6.5::DOUBLE AS guidance_scale, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, 0.8::DOUBLE AS high_noise_frac,
    {_ATTRIBUTION}, CAST(2 AS BIGINT) AS pipeline_version,
    '20260601-000000_' || model || '_' || category || '_' || slug || '_s' || seed AS stem FROM r""",
)
def plan_jobs(spark, sf):
    rows = _planned(_drawn(spark, sf)).withColumn("freeu_b1", F.col("freeu.b1"))
    longs = ("steps", "refiner_steps", "width", "height", "pipeline_version")
    return rows.withColumns({c: F.col(c).cast("bigint") for c in longs}).drop("freeu", "extra", "elapsed_seconds")


@query(
    "custom_subject",
    """SELECT o_orderkey AS index, 'custom' AS category, 'A lone lighthouse' AS prompt_subject,
    '20260601-000000_sdxl-refined_custom_a-lone-lighthouse_s' || (1000 + o_orderkey) AS stem FROM orders""",
)
def custom_subject(spark, sf):
    indexes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("index"))
    rows = _planned(jobs.custom_subject(indexes, "A lone lighthouse"))
    return rows.select("index", "category", "prompt_subject", "stem")


@query(
    "validate_jobs",
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_size * 4 % 8 <> 0 THEN 'width' END, CASE WHEN p_size * 6 % 8 <> 0 THEN 'height' END,
    CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'category' END, CASE WHEN p_brand = 'Brand#7' THEN 'model' END) AS violations FROM part""",
)
def validate_jobs(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_size") * 4).alias("width"),
        (F.col("p_size") * 6).alias("height"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_brand") == "Brand#7", "other").otherwise("flux").alias("model"),
    )
    checked = jobs.validate_jobs(rows, ["ECONOMY", "MEDIUM", "SMALL", "STANDARD"])
    return checked.select("p_partkey", F.array_join("violations", ",").alias("violations"))


@query(
    "batch_variations",
    """SELECT p_partkey, p_name, CAST(v AS BIGINT) AS variation, 500 + p_partkey * 3 + v AS seed
    FROM part, (SELECT unnest(range(3)) AS v)""",
)
def batch_variations(spark, sf):
    rows = jobs.batch_variations(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 3, 500)
    return rows.withColumn("variation", F.col("variation").cast("bigint"))


# --- Arrays ----------------------------------------------------------------------------------------

# A head of two layers without activation, small whole numbers; it collapses to one affine map.
_LAYERS = [
    ([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(4)], [0.1, -0.2, 0.3, 0.0]),
    ([[1.0, -0.5, 0.25, 2.0]], [5.0]),
]
HEAD, BIAS = vectors.collapse_layers(_LAYERS)
_DOT = f"list_inner_product(embedding::DOUBLE[], {HEAD}::DOUBLE[]) + {BIAS}::DOUBLE"


@query(
    "l2_normalize",
    """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)
    SELECT vec_id, unnest(e) / norm AS v, generate_subscripts(e, 1) AS i FROM n""".replace(
        "unnest(e) / norm AS v", "round(unnest(e) / norm, 6) AS v"
    ),
)
def l2_normalize(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding"), 64).alias("e"))
    return rows.select("vec_id", F.posexplode("e").alias("i", "v")).select(
        "vec_id", F.round("v", 6).alias("v"), (F.col("i") + 1).cast("bigint").alias("i")
    )


@query("linear_head", f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings")
def linear_head(spark, sf):
    score = vectors.linear_head(F.col("embedding"), HEAD, BIAS)
    return table(spark, sf, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


@query(
    "softmax_prob",
    """WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: exp(v)) AS p FROM embeddings)
    SELECT vec_id, round(p[2] / list_sum(p), 6) AS prob FROM x""",
)
def softmax_prob(spark, sf):
    labels = [f"label-{i}" for i in range(64)]
    prob = vectors.softmax_prob(F.col("embedding"), labels, "label-1")
    return table(spark, sf, "embeddings").select("vec_id", F.round(prob, 6).alias("prob"))


def _embedding_payloads(df: DataFrame) -> DataFrame:
    """Payload bytes that hold an embedding as text; those of label 3 cannot be read."""
    written = F.encode(F.array_join(F.col("embedding").cast("array<double>"), ","), "UTF-8")
    broken = F.encode(F.lit("?"), "UTF-8")
    return df.select(
        F.col("vec_id").cast("string").alias("id"),
        F.when(F.col("label") == 3, broken).otherwise(written).alias("content"),
    )


def _make_scorer() -> scoring.Scorer:
    import numpy as np

    head = np.asarray(HEAD)

    def score(batch: list[bytes]) -> list[tuple[float, float] | None]:
        out: list[tuple[float, float] | None] = []
        for data in batch:
            try:
                vector = np.array(data.decode().split(","), dtype="float64")
            except ValueError:
                out.append(None)
                continue
            aesthetic = float(vector @ head) + BIAS
            out.append((aesthetic, 1 / (1 + float(np.exp(-vector[0])))))
        return out

    return score


_SCORED = f"""SELECT vec_id::VARCHAR AS id, CASE WHEN label <> 3 THEN round_even({_DOT}, 4) END AS laion_aesthetic,
    CASE WHEN label <> 3 THEN round_even(1 / (1 + exp(-embedding[1]::DOUBLE)), 5) END AS nsfw_prob, label <> 3 AS readable FROM embeddings"""


@query("batch_score", _SCORED)
def batch_score(spark, sf):
    return scoring.batch_score(_embedding_payloads(table(spark, sf, "embeddings")), _make_scorer)


@query(
    "score_rounding",
    f"""SELECT vec_id, round_even({_DOT}, 4) AS laion_aesthetic, round_even(1 / (1 + exp(-embedding[1]::DOUBLE)), 5) AS nsfw_prob
    FROM embeddings""",
)
def score_rounding(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        vectors.round_score(vectors.linear_head(e, HEAD, BIAS), 4).alias("laion_aesthetic"),
        vectors.round_score(1 / (1 + F.exp(-F.element_at(e, 1))), 5).alias("nsfw_prob"),
    )


@query(
    "payload_transform",
    """SELECT page_id::VARCHAR AS id, page_id || '.zlib' AS path, CAST(strlen(html) AS BIGINT) AS bytes_in,
    true AS lossless, true AS smaller FROM pages WHERE html IS NOT NULL""",
)
def payload_transform(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("content")
    )
    out = scoring.payload_transform(pages, _zlib_encoder, _zlib_decoder, ".zlib")
    return out.select(
        "id", F.col("image.path").alias("path"), "bytes_in", "lossless",
        (F.col("bytes_out") < F.col("bytes_in")).alias("smaller"),
    )


# --- Streams ---------------------------------------------------------------------------------------


def _stream(spark, sf, name: str) -> DataFrame:
    # A glob of one alternative: a stream's path may be a file only as a glob, and a folder of parts fits it as well.
    return feeds.record_stream(spark, f"{sf}/{{{name}}}.parquet", table(spark, sf, name).schema, pattern="*")


def _feed_columns(events: DataFrame) -> DataFrame:
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return events.select(
        F.concat(F.lit("e"), F.col("event_id")).alias("name"),
        F.col("event_type").alias("cat"),
        (F.timestamp_diff("MICROSECOND", epoch, F.col("ts")) / 1000000).alias("mtime"),
    )


def _micros(df: DataFrame) -> DataFrame:
    return df.select("name", "cat", F.round(F.col("mtime") * 1000000).cast("bigint").alias("mtime_us"))


def _finished(query) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


@query("stream_feed", "SELECT 'e' || event_id AS name, event_type AS cat, epoch_us(ts) AS mtime_us FROM events")
def stream_feed(spark, sf):
    sink = work_path(spark, "feed")
    records = _feed_columns(_stream(spark, sf, "events"))
    _finished(feeds.stream_feed(records, sink, work_path(spark, "feed-log"), poll_seconds=None))
    return _micros(spark.read.parquet(sink))


@query(
    "stream_high_water",
    """WITH e AS (SELECT event_id, event_type, ts, ts < TIMESTAMP '2024-01-20 00:00:00'
        AND NOT (event_type = 'view' AND ts < TIMESTAMP '2024-01-10 00:00:00') AS early FROM events)
    SELECT 'e' || event_id AS name, event_type AS cat, epoch_us(ts) AS mtime_us FROM e
    WHERE early OR ts > (SELECT max(ts) FROM e WHERE early)""",
)
def stream_high_water(spark, sf):
    """Three slices: the second holds later rows and late ones, which are never delivered, as does the third."""
    source, sink, log = (work_path(spark, n) for n in ("slices", "water", "water-log"))
    events = table(spark, sf, "events")

    def at(text: str):
        return F.to_timestamp_ntz(F.lit(text))

    early = (F.col("ts") < at("2024-01-20 00:00:00")) & ~(
        (F.col("event_type") == "view") & (F.col("ts") < at("2024-01-10 00:00:00"))
    )
    for part in (events.filter(early), events.filter(~early), events.filter(early)):
        _feed_columns(part).write.mode("append").parquet(source)
        records = feeds.record_stream(spark, source, _feed_columns(events).schema)
        _finished(feeds.stream_high_water(records, sink, log, poll_seconds=None))
    return _micros(spark.read.parquet(sink))


# The rows of the first slice, and the mark of each feed after it.
_EARLY = """e AS (SELECT event_id, event_type, ts, ts < TIMESTAMP '2024-01-20 00:00:00'
    AND NOT (event_type = 'view' AND ts < TIMESTAMP '2024-01-10 00:00:00') AS early FROM events),
m AS (SELECT event_type, max(ts) AS mark FROM e WHERE early GROUP BY event_type)"""


def _slices(spark, sf):
    """The events in three slices: the second holds later rows and late ones, the third repeats the first."""
    events = table(spark, sf, "events")
    day = lambda text: F.to_timestamp_ntz(F.lit(text))
    early = (F.col("ts") < day("2024-01-20 00:00:00")) & ~((F.col("event_type") == "view") & (F.col("ts") < day("2024-01-10 00:00:00")))
    return [_feed_columns(part) for part in (events.filter(early), events.filter(~early), events.filter(early))]


def _marked(spark, sf, strict: bool) -> DataFrame:
    """The slices one after the other, each by a new query that goes on where the one before has stopped."""
    source, sink, log = (work_path(spark, n) for n in ("feed-slices", "feeds", "feeds-log"))
    for part in _slices(spark, sf):
        part.write.mode("append").parquet(source)
        records = feeds.record_stream(spark, source, part.schema)
        _finished(feeds.stream_high_water(records, sink, log, poll_seconds=None, feed="cat", strict=strict))
    return spark.read.parquet(sink)


@query(
    "stream_high_water_feeds",
    f"""WITH {_EARLY} SELECT 'e' || event_id AS name, e.event_type AS cat, epoch_us(ts) AS mtime_us
    FROM e LEFT JOIN m USING (event_type) WHERE early OR mark IS NULL OR ts > mark""",
)
def stream_high_water_feeds(spark, sf):
    """Each event type is a feed with a mark of its own; late rows are never delivered."""
    return _micros(_marked(spark, sf, strict=True))


@query(
    "stream_late_feeds",
    f"""WITH {_EARLY}, d AS (
      SELECT event_id, event_type, ts, NOT early AND coalesce(ts <= mark, FALSE) AS late FROM e LEFT JOIN m USING (event_type)
      UNION ALL SELECT event_id, event_type, ts, TRUE FROM e WHERE early)
    SELECT 'e' || event_id AS name, event_type AS cat, epoch_us(ts) AS mtime_us, late FROM d""",
)
def stream_late_feeds(spark, sf):
    """The same, with late rows delivered and marked as such."""
    rows = _marked(spark, sf, strict=False)
    return rows.select("name", "cat", F.round(F.col("mtime") * 1000000).cast("bigint").alias("mtime_us"), "late")


@query("stream_totals", "SELECT event_type AS cat, count(*) AS n FROM events GROUP BY event_type")
def stream_totals(spark, sf):
    """Three slices, each of which the totals are brought up to."""
    source, sink, log = (work_path(spark, n) for n in ("totals-in", "totals", "totals-log"))
    events = table(spark, sf, "events")
    for part in range(3):
        _feed_columns(events.filter(F.col("event_id") % 3 == part)).write.mode("append").parquet(source)
        records = feeds.record_stream(spark, source, _feed_columns(events).schema)
        _finished(feeds.stream_totals(records, ["cat"], sink, log, poll_seconds=None))
    return feeds.totals_of(spark, sink)


@query("stream_score", _SCORED)
def stream_score(spark, sf):
    sink = work_path(spark, "scored")
    records = _embedding_payloads(_stream(spark, sf, "embeddings"))
    _finished(
        feeds.score_new(
            records, lambda df: scoring.batch_score(df, _make_scorer), sink, work_path(spark, "scored-log"),
            poll_seconds=None,
        )
    )
    return spark.read.parquet(sink).drop("batch")


@query(
    "stream_jobs",
    f"""WITH {_DRAWN}, {_RECORDS} SELECT index, category, subject AS prompt_subject, seed, CAST(width AS BIGINT) AS width,
    '20260601-000000_' || model || '_' || category || '_' || slug || '_s' || seed AS stem FROM r""",
)
def stream_jobs(spark, sf):
    sink, bank = work_path(spark, "jobs"), _bank(spark, sf)
    records = _stream(spark, sf, "orders").select(F.col("o_orderkey").alias("index"))
    plan = lambda df: _planned(jobs.weighted_draw(df, bank, WEIGHTS, SEED))
    _finished(feeds.stream_append(records, plan, sink, work_path(spark, "jobs-log"), poll_seconds=None))
    return spark.read.parquet(sink).select(
        "index", "category", "prompt_subject", "seed", F.col("width").cast("bigint").alias("width"), "stem"
    )


def _until(running, done) -> None:
    """Waits until `done()` holds, then stops the query."""
    try:
        while not done():
            if running.exception() is not None:
                raise running.exception()
            running.awaitTermination(0.1)
    finally:
        running.stop()


@query(
    "stream_jobs_endless",
    f"""WITH {_DRAWN.replace("FROM orders)", "FROM (SELECT range AS o_orderkey FROM range((SELECT count(*) FROM orders))))")}, {_RECORDS}
    SELECT index, category, subject AS prompt_subject, seed, CAST(width AS BIGINT) AS width,
    '20260601-000000_' || model || '_' || category || '_' || slug || '_s' || seed AS stem FROM r""",
)
def stream_jobs_endless(spark, sf):
    """As many indexes as there are orders, from a source without end: stopped in the middle, then gone on with."""
    sink, log, bank = work_path(spark, "endless"), work_path(spark, "endless-log"), _bank(spark, sf)
    total = table(spark, sf, "orders").count()
    plan = lambda df: _planned(jobs.weighted_draw(df, bank, WEIGHTS, SEED))

    def start(end: int | None):
        indexes = jobs.index_source(spark, end=end, per_trigger=total // 6 + 1)
        return feeds.stream_append(indexes, plan, sink, log, poll_seconds=0)

    first = start(None)
    _until(first, lambda: sum(p["numInputRows"] for p in first.recentProgress) > 0)
    second = start(total)
    try:
        second.processAllAvailable()
    finally:
        second.stop()
    return spark.read.parquet(sink).filter(F.col("index") < total).select(
        "index", "category", "prompt_subject", "seed", F.col("width").cast("bigint").alias("width"), "stem"
    )
