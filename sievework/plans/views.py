"""Views that give the driver tables the shape of the engine's inputs.

Each exists twice with the same definition: as a Spark plan and as a SQL common table expression.
They keep every row and every text whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievework.functions.frontmatter import front_matter_write
from sievework.functions.names import build_artifact_name, slugify
from sievework.functions.text import lines_of
from sievework.operators.records import RecordRules, ReportLayout
from sievework.plans.registry import table
from sievework.schema import MODELS

# --- Artifacts, from events -------------------------------------------------------------------

IMG_CATEGORIES = ["click", "click_alt", "error", "purchase", "view"]
IMG_SIZES = {"error": (1152, 896), "purchase": (832, 1216), "view": (1344, 768)}

IMG = """
img0 AS (
  SELECT event_id, user_id, ts, value AS score,
    strftime(ts, '%Y%m%d-%H%M%S') AS ts_name,
    CASE WHEN event_type = 'signup' THEN 'click_alt' ELSE event_type END AS category,
    CASE event_id % 4 WHEN 0 THEN 'flux' WHEN 1 THEN 'juggernaut' WHEN 2 THEN 'sdxl-base'
      ELSE 'sdxl-refined' END AS model,
    'Subject #' || user_id || '!' AS prompt_subject,
    'subject-' || user_id AS slug,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CASE WHEN ts < TIMESTAMP '2024-01-08 00:00:00' THEN 1 ELSE 2 END AS pipeline_version,
    512 + (event_id * 37) % 4096 AS bytes,
    epoch_us(ts) AS mtime_us
  FROM events
),
img AS (
  SELECT *, k / 100.0::DOUBLE AS nsfw_prob,
    CASE WHEN k >= 90 THEN 'cap ' || k END AS caption,
    CASE category WHEN 'error' THEN 1152 WHEN 'purchase' THEN 832 WHEN 'view' THEN 1344 ELSE 1024 END AS width,
    CASE category WHEN 'error' THEN 896 WHEN 'purchase' THEN 1216 WHEN 'view' THEN 768 ELSE 1024 END AS height,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at,
    mtime_us / 1000000.0::DOUBLE AS mtime,
    ts_name || '_' || model || '_' || category || '_' || slug || '_s' || event_id AS id,
    ts_name || '_' || category || '_' || slug || '_s' || event_id AS old_id
  FROM img0
)"""


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("event_type") == "signup", "click_alt").otherwise(F.col("event_type"))
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("event_id") % 4 + 1).cast("int"))
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    base = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.col("value").alias("score"),
        F.date_format("ts", "yyyyMMdd-HHmmss").alias("ts_name"),
        category.alias("category"),
        model.alias("model"),
        F.concat(F.lit("Subject #"), F.col("user_id"), F.lit("!")).alias("prompt_subject"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        F.when(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-08 00:00:00")), 1).otherwise(2).alias("pipeline_version"),
        (F.col("event_id") * 37 % 4096 + 512).alias("bytes"),
        F.timestamp_diff("MICROSECOND", epoch, F.col("ts")).alias("mtime_us"),
    )
    width = F.lit(1024)
    height = F.lit(1024)
    for name, (w, h) in IMG_SIZES.items():
        width = F.when(F.col("category") == name, w).otherwise(width)
        height = F.when(F.col("category") == name, h).otherwise(height)
    slug = slugify(F.col("prompt_subject"))
    old = F.concat_ws("_", "ts_name", "category", slug, F.concat(F.lit("s"), F.col("event_id")))
    return base.withColumns(
        {
            "slug": slug,
            "nsfw_prob": F.col("k") / F.lit(100.0),
            "caption": F.when(F.col("k") >= 90, F.concat(F.lit("cap "), F.col("k"))),
            "width": width,
            "height": height,
            "created_at": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
            "mtime": F.col("mtime_us") / F.lit(1000000.0),
            "id": build_artifact_name(
                F.col("ts_name"), F.col("model"), F.col("category"), slug, F.col("event_id")
            ),
            "old_id": old,
        }
    )


def sidecar_raw() -> Column:
    """Sidecar text of an artifact. Version 1 has no attribution keys; captions sit in `extra`.

    A version-2 sidecar with k below 10 holds its attribution as explicit nulls.
    """
    freeu = F.struct(F.lit(1.3).alias("b1"), F.lit(1.4).alias("b2"), F.lit(0.9).alias("s1"), F.lit(0.2).alias("s2"))
    plain = [
        F.col("model"),
        F.col("prompt_subject"),
        F.concat("prompt_subject", F.lit(", sharp")).alias("prompt_full"),
        F.lit("blurry").alias("negative_prompt"),
        F.col("category"),
        F.col("event_id").alias("seed"),
        F.lit(40).alias("steps"),
        F.lit(15).alias("refiner_steps"),
        F.lit(6.5).alias("guidance_scale"),
        F.col("width"),
        F.col("height"),
        F.lit(0.8).alias("high_noise_frac"),
        (F.col("k") / 4).alias("elapsed_seconds"),
        F.when(
            F.col("caption").isNotNull(),
            F.struct(
                F.struct(
                    F.col("caption").alias("top_text"), F.lit(None).cast("string").alias("bottom_text"),
                    F.lit("classic").alias("format"),
                ).alias("meme")
            ),
        ).alias("extra"),
    ]
    hidden = F.col("k") < 10

    def kept(value: Column, name: str) -> Column:
        return F.when(~hidden, value).alias(name)

    full = [
        kept(F.lit("repo-x"), "model_repo"), kept(F.lit("vae-x"), "vae"), kept(F.lit("sched-x"), "scheduler"),
        kept(freeu, "freeu"), kept(F.lit(6.0), "aesthetic_score"), kept(F.lit(2.5), "negative_aesthetic_score"),
        F.col("pipeline_version"),
    ]
    nulls = {"ignoreNullFields": "false"}
    return F.when(F.col("pipeline_version") == 1, F.to_json(F.struct(*plain), nulls)).otherwise(
        F.to_json(F.struct(*plain, *full), nulls)
    )


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return img(spark, sf_dir).select("id", "event_id", sidecar_raw().alias("raw"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index records of the artifacts."""
    return img(spark, sf_dir).select(
        F.concat("id", F.lit(".png")).alias("name"), F.col("category").alias("cat"),
        F.col("prompt_subject").alias("subj"), "mtime", "mtime_us",
    )


IDX = IMG + """,
idx AS (SELECT id || '.png' AS name, category AS cat, prompt_subject AS subj, mtime, mtime_us FROM img)"""

# --- Payloads with labels, from documents and labels --------------------------------------------

DOC = """
doc AS (
  SELECT d.doc_id AS id, source || ' ' || lang AS prompt_subject, n_chars,
    NOT (lang = 'de' AND n_chars > 4000) AS has_sidecar,
    (source = 'src7' AND lang = 'en') AS is_manual,
    l.toxic::DOUBLE AS nsfw_prob, l.quality::DOUBLE AS quality, l.doc_id IS NOT NULL AS scored
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
doc_class AS (
  SELECT *, CASE WHEN NOT has_sidecar THEN 'no_sidecar' WHEN is_manual THEN 'manual'
    WHEN NOT scored THEN 'not_scored' WHEN nsfw_prob >= 0.5 THEN 'nsfw' ELSE 'kept' END AS class
  FROM doc
)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "lang").alias("prompt_subject"),
        "source", "lang", "n_chars",
    )


def doc_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).filter(~((F.col("lang") == "de") & (F.col("n_chars") > 4000)))


def doc_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).filter((F.col("source") == "src7") & (F.col("lang") == "en")).select("id")


def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("double").alias("laion_aesthetic"),
        F.col("toxic").cast("double").alias("nsfw_prob"),
    )


# --- Records, from orders -------------------------------------------------------------------------

RULES = RecordRules(
    sections=(
        ("now", "Now"), ("waiting", "Waiting"), ("scheduled", "Scheduled"), ("next", "Next"), ("idea", "Ideas"),
        ("known-failure", "Known failures"),
    ),
    areas=("data", "docs", "cli", "ci", "models", "service", "gallery", "process"),
    owners=("owner", "agent"),
    root="records",
    layout=ReportLayout(
        parts=(
            "concat('* ', path, ': ', title)", "brief", "concat('by ', due)", "concat('in ', area)",
            "if(status = 'known-failure', concat('see test ', test), NULL)", "if(owner = 'owner' AND status <> 'waiting', 'for the owner', NULL)",
        ),
        separator=" | ", heading="%s:", empty="* nothing", counts="%d to do, %d finished",
    ),
)

TASK = """
task0 AS (
  SELECT *, o_orderdate::DATE::VARCHAR AS day,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN o_orderkey - 1
      ELSE o_orderkey END AS slug_key,
    CASE o_orderpriority WHEN '5-LOW' THEN 'docs' WHEN '2-HIGH' THEN 'data' WHEN '1-URGENT' THEN 'service'
      WHEN '3-MEDIUM' THEN 'cli' ELSE 'not specified' END AS area,
    CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'next'
      WHEN o_totalprice < 20000 THEN 'pending' WHEN o_totalprice > 300000 THEN 'scheduled'
      WHEN o_orderpriority = '5-LOW' THEN 'waiting' WHEN o_orderpriority = '2-HIGH' THEN 'known-failure'
      ELSE 'idea' END AS status
  FROM orders
),
task AS (
  SELECT 'order-' || slug_key AS slug, status, area,
    'Order "' || o_custkey || '": ' || o_orderpriority AS title,
    CASE WHEN o_totalprice > 450000 THEN '2026-02-30' WHEN o_totalprice > 200000 AND o_custkey % 5 > 0 THEN day END AS due,
    day AS updated,
    CASE WHEN o_custkey % 2 = 0 THEN 'owner' ELSE 'agent' END AS owner,
    'total ' || CAST(floor(o_totalprice) AS BIGINT) AS brief,
    CASE WHEN o_totalprice > 250000 THEN 'cust-' || o_custkey || ';a,b' END AS refs_text,
    CASE WHEN status = 'known-failure' AND o_totalprice > 100000 THEN 'suite > case ' || o_custkey END AS test,
    CASE WHEN o_totalprice < 5000 THEN '' ELSE '- order ' || o_orderkey || chr(10) END AS body,
    'records/' || CASE WHEN status = 'done' AND o_orderpriority <> '2-HIGH' THEN 'done/' ELSE '' END
      || area || '/order-' || slug_key || '.md' AS path
  FROM task0
)"""


def tasks(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Record fields with their path, slug and body.

    With `spread` the rows are dealt out by key, for work that costs far more a row than moving
    these few columns: the table's files may have fewer row groups than the cluster has cores.
    """
    price, priority, state = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    area = (
        F.when(priority == "5-LOW", "docs").when(priority == "2-HIGH", "data")
        .when(priority == "1-URGENT", "service").when(priority == "3-MEDIUM", "cli").otherwise("not specified")
    )
    status = (
        F.when(state == "F", "done").when(state == "O", "next").when(price < 20000, "pending")
        .when(price > 300000, "scheduled").when(priority == "5-LOW", "waiting")
        .when(priority == "2-HIGH", "known-failure").otherwise("idea")
    )
    shifted = (state == "F") & (priority == "4-NOT SPECIFIED")
    key = F.when(shifted, F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    slug = F.concat(F.lit("order-"), key)
    folder = F.when((status == "done") & (priority != "2-HIGH"), "records/done/").otherwise("records/")
    orders = table(spark, sf_dir, "orders")
    return (orders.repartition("o_orderkey") if spread else orders).select(
        F.concat(folder, area, F.lit("/"), slug, F.lit(".md")).alias("path"),
        slug.alias("slug"),
        F.concat(F.lit('Order "'), F.col("o_custkey"), F.lit('": '), priority).alias("title"),
        status.alias("status"),
        area.alias("area"),
        F.when(price > 450000, "2026-02-30").when((price > 200000) & (F.col("o_custkey") % 5 > 0), day).alias("due"),
        day.alias("updated"),
        F.when(F.col("o_custkey") % 2 == 0, "owner").otherwise("agent").alias("owner"),
        F.concat(F.lit("total "), F.floor(price).cast("bigint")).alias("brief"),
        F.when(price > 250000, F.array(F.concat(F.lit("cust-"), F.col("o_custkey")), F.lit("a,b"))).alias("refs"),
        F.when(
            (status == "known-failure") & (price > 100000), F.concat(F.lit("suite > case "), F.col("o_custkey"))
        ).alias("test"),
        F.when(price < 5000, "").otherwise(F.concat(F.lit("- order "), F.col("o_orderkey"), F.lit("\n"))).alias("body"),
    )


def task_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as text cells: front matter and body."""
    rows = tasks(spark, sf_dir, spread=True)
    fields = {
        k: F.col(k)
        for k in ("title", "status", "area", "due", "updated", "owner", "brief", "refs", "test")
    }
    text = F.concat(front_matter_write(fields), F.col("body"))
    return rows.select("path", "slug", text.alias("text"))


# --- Sections, from documents: every line whose length divides by four becomes a heading ----------

LINES = """
cells AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, source, lang, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS total FROM cells
)"""

_TRIM = r"'^[\s\x0B\p{Z}\x{FEFF}]+|[\s\x0B\p{Z}\x{FEFF}]+$', '', 'g'"

TRIMMED = LINES + f""",
trimmed AS (
  SELECT * FROM (SELECT doc_id, source, lang, n, regexp_replace(line, {_TRIM}) AS line FROM lines) WHERE line <> ''
)"""

SEC = LINES + """,
marked AS (
  SELECT doc_id, n, CASE WHEN length(line) % 4 = 0 AND line <> '' THEN '## ' || line ELSE line END AS line, total FROM lines
),
kept AS (SELECT * FROM marked WHERE NOT (n = total AND line = '')),
numbered AS (
  SELECT *, CAST(sum(CASE WHEN n = 1 OR line LIKE '## %' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS BIGINT) AS idx
  FROM kept
),
sec AS (
  SELECT doc_id, idx, printf('S%03d', idx) AS section_id, min(n) AS start_line, count(*) AS line_count,
    string_agg(line, chr(10) ORDER BY n) AS joined,
    CASE WHEN arg_min(line, n) LIKE '## %' THEN arg_min(line, n) END AS heading
  FROM numbered GROUP BY doc_id, idx
)"""


def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.transform(
        lines_of(F.col("text")),
        lambda line: F.when((F.length(line) % 4 == 0) & (line != ""), F.concat(F.lit("## "), line)).otherwise(line),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(marked, "\n").alias("text"))
