"""Names, recipes, sidecars, payloads and the build, on artifacts made of events and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework import schema as S
from sievework.functions import names, recipe, text
from sievework.operators import curate, ids, publish as job, scoring
from sievework.plans.registry import query, table
from sievework.plans.views import (
    DOC,
    IMG,
    IMG_CATEGORIES,
    IMG_SIZES,
    doc_manual,
    doc_scores,
    doc_sidecars,
    docs,
    img,
    sidecar_raw,
    sidecars,
)
from sievework.session import freeze, work_path
from sievework.sources import files, readers, writers

# --- Scans ----------------------------------------------------------------------------------------


@query(
    "scan_sidecars",
    f"""WITH {IMG} SELECT event_id, score < 1 AS broken,
    CASE WHEN score >= 1 THEN category END AS category, CASE WHEN score >= 1 THEN prompt_subject END AS prompt_subject,
    CASE WHEN score >= 1 THEN CAST(width AS BIGINT) END AS width, CASE WHEN score >= 1 THEN event_id END AS seed,
    CASE WHEN score >= 1 AND pipeline_version = 2 AND k >= 10 THEN 1.3::DOUBLE END AS freeu_b1 FROM img""",
)
def scan_sidecars(spark, sf):
    raw = F.when(F.col("score") < 1, F.concat(F.lit("{"), sidecar_raw())).otherwise(sidecar_raw())
    parsed = readers.parse_sidecars(img(spark, sf).select("event_id", raw.alias("raw")), policy="skip")
    return parsed.select(
        "event_id", "broken", "meta.category", "meta.prompt_subject",
        F.col("meta.width").cast("bigint").alias("width"), "meta.seed", F.col("meta.freeu.b1").alias("freeu_b1"),
    )


@query(
    "open_extra",
    """WITH p AS (SELECT page_id, page_id::VARCHAR AS stem, page_id % 17 = 3 AS broken, url, CAST(length(html) AS BIGINT) AS size FROM pages),
    v AS (SELECT *, CASE WHEN NOT broken THEN page_id END AS seed, CASE WHEN NOT broken THEN size END AS note_size,
      CASE WHEN NOT broken AND page_id % 5 = 0 THEN '["' || url || '",' || page_id || ',null]' END AS tags FROM p)
    SELECT 'default' AS policy, stem, seed, note_size, tags FROM v
    UNION ALL SELECT 'skip', stem, seed, note_size, tags FROM v WHERE NOT broken
    UNION ALL SELECT 'fail', stem, seed, note_size, tags FROM v WHERE NOT broken""",
)
def open_extra(spark, sf):
    """Sidecar files whose open map holds keys that no schema knows, some of them broken.

    Read with each policy; what `skip` keeps goes through metadata and new sidecar files, which
    `fail` reads.
    """
    first, metadata, second = (work_path(spark, n) for n in ("extra-in", "extra-metadata", "extra-out"))
    pages = table(spark, sf, "pages").withColumn("stem", F.col("page_id").cast("string"))
    note = F.struct(F.length("html").alias("size"))
    tags = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit('["'), "url", F.lit('",'), "page_id", F.lit(",null]")))
    rest = F.coalesce(F.concat(F.lit(',"tags":'), tags), F.lit(""))
    raw = F.concat(F.lit('{"seed":'), "page_id", F.lit(',"prompt_subject":"p","extra":{"note":'), F.to_json(note), rest, F.lit("}"), F.when(F.col("page_id") % 17 != 3, "}").otherwise(""))
    files.write_files(pages.select(F.concat("stem", F.lit(".json")).alias("name"), raw.alias("raw")), first, "name", "raw").write.format("noop").mode("overwrite").save()
    # The files are opened once for all policies; opening them is what a scan of small files costs.
    texts = freeze(readers.scan_sidecar_text(spark, first))
    kept = readers.parse_sidecars(texts, policy="skip").filter("NOT broken")
    flat = curate.flatten_recipe(
        kept.withColumnRenamed("stem", "id").withColumns({"prompt_id": F.lit(0), "laion_aesthetic": F.lit(None), "nsfw_prob": F.lit(None)}), keep_extra=True
    )
    writers.write_metadata(flat, metadata)
    writers.write_sidecars(spark.read.parquet(metadata), second, "id", ["seed", "prompt_subject", "extra"])
    scans = {"default": readers.parse_sidecars(texts), "skip": kept, "fail": readers.scan_sidecars(spark, second, "fail")}
    shown = [
        df.select(
            F.lit(policy).alias("policy"), "stem", "meta.seed", F.try_variant_get("meta.extra", "$.note.size", "bigint").alias("note_size"),
            F.to_json(F.try_variant_get("meta.extra", "$.tags", "variant")).alias("tags"),
        )
        for policy, df in scans.items()
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


def _page_files(spark, sf, folder: str) -> None:
    """Writes every page to a file of its own."""
    pages = table(spark, sf, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".png")).alias("name"), "html"
    )
    files.write_files(pages, folder, "name", "html").write.format("noop").mode("overwrite").save()


@query(
    "scan_payloads",
    "SELECT page_id::VARCHAR AS stem, page_id || '.png' AS name, CAST(strlen(html) AS BIGINT) AS length FROM pages",
)
def scan_payloads(spark, sf):
    folder = work_path(spark, "payloads")
    _page_files(spark, sf, folder)
    return readers.scan_payloads(spark, folder).select("stem", "name", "length")


@query(
    "payload_probe",
    """SELECT page_id, url NOT LIKE '%?%' AS readable,
    CASE WHEN url NOT LIKE '%?%' THEN CAST(length(url) * 8 AS BIGINT) END AS width,
    CASE WHEN url NOT LIKE '%?%' THEN page_id END AS height FROM pages""",
)
def payload_probe(spark, sf):
    def four(c):
        return F.unhex(F.lpad(F.hex(c.cast("bigint")), 8, "0"))

    head = F.concat(
        F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), four(F.length("url") * 8), four(F.col("page_id")),
        F.unhex(F.lit("0806000000")), F.encode("html", "UTF-8"),
    )
    content = F.when(F.contains("url", F.lit("?")), F.encode("html", "UTF-8")).otherwise(head)
    pages = table(spark, sf, "pages").select("page_id", content.alias("content"))
    return readers.payload_probe(pages).select("page_id", "readable", "width", "height")


@query(
    "scan_scores",
    "SELECT doc_id::VARCHAR AS id, quality::DOUBLE AS laion_aesthetic, toxic::DOUBLE AS nsfw_prob FROM labels",
)
def scan_scores(spark, sf):
    path = work_path(spark, "scores")
    none_yet = readers.scan_scores(spark, path, resume=True)
    scores = doc_scores(spark, sf).withColumn("id", F.col("id").cast("string"))
    curate.resume_work(scores, none_yet, "id").write.parquet(path)
    return readers.scan_scores(spark, path)


@query(
    "scan_id_list",
    r"""SELECT DISTINCT id FROM (SELECT unnest(regexp_split_to_array(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+')) AS id
    FROM documents) WHERE id <> ''""",
)
def scan_id_list(spark, sf):
    return readers.ids_of(table(spark, sf, "documents"), "text")


# --- Names and recipe ------------------------------------------------------------------------------

_STEMS = IMG + """,
stems AS (
  SELECT event_id, ts_name, category, slug, model, k,
    CASE WHEN k < 5 THEN 'IMG_' || event_id WHEN k < 30 THEN id
      WHEN k < 40 THEN replace(old_id, '_s' || event_id, '_s00' || event_id) ELSE old_id END AS stem,
    k >= 30 AS is_old, k >= 5 AND k < 30 AS is_new
  FROM img
)"""


def _stems(spark, sf) -> DataFrame:
    padded = F.replace(
        "old_id", F.concat(F.lit("_s"), "event_id"), F.concat(F.lit("_s00"), "event_id")
    )
    stem = (
        F.when(F.col("k") < 5, F.concat(F.lit("IMG_"), "event_id"))
        .when(F.col("k") < 30, F.col("id"))
        .when(F.col("k") < 40, padded)
        .otherwise(F.col("old_id"))
    )
    return img(spark, sf).withColumn("stem", stem)


@query(
    "parse_artifact_name",
    f"""WITH {_STEMS} SELECT event_id, CASE WHEN is_old THEN ts_name END AS ts,
    CASE WHEN is_old THEN category END AS category, CASE WHEN is_old THEN slug END AS slug,
    CASE WHEN is_old THEN event_id END AS seed FROM stems""",
)
def parse_artifact_name(spark, sf):
    parsed = names.parse_artifact_name(F.col("stem"), IMG_CATEGORIES)
    rows = _stems(spark, sf).select("event_id", parsed.alias("p"))
    return rows.select("event_id", "p.ts", "p.category", "p.slug", "p.seed")


@query("is_new_format", f"WITH {_STEMS} SELECT event_id, is_new FROM stems")
def is_new_format(spark, sf):
    return _stems(spark, sf).select("event_id", names.is_new_format(F.col("stem")).alias("is_new"))


@query(
    "build_artifact_name",
    f"""WITH {IMG} SELECT event_id, ts_name || '_' || model || '_' ||
    CASE WHEN category = 'error' THEN 'custom' ELSE category END || '_' || slug || '_s' || event_id AS stem FROM img""",
)
def build_artifact_name(spark, sf):
    given = F.when(F.col("category") != "error", F.col("category"))
    stem = names.build_artifact_name(F.col("ts_name"), F.col("model"), given, F.col("slug"), F.col("event_id"))
    return img(spark, sf).select("event_id", stem.alias("stem"))


@query(
    "slugify",
    """SELECT doc_id, coalesce(nullif(substr(lower(trim(regexp_replace(text, '[^a-zA-Z0-9]+', '-', 'g'), '-')), 1, 50), ''), 'image') AS slug
    FROM documents""",
)
def slugify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.slugify(F.col("text")).alias("slug"))


@query(
    "decorate_prompt",
    f"""SELECT p_partkey, p_name || ', {S.PROMPT_SUFFIX}' AS prompt, '{S.NEGATIVE_PROMPT}' AS negative_prompt FROM part""",
)
def decorate_prompt(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        recipe.decorate_prompt(F.col("p_name")).alias("prompt"),
        F.lit(S.NEGATIVE_PROMPT).alias("negative_prompt"),
    )


_ATTRIBUTION = f"""
    CASE WHEN model <> 'flux' THEN '{S.VAE}' ELSE 'default' END AS vae,
    CASE WHEN model <> 'flux' THEN '{S.SCHEDULER}' ELSE 'default' END AS scheduler,
    CASE WHEN model <> 'flux' THEN 1.3::DOUBLE END AS freeu_b1,
    CASE WHEN model = 'sdxl-refined' THEN 6.0::DOUBLE END AS aesthetic_score,
    CASE WHEN model = 'sdxl-refined' THEN 2.5::DOUBLE END AS negative_aesthetic_score,
    CASE model {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.MODEL_REPOS.items())} ELSE 'unknown' END AS model_repo"""


@query("model_attribution", f"WITH {IMG} SELECT event_id, {_ATTRIBUTION} FROM img")
def model_attribution(spark, sf):
    parts = recipe.model_attribution(F.col("model"))
    return (
        img(spark, sf)
        .select("event_id", *[v.alias(k) for k, v in parts.items()])
        .withColumn("freeu_b1", F.col("freeu.b1"))
        .drop("freeu")
    )


# The given events lie in 2024, so the eras start there.
_ERAS = [("", recipe.ERAS[0][1]), ("20240115-120000", recipe.ERAS[1][1])]


@query(
    "era_asof",
    f"""WITH {IMG}, eras(valid_from, vae, scheduler, freeu_b1, pipeline_version) AS (VALUES
      ('', 'default', '{S.OLD_SCHEDULER}', NULL, 1), ('20240115-120000', '{S.VAE}', '{S.SCHEDULER}', 1.3::DOUBLE, 2))
    SELECT event_id, vae, scheduler, freeu_b1, CAST(e.pipeline_version AS BIGINT) AS pipeline_version
    FROM img ASOF JOIN eras e ON img.ts_name >= e.valid_from""",
)
def era_asof(spark, sf):
    parts = recipe.era_attribution(F.col("ts_name"), _ERAS)
    return img(spark, sf).select(
        "event_id", parts["vae"].alias("vae"), parts["scheduler"].alias("scheduler"),
        parts["freeu"]["b1"].alias("freeu_b1"), parts["pipeline_version"].cast("bigint").alias("pipeline_version"),
    )


@query(
    "era_asof_table",
    f"""WITH {IMG}, eras AS (SELECT category, ts_name AS valid_from, max(event_id) AS era_id FROM img WHERE k = 7 GROUP BY category, ts_name)
    SELECT event_id, era_id FROM img ASOF LEFT JOIN eras ON img.category = eras.category AND img.ts_name >= eras.valid_from""",
)
def era_asof_table(spark, sf):
    """The eras are a table that grows with the data: every hundredth artifact begins one for its category."""
    rows = img(spark, sf)
    eras = rows.filter("k = 7").select("category", F.col("ts_name").alias("valid_from"), F.col("event_id").alias("era_id"))
    found = curate.era_asof(rows.select("event_id", "category", "ts_name"), "ts_name", eras, "valid_from", by=["category"])
    return found.select("event_id", "era.era_id")


_FILLED = f"""WITH {IMG}, f AS (SELECT *, ts_name >= '20240115-120000' AS late, pipeline_version = 1 AS absent, k < 10 AS hidden FROM img)
    SELECT event_id,
      CASE WHEN absent THEN CASE WHEN late THEN '{S.VAE}' ELSE 'default' END WHEN NOT hidden THEN 'vae-x' END AS vae,
      CASE WHEN absent THEN CASE WHEN late THEN '{S.SCHEDULER}' ELSE '{S.OLD_SCHEDULER}' END WHEN NOT hidden THEN 'sched-x' END AS scheduler,
      CASE WHEN absent THEN CASE WHEN late THEN 6.0::DOUBLE END WHEN NOT hidden THEN 6.0::DOUBLE END AS aesthetic_score,
      CASE WHEN absent THEN CASE WHEN late THEN 0.2::DOUBLE END WHEN NOT hidden THEN 0.2::DOUBLE END AS freeu_s2,
      CAST(CASE WHEN absent THEN CASE WHEN late THEN 2 ELSE 1 END ELSE pipeline_version END AS BIGINT) AS pipeline_version,
      CASE WHEN absent THEN CASE model {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.OLD_MODEL_REPOS.items())} END
        WHEN NOT hidden THEN 'repo-x' END AS model_repo
    FROM f"""


@query("attribution_fill", _FILLED)
def attribution_fill(spark, sf):
    rows = img(spark, sf).select("event_id", "ts_name", sidecar_raw().alias("raw"))
    filled = curate.attribution_fill(rows, "raw", "ts_name", _ERAS)
    return filled.select(
        "event_id", "vae", "scheduler", "aesthetic_score", F.col("freeu.s2").alias("freeu_s2"),
        F.col("pipeline_version").cast("bigint").alias("pipeline_version"), "model_repo",
    )


@query(
    "attribution_backfill",
    f"SELECT *, '{{\"a\":[1, 2]}}' AS note FROM ({_FILLED})",
)
def attribution_backfill(spark, sf):
    """The merged object, read again; it also holds a key that no schema knows."""
    raw = F.concat(F.lit('{"note":{"a":[1, 2]},'), F.substr("raw", F.lit(2)))
    rows = img(spark, sf).select("event_id", "ts_name", sidecar_raw().alias("raw")).withColumn("raw", raw)
    merged = curate.attribution_backfill(rows, "raw", "ts_name", eras=_ERAS)
    read = merged.withColumn("m", F.from_json("backfilled", S.SIDECAR_SCHEMA))
    return read.select(
        "event_id", "m.vae", "m.scheduler", "m.aesthetic_score", F.col("m.freeu.s2").alias("freeu_s2"),
        F.col("m.pipeline_version").cast("bigint").alias("pipeline_version"), "m.model_repo",
        F.regexp_extract("backfilled", r'"note":(\{[^}]*\})', 1).alias("note"),
    )


@query(
    "flatten_recipe",
    f"""WITH {IMG}, p AS (SELECT *, dense_rank() OVER (ORDER BY prompt_subject) - 1 AS prompt_id, pipeline_version = 2 AND k >= 10 AS has FROM img)
    SELECT id, created_at, category, CAST(prompt_id AS BIGINT) AS prompt_id, prompt_subject, prompt_subject || ', sharp' AS prompt,
      'blurry' AS negative_prompt, event_id AS seed, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height,
      CAST(40 AS BIGINT) AS steps, CAST(15 AS BIGINT) AS refiner_steps, 0.8::DOUBLE AS high_noise_frac, 6.5::DOUBLE AS guidance_scale,
      CASE WHEN has THEN 'sched-x' END AS scheduler, CASE WHEN has THEN 'vae-x' END AS vae,
      CASE WHEN has THEN 1.3::DOUBLE END AS freeu_b1, CASE WHEN has THEN 1.4::DOUBLE END AS freeu_b2,
      CASE WHEN has THEN 0.9::DOUBLE END AS freeu_s1, CASE WHEN has THEN 0.2::DOUBLE END AS freeu_s2,
      CASE WHEN has THEN 6.0::DOUBLE END AS refiner_aesthetic_score, CASE WHEN has THEN 2.5::DOUBLE END AS refiner_negative_aesthetic_score,
      CASE WHEN has THEN 'repo-x' END AS model_repo,
      CASE WHEN pipeline_version = 2 THEN CAST(2 AS BIGINT) END AS pipeline_version,
      k / 4.0::DOUBLE AS elapsed_seconds, caption AS caption_top, NULL::VARCHAR AS caption_bottom,
      CASE WHEN caption IS NOT NULL THEN 'classic' END AS caption_format,
      round(score::FLOAT::DOUBLE, 6) AS laion_aesthetic, round(nsfw_prob::FLOAT::DOUBLE, 6) AS nsfw_prob FROM p""",
)
def flatten_recipe(spark, sf):
    scores = img(spark, sf).select("id", F.col("score").alias("laion_aesthetic"), "nsfw_prob")
    parsed = readers.parse_sidecars(sidecars(spark, sf), policy="fail").join(scores, "id")
    parsed = freeze(parsed.withColumn("prompt_subject", F.col("meta.prompt_subject")))
    rows = curate.flatten_recipe(ids.prompt_id_join(parsed, ids.dense_prompt_id(parsed)))
    return _plain_types(rows)


def _plain_types(rows: DataFrame) -> DataFrame:
    """Integers as long and floats as rounded doubles, for comparing with SQL."""
    out = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if kind == "int":
            c = c.cast("bigint")
        elif kind == "float":
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(name))
    return rows.select(*out)


@query(
    "effective_params",
    f"""WITH {IMG} SELECT event_id, k AS requested_steps,
    CASE WHEN model <> 'flux' THEN k WHEN k = 0 THEN 4 ELSE least(k, 4) END AS effective_steps,
    score AS requested_guidance, CASE WHEN model = 'flux' THEN 0.0::DOUBLE ELSE score END AS effective_guidance,
    CASE WHEN model <> 'flux' THEN prompt_subject END AS effective_negative FROM img""",
)
def effective_params(spark, sf):
    parts = recipe.effective_params(F.col("model"), F.col("k"), F.col("score"), F.col("prompt_subject"))
    return img(spark, sf).select("event_id", *[v.alias(k) for k, v in parts.items()])


@query(
    "resolution_lookup",
    f"""WITH {IMG} SELECT event_id,
    CAST(CASE WHEN k > 90 AND user_id % 8 > 0 THEN k * 8 ELSE width END AS BIGINT) AS width,
    CAST(CASE WHEN k > 90 AND user_id % 8 > 0 THEN (user_id % 8) * 8 ELSE height END AS BIGINT) AS height FROM img""",
)
def resolution_lookup(spark, sf):
    # Some rows give only the width, some a height of 0: neither is an override.
    width = F.when(F.col("k") > 90, F.col("k") * 8)
    height = F.when(F.col("k") > 80, F.col("user_id") % 8 * 8)
    size = recipe.size_for(F.col("category"), width, height, IMG_SIZES)
    return img(spark, sf).select("event_id", *[v.cast("bigint").alias(k) for k, v in size.items()])


_RENAME = _STEMS + f""",
pay AS (
  SELECT event_id, stem, k, model, ts_name, category, slug FROM stems
  UNION ALL
  SELECT event_id, id, k, model, ts_name, category, slug FROM img WHERE k >= 90
  UNION ALL
  SELECT event_id, replace(old_id, '_s' || event_id, '_s0' || event_id), k, model, ts_name, category, slug FROM img WHERE k >= 80
),
early AS (
  SELECT *, CASE WHEN split_part(stem, '_', 2) IN ('flux', 'juggernaut', 'sdxl-base', 'sdxl-refined') THEN 'already_new'
      WHEN stem LIKE 'IMG%' THEN 'unparseable' WHEN k >= 40 AND k < 45 THEN 'missing_json'
      WHEN k >= 45 AND k < 50 THEN 'json_unreadable' END AS e,
    ts_name || '_' || CASE WHEN k >= 50 AND k < 60 THEN 'sdxl-refined' ELSE model END || '_' || category || '_' || slug || '_s' || event_id AS target
  FROM pay
),
late AS (
  SELECT *, target IN (SELECT stem FROM pay) AS taken,
    row_number() OVER (PARTITION BY CASE WHEN e IS NULL THEN target END, e IS NULL ORDER BY stem || '.png') AS rn
  FROM early
),
plan AS (
  SELECT stem, CASE WHEN e IS NOT NULL THEN e WHEN taken OR rn > 1 THEN 'collision' ELSE 'renamed' END AS outcome,
    CASE WHEN e IS NULL AND NOT taken AND rn = 1 THEN target END AS new_stem FROM late
)"""


def _rename_plan(spark, sf) -> DataFrame:
    rows = _stems(spark, sf)
    padded = F.replace("old_id", F.concat(F.lit("_s"), "event_id"), F.concat(F.lit("_s0"), "event_id"))
    pay = (
        rows.select("stem", "event_id", "k", "model")
        .unionByName(rows.filter("k >= 90").select(F.col("id").alias("stem"), "event_id", "k", "model"))
        .unionByName(rows.filter("k >= 80").select(padded.alias("stem"), "event_id", "k", "model"))
    )
    raw = (
        F.when(F.col("k").between(45, 49), '{"model": ')
        .when(F.col("k").between(50, 54), '{"model": ""}')
        .when(F.col("k").between(55, 59), '{"seed": 1}')
        .otherwise(F.to_json(F.struct("model")))
    )
    have = pay.filter(~F.col("k").between(40, 44)).select("stem", raw.alias("raw"))
    return curate.rename_plan(pay, have, IMG_CATEGORIES)


@query("rename_plan", f"WITH {_RENAME} SELECT stem, outcome, new_stem FROM plan")
def rename_plan(spark, sf):
    return _rename_plan(spark, sf)


@query(
    "outcome_counters",
    f"""WITH {_RENAME}, o(outcome) AS (VALUES {', '.join(f"('{o}')" for o in S.RENAME_OUTCOMES)})
    SELECT o.outcome, count(plan.stem) AS n FROM o LEFT JOIN plan ON o.outcome = plan.outcome GROUP BY o.outcome""",
)
def outcome_counters(spark, sf):
    return curate.counts_with_zeros(_rename_plan(spark, sf), "outcome", S.RENAME_OUTCOMES)


@query(
    "escape_text",
    """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped
    FROM pages""",
)
def escape_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.escape_markup(F.col("html")).alias("escaped"))


# --- Pairing and exclusion -------------------------------------------------------------------------


@query("pair_inner", "SELECT d.doc_id AS id, quality::DOUBLE AS laion_aesthetic, toxic::DOUBLE AS nsfw_prob, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pair_inner(spark, sf):
    return curate.pair_inner(docs(spark, sf), doc_scores(spark, sf)).select(
        "id", "laion_aesthetic", "nsfw_prob", "n_chars"
    )


@query("missing_pair_anti", "SELECT doc_id AS id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_pair_anti(spark, sf):
    return curate.missing_pair_anti(docs(spark, sf), doc_scores(spark, sf)).select("id", "n_chars")


@query("score_left_join", f"WITH {DOC} SELECT id, prompt_subject, quality AS laion_aesthetic, nsfw_prob FROM doc")
def score_left_join(spark, sf):
    rows = curate.score_left_join(docs(spark, sf), doc_scores(spark, sf))
    return rows.select("id", "prompt_subject", "laion_aesthetic", "nsfw_prob")


@query(
    "manual_exclusion",
    f"WITH {DOC} SELECT id, NOT is_manual AS kept FROM doc",
)
def manual_exclusion(spark, sf):
    rows, listed = docs(spark, sf), _repeated(doc_manual(spark, sf))
    kept = curate.manual_exclusion(rows, listed).select("id", F.lit(True).alias("kept"))
    return kept.unionByName(
        curate.manual_exclusion(rows, listed, keep=False).select("id", F.lit(False).alias("kept"))
    )


_RESUME = "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def _to_score(spark, sf, limit: int = 0) -> DataFrame:
    rows = docs(spark, sf).withColumn("path", F.struct("source", "id"))
    return curate.resume_work(rows, doc_scores(spark, sf), "path", limit=limit).select("id", "source")


@query("resume_anti", f"{_RESUME} ORDER BY source, doc_id LIMIT 150")
def resume_anti(spark, sf):
    return _to_score(spark, sf, limit=150)


@query("resume_anti_all", _RESUME)
def resume_anti_all(spark, sf):
    return _to_score(spark, sf)


def _repeated(df: DataFrame) -> DataFrame:
    """Every row twice, as a list has them that was appended to again."""
    return df.unionByName(df)


def _classified(spark, sf) -> DataFrame:
    return curate.exclusion_class(
        docs(spark, sf), _repeated(doc_sidecars(spark, sf)), doc_scores(spark, sf), _repeated(doc_manual(spark, sf))
    )


@query(
    "score_duplicates",
    "SELECT doc_id AS id, 2 AS n FROM labels WHERE toxic = 1",
)
def score_duplicates(spark, sf):
    scores = doc_scores(spark, sf)
    return curate.score_duplicates(scores.unionByName(scores.filter("nsfw_prob = 1")))


@query("exclusion_class", f"WITH {DOC} SELECT id, class FROM doc_class")
def exclusion_class(spark, sf):
    return _classified(spark, sf).select("id", "class")


_CLASSES = f"""WITH {DOC}, c(class) AS (VALUES {', '.join(f"('{c}')" for c in [*S.EXCLUSION_CLASSES, 'kept'])})
    SELECT c.class, count(doc_class.id) AS n FROM c LEFT JOIN doc_class ON c.class = doc_class.class GROUP BY c.class"""


@query("exclusion_counts", _CLASSES)
def exclusion_counts(spark, sf):
    return curate.counts_with_zeros(_classified(spark, sf), "class", [*S.EXCLUSION_CLASSES, "kept"])


@query("id_intersect", "SELECT doc_id AS id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def id_intersect(spark, sf):
    return docs(spark, sf).select("id").intersect(doc_scores(spark, sf).filter("laion_aesthetic = 1").select("id"))


@query("id_except", "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def id_except(spark, sf):
    return docs(spark, sf).select("id").subtract(doc_scores(spark, sf).filter("laion_aesthetic = 1").select("id"))


@query(
    "dense_prompt_id",
    f"""WITH {DOC}, k AS (SELECT DISTINCT prompt_subject FROM doc_class WHERE class = 'kept')
    SELECT prompt_subject, row_number() OVER (ORDER BY prompt_subject) - 1 AS prompt_id FROM k""",
)
def dense_prompt_id(spark, sf):
    kept = _classified(spark, sf).filter("class = 'kept'")
    return ids.dense_prompt_id(kept).withColumn("prompt_id", F.col("prompt_id").cast("bigint"))


@query(
    "prompt_id_join",
    f"WITH {IMG} SELECT id, prompt_subject, dense_rank() OVER (ORDER BY prompt_subject) - 1 AS prompt_id FROM img",
)
def prompt_id_join(spark, sf):
    rows = img(spark, sf).select("id", "prompt_subject")
    joined = ids.prompt_id_join(rows, ids.dense_prompt_id(rows))
    return joined.withColumn("prompt_id", F.col("prompt_id").cast("bigint"))


@query(
    "shard_assign",
    f"""WITH {IMG}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM img)
    SELECT id, pos, pos // 500 AS shard, pos % 500 AS row FROM p""",
)
def shard_assign(spark, sf):
    return _plain_types(ids.shard_assign(img(spark, sf).select("id")))


@query(
    "shard_totals",
    f"""WITH {IMG} SELECT count(*) AS rows, CAST(ceil(count(*) / 500.0) AS BIGINT) AS shards,
    CAST(sum(bytes) AS BIGINT) AS shard_bytes, round(sum(bytes) / pow(2, 30), 6) AS shard_gib FROM img""",
)
def shard_totals(spark, sf):
    return ids.shard_totals(img(spark, sf)).withColumn("shard_gib", F.round("shard_gib", 6))


_FINGERPRINT_COLUMNS = ["category", "prompt_subject", "event_id"]
_PRINTS = IMG + """,
hashed AS (
  SELECT id, id || ':' || md5(length(category) || '=' || category || length(prompt_subject) || '=' || prompt_subject || length(event_id::VARCHAR) || '=' || event_id) AS item, caption FROM img
),
p1 AS (SELECT item, row_number() OVER (ORDER BY id) - 1 AS pos FROM hashed),
p2 AS (SELECT item, row_number() OVER (ORDER BY id) - 1 AS pos FROM hashed WHERE NOT coalesce(caption = 'cap 99', FALSE)),
f1 AS (SELECT pos // 500 AS shard, sha256(chr(10) || string_agg(item, ',' ORDER BY pos)) AS f FROM p1 GROUP BY 1),
f2 AS (SELECT pos // 500 AS shard, sha256(chr(10) || string_agg(item, ',' ORDER BY pos)) AS f FROM p2 GROUP BY 1)"""


@query(
    "shard_fingerprint",
    f"""WITH {_PRINTS} SELECT coalesce(f2.shard, f1.shard) AS shard, f2.f AS fingerprint,
    CASE WHEN f2.f IS NULL THEN 'drop' WHEN f1.f = f2.f THEN 'reuse' ELSE 'rebuild' END AS action
    FROM f2 FULL JOIN f1 ON f1.shard = f2.shard""",
)
def shard_fingerprint(spark, sf):
    rows = img(spark, sf).select("id", "caption", *_FINGERPRINT_COLUMNS)

    def prints(part):
        placed = ids.shard_assign(part.drop("caption"))
        return freeze(ids.shard_fingerprints(placed, _FINGERPRINT_COLUMNS))

    stored = prints(rows)
    wanted = prints(rows.filter(~F.coalesce(F.col("caption") == "cap 99", F.lit(False))))
    actions = ids.shard_reuse(wanted, stored)
    return _plain_types(actions.join(wanted.select("shard", "fingerprint"), "shard", "left"))


# --- The build ---------------------------------------------------------------------------------------

_BUILT = IMG + """,
built AS (
  SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS total,
    dense_rank() OVER (ORDER BY prompt_subject) - 1 AS prompt_id
  FROM img WHERE nsfw_prob < 0.7 AND k <> 13
),
shards AS (
  SELECT printf('train-%05d-of-%05d.parquet', pos // 500, CAST(ceil(total / 500.0) AS BIGINT)) AS shard,
    count(*) AS rows FROM built GROUP BY 1
)"""


def _build_inputs(spark, sf):
    rows = img(spark, sf)
    scores = rows.select("id", F.col("score").alias("laion_aesthetic"), "nsfw_prob")
    manual = rows.filter("k = 13").select("id")
    payloads = rows.select(F.col("id"), F.encode("prompt_subject", "UTF-8").alias("content"))
    return payloads, sidecars(spark, sf).select("id", "raw"), scores, manual


def _images(payloads: DataFrame) -> DataFrame:
    return scoring.payload_transform(payloads, _zlib_encoder, _zlib_decoder, ".zlib")


def _zlib_encoder():
    import zlib

    return lambda data: zlib.compress(data, 6)


def _zlib_decoder():
    import zlib

    return zlib.decompress


def _published(spark, sf, name: str) -> tuple[str, DataFrame]:
    folder = work_path(spark, name)
    payloads, side, scores, manual = _build_inputs(spark, sf)
    return folder, job.publish(payloads, side, scores, manual, _images(payloads), folder, threshold=0.7)


@query("write_shards", f"WITH {_BUILT} SELECT shard, rows FROM shards")
def write_shards(spark, sf):
    return _published(spark, sf, "build")[1].select("shard", "rows")


# Rows whose sidecar is another one in the second build, and how many rows at the end that build leaves out.
_EDITED, _CUT = "event_id % 2003 = 5", 600


@query(
    "publish_again",
    f"""WITH {IMG},
    kept AS (SELECT id, event_id, prompt_subject, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS total FROM img WHERE nsfw_prob < 0.7 AND k <> 13),
    first AS (SELECT id, event_id AS seed, pos, dense_rank() OVER (ORDER BY prompt_subject) AS prompt FROM kept),
    second AS (SELECT id, CASE WHEN {_EDITED} THEN -1 ELSE event_id END AS seed, pos, dense_rank() OVER (ORDER BY prompt_subject) AS prompt
      FROM kept WHERE pos < total - {_CUT}),
    s1 AS (SELECT pos // 500 AS shard, count(*) AS rows, string_agg(id || ' ' || seed || ' ' || prompt, ',' ORDER BY pos) AS content FROM first GROUP BY 1),
    s2 AS (SELECT pos // 500 AS shard, count(*) AS rows, string_agg(id || ' ' || seed || ' ' || prompt, ',' ORDER BY pos) AS content FROM second GROUP BY 1)
    SELECT coalesce(s2.shard, s1.shard) AS shard, coalesce(s2.rows, s1.rows) AS rows,
      CASE WHEN s2.shard IS NULL THEN 'drop' WHEN s1.content = s2.content THEN 'reuse' ELSE 'rebuild' END AS action
    FROM s2 FULL JOIN s1 ON s1.shard = s2.shard""",
)
def publish_again(spark, sf):
    """A second build with some other sidecars and without the last rows: what becomes of each shard."""
    folder, _ = _published(spark, sf, "again")
    payloads, side, scores, manual = _build_inputs(spark, sf)
    edited = img(spark, sf).filter(_EDITED).select("id", F.lit(True).alias("edited"))
    raw = F.when(F.col("edited"), F.regexp_replace("raw", r'"seed": ?\d+', '"seed": -1')).otherwise(F.col("raw"))
    placed = ids.shard_assign(readers.scan_metadata(spark, folder)[0].select("id"))
    last = placed.filter(F.col("pos") >= placed.agg(F.count("*") - _CUT).scalar()).select("id")
    side = side.join(edited, "id", "left").select("id", raw.alias("raw"))
    job.publish(payloads, side, scores, manual.unionByName(last), _images(payloads), folder, threshold=0.7)
    return _plain_types(readers.build_actions(spark, folder).select("shard", "rows", "action"))


@query(
    "write_shards_from_files",
    """WITH k AS (SELECT page_id::VARCHAR AS id, html, url, row_number() OVER (ORDER BY page_id::VARCHAR) - 1 AS pos,
      count(*) OVER () AS total FROM pages WHERE url NOT LIKE '%#%')
    SELECT printf('train-%05d-of-%05d.parquet', pos // 500, CAST(ceil(total / 500.0) AS BIGINT)) AS shard, id,
    id || '.raw' AS path, CAST(strlen(html) AS BIGINT) AS n_bytes, CAST(length(url) AS BIGINT) AS seed FROM k""",
)
def write_shards_from_files(spark, sf):
    """Every page as a payload file, read by the task that writes its shard; then read back."""
    payload_folder, folder = work_path(spark, "page-files"), work_path(spark, "page-set")
    _page_files(spark, sf, payload_folder)
    pages = table(spark, sf, "pages").withColumn("id", F.col("page_id").cast("string"))
    subject = F.substring_index(F.substring_index("url", "://", -1), "/", 1).alias("prompt_subject")
    side = pages.select("id", F.to_json(F.struct(subject, F.length("url").alias("seed"))).alias("raw"))
    prob = F.when(F.contains("url", F.lit("#")), 0.9).otherwise(0.1)
    scores = pages.select("id", F.lit(5.0).alias("laion_aesthetic"), prob.alias("nsfw_prob"))
    payloads = readers.scan_payloads(spark, payload_folder).withColumnRenamed("stem", "id")
    source = job.PayloadFiles(payload_folder, lambda: bytes, ".raw")
    nothing_listed = spark.createDataFrame([], "id string")
    job.publish(payloads, side, scores, nothing_listed, source, folder)
    back, _ = readers.open_build(spark, folder)
    return back.select(
        "shard", "id", "image.path",
        F.octet_length("image.bytes").cast("bigint").alias("n_bytes"), "seed",
    )


@query(
    "footer_metadata",
    f"""WITH {_BUILT} SELECT shard, CAST(ceil(rows / 100.0) AS BIGINT) AS row_groups, rows,
    CAST({len(S.RECIPE_COLUMNS) + 1} AS BIGINT) AS features FROM shards""",
)
def footer_metadata(spark, sf):
    folder, manifest = _published(spark, sf, "footers")
    return writers.footer_of(manifest, f"{folder}/data")


@query(
    "write_metadata",
    f"""WITH {_BUILT} SELECT id, CAST(prompt_id AS BIGINT) AS prompt_id, category, event_id AS seed, caption AS caption_top,
    round(score::FLOAT::DOUBLE, 6) AS laion_aesthetic, round(nsfw_prob::FLOAT::DOUBLE, 6) AS nsfw_prob FROM built""",
)
def write_metadata(spark, sf):
    payloads, side, scores, manual = _build_inputs(spark, sf)
    build = job.plan_build(payloads, side, scores, manual, threshold=0.7)
    path = work_path(spark, "metadata")
    writers.write_metadata(build.rows, path)
    rows = spark.read.parquet(path)
    return _plain_types(
        rows.select("id", "prompt_id", "category", "seed", "caption_top", "laion_aesthetic", "nsfw_prob")
    )


@query(
    "scan_metadata",
    f"""WITH {_BUILT} SELECT (SELECT count(*) FROM built) AS rows, (SELECT count(DISTINCT prompt_subject) FROM built) AS prompts,
    (SELECT count(*) FROM shards) AS shards, 0.7::DOUBLE AS nsfw_threshold, (SELECT count(*) FROM built) AS metadata_rows""",
)
def scan_metadata(spark, sf):
    folder, _ = _published(spark, sf, "report")
    rows, report = readers.scan_metadata(spark, folder)
    return report.select(
        "rows", "prompts", "shards", "nsfw_threshold",
        rows.agg(F.count("*").alias("n")).scalar().alias("metadata_rows"),
    )


@query(
    "build_report",
    f"""WITH {DOC}, c(class) AS (VALUES {', '.join(f"('{c}')" for c in S.EXCLUSION_CLASSES)}), k AS (SELECT * FROM doc_class WHERE class = 'kept')
    SELECT c.class, count(doc_class.id) AS n, (SELECT count(*) FROM k) AS rows,
    (SELECT count(DISTINCT prompt_subject) FROM k) AS prompts, CAST(ceil((SELECT count(*) FROM k) / 500.0) AS BIGINT) AS shards
    FROM c LEFT JOIN doc_class ON c.class = doc_class.class GROUP BY c.class""",
)
def build_report(spark, sf):
    classified = _classified(spark, sf)
    kept = classified.filter("class = 'kept'")
    manifest = (
        ids.shard_assign(kept.select("id", "n_chars"))
        .groupBy("shard")
        .agg(F.count("*").alias("rows"), F.sum("n_chars").alias("bytes"))
    )
    report = curate.build_report(classified, kept.select("prompt_subject").distinct(), manifest, 0.5)
    return report.select(
        F.explode("excluded_counts").alias("class", "n"), "rows", "prompts", "shards"
    )


@query(
    "write_sidecars",
    f"WITH {IMG} SELECT id, category, event_id AS seed, caption, ts_name[:8] AS day, score FROM img",
)
def write_sidecars(spark, sf):
    path = work_path(spark, "sidecars")
    rows = img(spark, sf).withColumn("day", F.concat(F.lit("d"), F.substring("ts_name", 1, 8)))
    rows = rows.withColumn("seed", F.col("event_id"))
    writers.write_sidecar_lines(rows, path, "day", ["id", "category", "seed", "caption", "score"])
    back = spark.read.text(path).withColumn(
        "r", F.from_json("value", "id string, category string, seed bigint, caption string, score double")
    )
    return back.select("r.*", F.substring("day", 2, 8).alias("day"))


@query(
    "append_scores",
    """SELECT doc_id::VARCHAR AS id, quality::DOUBLE AS laion_aesthetic, toxic::DOUBLE AS nsfw_prob FROM labels WHERE quality = 1
    UNION ALL SELECT doc_id::VARCHAR, quality::DOUBLE, toxic::DOUBLE FROM labels""",
)
def append_scores(spark, sf):
    path = work_path(spark, "appended")
    scores = doc_scores(spark, sf).withColumn("id", F.col("id").cast("string"))
    writers.append_scores(scores.filter("laion_aesthetic = 1"), path)
    writers.append_scores(scores, path)
    return readers.scan_scores(spark, path)


@query(
    "retention_summary",
    f"""WITH {DOC} SELECT CASE WHEN grouping(class) = 1 THEN 'Total' ELSE class END AS label, count(*) AS objects,
    CAST(sum(n_chars) AS BIGINT) AS n_bytes FROM doc_class GROUP BY ROLLUP(class)""",
)
def retention_summary(spark, sf):
    from sievework.operators.stats import retention_summary as summary

    return summary(_classified(spark, sf), "class", "n_chars")
