"""Names, recipe, exclusion, rename plan and index: small literal inputs for the known traps."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievework import schema as S
from sievework.functions import draws, names, recipe, text, vectors
from sievework.operators import curate, ids, index, jobs, ordering, verify
from sievework.sources import readers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("A cat, on a Mat!", "a-cat-on-a-mat"),
        ("", "image"),
        ("éß", "image"),
        ("--x--", "x"),
        ("a" * 49 + " b", "a" * 49 + "-"),
        ("Über 9000", "ber-9000"),
    ],
)
def test_slugify(spark, given, want):
    assert one(spark, names.slugify(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    "stem, want",
    [
        ("20260101-000000_sci_fi_red-moon_s007", ("20260101-000000", "sci_fi", "red-moon", 7)),
        ("20260101-000000_food_a_s1_s2", ("20260101-000000", "food", "a_s1", 2)),
        ("20260101-000000_food__s5", ("20260101-000000", "food", "", 5)),
        ("20260101-000000_flux_food_a_s1", None),
        ("20260101-000000_fluxus_food_a_s1", None),
        ("20260101-000000_meme_a_s1", None),
        ("2026-000000_food_a_s1", None),
        ("20260101-000000_food_a_s", None),
        ("20260101-000000_custom_a_s0", ("20260101-000000", "custom", "a", 0)),
    ],
)
def test_parse_artifact_name(spark, stem, want):
    got = one(spark, names.parse_artifact_name(F.col("t")), t=stem)
    assert (got and tuple(got)[:4]) == want


def test_parse_prefers_the_longest_category(spark):
    parse = names.parse_artifact_name(F.col("t"), ["click", "click_alt"])
    assert one(spark, parse, t="20260101-000000_click_alt_x_s1")["category"] == "click_alt"
    # Nothing follows `click_alt_`, so the shorter one is the category.
    assert tuple(one(spark, parse, t="20260101-000000_click_alt_s1"))[:3] == ("20260101-000000", "click", "alt")


def test_is_new_format(spark):
    new = names.is_new_format(F.col("t"))
    assert one(spark, new, t="x_flux_rest") and one(spark, new, t="x_flux")
    assert not one(spark, new, t="flux") and not one(spark, new, t="x_fluxus_y")


def test_era_boundary_is_inclusive(spark):
    version = recipe.era_attribution(F.col("t"))["pipeline_version"]
    assert one(spark, version, t="20260502-090500") == 1
    assert one(spark, version, t=S.ERA_START) == 2


def test_attribution_fill_keeps_explicit_null(spark):
    rows = [
        ("20260601-000000", '{"vae": null, "model": "juggernaut"}'),
        ("20260101-000000", '{"model": null, "scheduler": "mine"}'),
        ("20260101-000000", '{"model": "other"}'),
    ]
    got = curate.attribution_fill(spark.createDataFrame(rows, "ts string, raw string"), "raw", "ts").collect()
    assert got[0]["vae"] is None and got[0]["scheduler"] == S.SCHEDULER
    assert got[0]["model_repo"] == S.OLD_MODEL_REPOS["juggernaut"] and got[0]["freeu"]["s2"] == 0.2
    assert (got[1]["scheduler"], got[1]["vae"], got[1]["model_repo"]) == ("mine", "default", S.MODEL_REPOS["sdxl-refined"])
    assert got[1]["freeu"] is None and got[2]["model_repo"] == "unknown"


def test_exclusion_order_and_threshold(spark):
    payloads = spark.createDataFrame([(c,) for c in "abcdefgh"], "id string")
    sidecars = spark.createDataFrame([(c,) for c in "bcdefghz"], "id string")
    scores = spark.createDataFrame(
        [("a", 0.9), ("b", 0.9), ("d", 0.5), ("e", 0.4999999), ("f", float("nan")), ("g", None), ("z", 0.1)],
        "id string, nsfw_prob double",
    )
    manual = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r["id"]: r["class"] for r in curate.exclusion_class(payloads, sidecars, scores, manual).collect()}
    assert got == {
        "a": "no_sidecar", "b": "manual", "c": "manual", "d": "nsfw",
        "e": "kept", "f": "kept", "g": "kept", "h": "not_scored",
    }


def test_threshold_is_tested_on_the_double(spark):
    """float(0.7) is below 0.7, so the narrowed score must not be the one compared."""
    df = spark.createDataFrame([(0.7,)], "p double")
    assert df.select(curate.over_threshold(F.col("p"), 0.7).alias("x")).first()["x"]
    assert not df.select((F.col("p").cast("float") >= F.lit(0.7)).alias("x")).first()["x"]


def test_rename_plan_collisions(spark):
    food = "20260101-000000_food_a_s"
    payloads = [food + "01", food + "1", food + "2", "20260101-000000_flux_food_a_s2", food + "3", food + "4", "odd"]
    flux = '{"model": "flux"}'
    sidecars = [(food + "01", flux), (food + "1", flux), (food + "2", flux), (food + "3", "{"), ("20260101-000000_sdxl-refined_food_a_s9", "{}")]
    p = spark.createDataFrame([(x,) for x in payloads], "stem string")
    s = spark.createDataFrame(sidecars, "stem string, raw string")

    def plan(dry):
        return {r["stem"]: r["outcome"] for r in curate.rename_plan(p, s, dry_run=dry).collect()}

    want = {
        food + "01": "renamed", food + "1": "collision", food + "2": "collision",
        "20260101-000000_flux_food_a_s2": "already_new", food + "3": "json_unreadable",
        food + "4": "missing_json", "odd": "unparseable",
    }
    assert plan(False) == want
    assert plan(True) == {**want, food + "1": "renamed"}


def test_counts_with_zeros(spark):
    df = spark.createDataFrame([("nsfw",)], "class string")
    got = {r["class"]: r["n"] for r in curate.counts_with_zeros(df, "class", S.EXCLUSION_CLASSES).collect()}
    assert got == {"manual": 0, "no_sidecar": 0, "not_scored": 0, "nsfw": 1}


def test_size_override_needs_both(spark):
    df = spark.createDataFrame(
        [("nature", 8, 16), ("nature", 8, None), ("nature", 0, 16), ("other", None, None), (None, None, None)],
        "c string, w int, h int",
    )
    size = recipe.size_for(F.col("c"), F.col("w"), F.col("h"))
    got = [tuple(r) for r in df.select(size["width"].alias("w"), size["height"].alias("h")).collect()]
    assert got == [(8, 16), (1344, 768), (1344, 768), (1024, 1024), (1024, 1024)]


def test_effective_params(spark):
    df = spark.createDataFrame([("flux", 0), ("flux", 3), ("flux", 40), ("sdxl-base", 40)], "m string, s int")
    parts = recipe.effective_params(F.col("m"), F.col("s"), F.lit(6.5), F.lit("bad"))
    got = [tuple(r) for r in df.select(parts["effective_steps"], parts["effective_guidance"], parts["effective_negative"]).collect()]
    assert got == [(4, 0.0, None), (3, 0.0, None), (4, 0.0, None), (40, 6.5, "bad")]


def test_weighted_choice_covers_the_range(spark):
    weights = {"a": 1.0, "b": 0.0, "c": 3.0}
    assert draws.cumulative_weights(weights) == [("a", 0.0, 1.0), ("b", 1.0, 1.0), ("c", 1.0, 4.0)]
    us = [0.0, 0.2499, 0.25, 0.9999999]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    assert [r[0] for r in df.select(draws.weighted_choice(F.col("u"), weights)).collect()] == ["a", "a", "c", "c"]


def test_draw_distribution(spark):
    n = 20000
    rows = spark.range(n).withColumn("c", draws.weighted_choice(draws.uniform(1, F.col("id"), "c"), S.CATEGORY_WEIGHTS))
    got = {r["c"]: r["count"] / n for r in rows.groupBy("c").count().collect()}
    total = sum(S.CATEGORY_WEIGHTS.values())
    for name, weight in S.CATEGORY_WEIGHTS.items():
        assert abs(got[name] - weight / total) < 0.012


def test_jobs_reject_bad_arguments(spark):
    bank = jobs.prompt_bank(spark.createDataFrame([("food", "soup")], "category string, subject string"))
    with pytest.raises(ValueError):
        jobs.weighted_draw(jobs.index_source(spark, 3), bank, {"food": 1.0}, 0, category="nope")
    drawn = jobs.weighted_draw(jobs.index_source(spark, 3), bank, {"food": 1.0}, 0, category="food")
    with pytest.raises(ValueError):
        jobs.plan_jobs(drawn, width=1001)
    planned = jobs.plan_jobs(drawn, base_seed=5, width=512, height=512)
    assert [(r["seed"], r["width"], r["prompt_subject"]) for r in planned.orderBy("seed").collect()] == [
        (5, 512, "soup"), (6, 512, "soup"), (7, 512, "soup")
    ]
    assert set(f.name for f in S.SIDECAR_SCHEMA) <= set(planned.columns)


def test_escape_and_trim(spark):
    assert one(spark, text.escape_markup(F.col("t")), t="<a b='&amp;\">") == "&lt;a b=&#x27;&amp;amp;&quot;&gt;"
    assert one(spark, text.trim_line(F.col("t")), t="﻿ \t x  　\r") == "x"


def test_is_iso_date(spark):
    """Every day and the day past each month's end, of a common and a leap year, and other ways to write a day."""
    import calendar

    want = {None: False, "": False}
    for year in (2023, 2024):
        for month in range(1, 13):
            last = calendar.monthrange(year, month)[1]
            for day in range(1, last + 2):
                want[f"{year}-{month:02d}-{day:02d}"] = day <= last
            want[f"{year}-{month}-7"] = want[f"{month:02d}.07.{year}"] = want[f" {year}-{month:02d}-07"] = False
    df = spark.createDataFrame([(d,) for d in want], "t string")
    assert {r["t"]: r["ok"] for r in df.select("t", text.is_iso_date(F.col("t")).alias("ok")).collect()} == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "e array<float>")
    got = [r[0] for r in df.select(vectors.l2_normalize(F.col("e"), 2)).collect()]
    assert got == [[0.6, 0.8], [None, None]]
    with pytest.raises(Exception):
        df.select(vectors.l2_normalize(F.col("e"), 3)).collect()
    prob = df.select(vectors.softmax_prob(F.col("e"), ["sfw", "nsfw"], "nsfw")).collect()
    assert abs(prob[0][0] - 0.7310585786) < 1e-9 and prob[1][0] == 0.5
    big = spark.createDataFrame([([1000.0, 0.0],)], "e array<double>")
    assert big.select(vectors.softmax_prob(F.col("e"), ["a", "b"], "a")).first()[0] == 1.0


INDEX = [("n1", "a", "One", 1.0), ("n2", "b", "Two % x", 2.0), ("n3", "a", "two", 2.0), ("n4", "a", "Four_", 3.0)]


@pytest.fixture(scope="module")
def idx(spark):
    return spark.createDataFrame(INDEX, "name string, cat string, subj string, mtime double")


def test_keyset_pages(idx):
    def page(**kw):
        return [r["name"] for r in index.keyset_page(idx, **kw).collect()]

    assert page(limit=2) == ["n4", "n2"]
    # The plain cursor loses n3, which shares the boundary time; the composite one does not.
    assert page(before=2.0) == ["n1"]
    assert page(before=2.0, before_name="n2") == ["n3", "n1"]
    assert page(before=-1) == ["n4", "n2", "n3", "n1"] and page(limit=0) == ["n4"]
    assert index.page_limit(5000) == 1000 and index.page_limit("x") == 200


def test_pages_join_to_the_whole_index(idx):
    seen, before, name = [], 0, None
    while True:
        rows = index.keyset_page(idx, before=before, limit=1, before_name=name).collect()
        if not rows:
            break
        seen.append(rows[0]["name"])
        before, name = rows[0]["mtime"], rows[0]["name"]
    ranked = index.newest_first_rank(idx).orderBy("rank").collect()
    assert seen == [r["name"] for r in ranked] == ["n4", "n2", "n3", "n1"]


def test_search_is_literal(idx):
    assert [r["name"] for r in index.search_filter(idx, "", " % ").collect()] == ["n2"]
    assert [r["name"] for r in index.search_filter(idx, "a", "TWO").collect()] == ["n3"]
    assert [r["name"] for r in index.search_filter(idx, "", "_").collect()] == ["n4"]
    assert index.search_filter(idx).count() == 4


def test_since(idx):
    assert index.since_filter(idx, "junk").count() == 4 and index.since_filter(idx, 2.0).count() == 1


def test_feed_payload(idx):
    got = json.loads(index.feed_payload(index.keyset_page(idx, limit=2), idx).first()["payload"])
    assert got["total"] == 4 and [r["name"] for r in got["images"]] == ["n4", "n2"]


def test_run_cap(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i}", 10) for i in range(30)], "id int, subject string, bytes int")
    assert ids.run_cap(df, "id", "bytes", max_rows=4).count() == 4
    assert ids.run_cap(df, "id", "bytes", max_bytes=55).count() == 5
    assert ids.run_cap(df, "id", "bytes", subject="subject", per_subject=2).count() == 12


def test_verify_and_drift(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (4, "q"), (4, "q")], "id int, v string")
    got = {(r["id"], r["finding"]) for r in verify.verify_copy(a, b, "id", ["v"]).collect()}
    assert got == {(2, "mismatch"), (3, "missing"), (4, "unexpected"), (4, "duplicate")}
    assert verify.verify_copy(a, a, "id", ["v"]).count() == 0
    drift = {tuple(r) for r in verify.drift_check(a, b.dropDuplicates(), ["id"]).collect()}
    assert drift == {(2, "changed"), (3, "extra"), (4, "missing")}


def test_era_table_by_key_with_ties_nulls_and_a_hot_time(spark):
    rng = random.Random(4)
    eras = [(k, s, v) for v, (k, s) in enumerate((rng.choice("abc"), rng.choice([None, *range(0, 60, 3)])) for _ in range(40))]
    eras.append((None, 10, 99))
    rows = [(i, rng.choice(["a", "b", "c", None, "d"]), rng.choice([None, 31, *range(-5, 70)])) for i in range(400)]
    # A time that most rows share, in one key.
    rows += [(1000 + i, "a", 31) for i in range(600)]

    def want(key, at):
        held = [(s, v) for k, s, v in eras if k == key and s is not None and at is not None and s <= at]
        return max(held)[1] if held else None

    df = spark.createDataFrame(rows, "i long, key string, at int").repartition(5)
    table = spark.createDataFrame(eras, "key string, start int, v int")
    got = curate.era_asof(df, "at", table, "start", by=["key"])
    assert got.columns == ["i", "key", "at", "era"]
    assert {r["i"]: r["era"]["v"] if r["era"] else None for r in got.collect()} == {i: want(k, at) for i, k, at in rows}
    # One key for all, no eras, no rows.
    single = curate.era_asof(df.select("i", "at"), "at", table.drop("key").filter("start = 30").limit(1), "start")
    assert {r["i"]: r["era"] is not None for r in single.collect()} == {i: at is not None and at >= 30 for i, _, at in rows}
    assert curate.era_asof(df, "at", table.limit(0), "start", by=["key"]).filter("era IS NOT NULL").count() == 0
    assert curate.era_asof(df.limit(0), "at", table, "start", by=["key"]).count() == 0


def test_a_hot_era_is_spread_over_tasks(spark):
    rows = spark.range(4000).select("id", F.lit(5).alias("at"))
    eras = spark.createDataFrame([(1, "x")], "start int, v string")
    found = curate.era_asof(rows, "at", eras, "start").groupBy(F.col("era.v")).count().collect()
    assert [tuple(r) for r in found] == [("x", 4000)]
    # A few thousand rows would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = ordering._ordered(rows.withColumn("tie", F.xxhash64("id")), ["at", "tie"]).groupBy("__range_part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 2


def test_open_map_survives_flattening(spark):
    raw = ['{"prompt_subject":"p","extra":{"meme":{"top_text":"t","format":7},"new":{"deep":[1,{"x":null}]}}}', '{"prompt_subject":"p","extra":{"meme":"plain"}}', '{"prompt_subject":"p"}', '{"prompt_subject":"p","extra":null}', '{"prompt_subject":"p","extra":[1,2]}']
    rows = spark.createDataFrame([(str(i), r, 0, None, None) for i, r in enumerate(raw)], "id string, raw string, prompt_id int, laion_aesthetic double, nsfw_prob double")
    flat = curate.flatten_recipe(readers.parse_sidecars(rows, policy="fail"), keep_extra=True)
    got = [tuple(r) for r in flat.orderBy("id").select("caption_top", "caption_format", F.to_json("extra")).collect()]
    assert got[0] == ("t", "7", '{"meme":{"format":7,"top_text":"t"},"new":{"deep":[1,{"x":null}]}}')
    assert [g[:2] for g in got[1:]] == [(None, None)] * 4 and [g[2] for g in got[1:]] == ['{"meme":"plain"}', None, "null", "[1,2]"]
    # Without the map the row is the published one.
    assert curate.flatten_recipe(readers.parse_sidecars(rows)).columns == [c for c, _ in S.RECIPE_COLUMNS]
