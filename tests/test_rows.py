"""No operator loses, multiplies or hides rows: the inputs on which some once did."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievework.operators import curate, ids, jobs, records, verify


def test_draw_of_a_category_without_subjects_fails(spark):
    bank = jobs.prompt_bank(spark.createDataFrame([("a", f"s{i}") for i in range(7)], "category string, subject string"))
    drawn = jobs.weighted_draw(jobs.index_source(spark, 1000), bank, {"a": 1.0}, 3)
    assert drawn.count() == 1000 and drawn.filter("subject IS NULL").count() == 0
    with pytest.raises(PySparkException):
        jobs.weighted_draw(jobs.index_source(spark, 1000), bank, {"a": 1.0, "b": 1.0}, 3).collect()


def test_lists_are_sets_and_scores_are_unique(spark):
    payloads = spark.createDataFrame([("p",), ("q",), ("r",)], "id string")
    listed = spark.createDataFrame([("q",), ("q",)], "id string")
    scores = spark.createDataFrame([("p", 5.0, 0.1), ("r", 5.0, 0.9)], "id string, laion_aesthetic double, nsfw_prob double")
    got = curate.exclusion_class(payloads, payloads.unionByName(payloads), scores, listed).select("id", "class").collect()
    assert sorted(map(tuple, got)) == [("p", "kept"), ("q", "manual"), ("r", "nsfw")]
    doubled = scores.unionByName(scores.filter("id = 'p'"))
    assert [tuple(r) for r in curate.score_duplicates(doubled).collect()] == [("p", 2)]
    with pytest.raises(PySparkException):
        curate.exclusion_class(payloads, payloads, doubled, listed).collect()


def test_different_rows_have_different_digests(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), ("a|=b", "c"), ("a", "b|=c"), (None, "a"), ("a", None), ("-", "-"), (None, None), ("1=a", ""), ("", "1=a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(ids.row_hash(["x", "y"]).alias("h")).distinct().count() == len(rows)


def test_differing_duplicates_are_seen(spark):
    source = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (3, None)], "id int, v string")
    copy = spark.createDataFrame([(1, "x"), (1, "z"), (2, "x"), (3, "x"), (3, None)], "id int, v string")
    got = {tuple(r) for r in verify.verify_copy(source, copy, "id", ["v"]).collect()}
    assert got == {
        (1, "duplicate", None, None, None), (1, "mismatch", "v", "x", "z"), (2, "source_duplicate", None, None, None),
        (3, "duplicate", None, None, None), (3, "mismatch", "v", None, "x"),
    }


def test_content_is_compared(spark):
    source = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, b"abc")], "id int, data binary")
    copy = spark.createDataFrame([(1, b"abc"), (2, b"abd"), (3, b"ab")], "id int, data binary")
    got = sorted((r.id, r.finding) for r in verify.verify_copy(source, copy, "id", [], payload="data").collect())
    assert got == [(2, "digest"), (3, "digest"), (3, "length")]


def test_backfill_keeps_the_object(spark):
    rows = [
        ("20200101-000000", '{"model": "m", "x": {"vae": 1},  "vae": null}'), ("20200101-000000", "{}"), ("20200101-000000", " { } "),
        ("20200101-000000", "[1]"), ("20200101-000000", None), ("20200101-000000", "not json"),
    ]
    df = spark.createDataFrame(rows, "ts string, raw string")
    got = [(r["raw"], r["backfilled"]) for r in curate.attribution_backfill(df, "raw", "ts").collect()]
    for raw, filled in got[:3]:
        before, after = json.loads(raw), json.loads(filled)
        assert {k: after[k] for k in before} == before and filled.startswith(raw.rstrip()[:-1])
        assert {"vae", "scheduler", "model_repo", "pipeline_version"} <= set(after)
    assert json.loads(got[0][1])["vae"] is None
    assert all(raw == filled for raw, filled in got[3:])
    again = df.select("ts", F.lit(got[0][1]).alias("raw")).limit(1)
    assert curate.attribution_backfill(again, "raw", "ts").first()["backfilled"] == got[0][1]


def test_records_without_status_are_open(spark):
    rows = spark.createDataFrame([("done",), (None,), ("now",)], "status string")
    assert tuple(records.status_counts(rows).first()) == (2, 1)


@pytest.mark.parametrize("cap", [3, 1500])
def test_run_cap_per_subject(spark, cap):
    rows = spark.range(8000).select(F.col("id").alias("seed"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("s"), F.lit(1).alias("bytes"))
    got = {r["s"]: (r["n"], r["top"]) for r in ids.run_cap(rows, "seed", "bytes", subject="s", per_subject=cap).groupBy("s").agg(F.count("*").alias("n"), F.max("seed").alias("top")).collect()}
    assert {s: n for s, (n, _) in got.items()} == {"a": cap, "b": cap}
    assert got["b"][1] == 4 * (cap - 1)
