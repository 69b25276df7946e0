"""Comparison by digests of key ranges, the routing map, bounded pages, the dataset card."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import card, curate, index as ix, lines as ln, verify
from sievework.schema import MAX_PAGE_SIZE


def table(spark, n=6000):
    rng = random.Random(2)
    return spark.createDataFrame([(f"i{i}", rng.choice([None, "x", "y, z", ""]), rng.randrange(9), [rng.choice([None, "a", "a, b"]), "c"]) for i in range(n)], "id string, s string, v int, l array<string>")


@pytest.fixture
def small_ranges():
    held = verify.RANGE_ROWS
    verify.RANGE_ROWS = 20
    yield
    verify.RANGE_ROWS = held


def test_equal_tables_are_told_by_digests_alone(spark, small_ranges):
    rows = table(spark)
    apart = verify.differing_ranges(rows, rows.repartition(7), ["id"], ["s", "v", "l"])
    assert rows.filter(apart).count() == 0
    assert verify.verify_ranges(rows, rows.repartition(3), "id", ["s", "v"]).count() == 0
    assert verify.drift_ranges(rows, rows.repartition(3), ["id"]).count() == 0


@pytest.mark.parametrize("change", ["value", "null", "list", "missing", "more", "twice"])
def test_one_changed_row_opens_one_range(spark, small_ranges, change):
    rows = table(spark)
    at = F.col("id") == "i77"
    copy = {
        "value": lambda: rows.withColumn("v", F.when(at, -1).otherwise(F.col("v"))),
        "null": lambda: rows.withColumn("s", F.when(~at, F.col("s")).otherwise(F.when(F.col("s").isNull(), ""))),
        "list": lambda: rows.withColumn("l", F.when(at, F.array(F.lit("other"))).otherwise(F.col("l"))),
        "missing": lambda: rows.filter(~at),
        "more": lambda: rows.unionByName(rows.filter(at).withColumn("id", F.lit("new"))),
        "twice": lambda: rows.unionByName(rows.filter(at)),
    }[change]()
    apart = verify.differing_ranges(rows, copy, ["id"], ["s", "v", "l"])
    assert 1 <= copy.unionByName(rows).filter(apart).count() <= 50
    plain = verify.verify_copy(rows.withColumn("l", F.to_json("l")), copy.withColumn("l", F.to_json("l")), "id", ["s", "v", "l"])
    found = verify.verify_ranges(rows.withColumn("l", F.to_json("l")), copy.withColumn("l", F.to_json("l")), "id", ["s", "v", "l"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str) != []
    if change not in ("twice",):
        assert {tuple(r) for r in verify.drift_ranges(copy, rows, ["id"]).collect()} == {tuple(r) for r in verify.drift_check(copy, rows, ["id"]).collect()} != set()


def test_all_findings_are_those_of_the_full_comparison(spark, small_ranges):
    rows = table(spark, 900)
    n = F.substring("id", 2, 9).try_cast("int")
    twice = rows.filter(n % 97 == 5)
    source = rows.unionByName(twice)
    copy = rows.filter(n % 50 != 3).withColumn("v", F.when(n % 31 == 4, None).otherwise(F.col("v"))).unionByName(twice.filter(n % 2 == 0))
    copy = copy.unionByName(rows.filter(n % 89 == 1).withColumn("id", F.concat("id", F.lit("x")))).unionByName(rows.limit(1).withColumn("id", F.lit(None).cast("string")))
    excluded = rows.filter(n % 40 == 9).select("id").unionByName(rows.limit(1).select(F.lit("never").alias("id")))
    for ex in (None, excluded):
        want = sorted(map(tuple, verify.verify_copy(source, copy, "id", ["s", "v"], ex, "s").collect()), key=str)
        assert sorted(map(tuple, verify.verify_ranges(source, copy, "id", ["s", "v"], ex, "s").collect()), key=str) == want
    # Most ranges differ: compared as a whole.
    other = source.withColumn("v", F.col("v") + 1)
    assert verify.verify_ranges(source, other, "id", ["v"]).filter("finding = 'mismatch'").count() == 900


def test_route_map_names_every_section(spark):
    sections = spark.createDataFrame([("d", "s0", None, 1, 3), ("d", "s1", "A", 4, 6), ("d", "s2", "B", 10, 5), ("d", "s3", "C", 15, 8)], "doc string, section_id string, heading string, start_line int, line_count int")
    metas = [
        ("d", None, "archive", None, None, None, None, False, 0, 0), ("d", "A", "file", None, "a", "x", "next", False, 0, 0), ("d", "B", "merge", "A", None, None, None, False, 0, 0),
        ("d", "C", "split", None, None, None, None, False, 0, 0), ("d", "C", None, None, "c1", "x", "done", True, 1, 3), ("d", "C", None, None, "c2", "y", "next", True, 4, 8),
    ]
    meta = spark.createDataFrame(metas, "doc string, heading string, disposition string, merge_into string, slug string, area string, status string, is_part boolean, first int, last int")
    routes, errors = ln.route_sections(sections, meta, ["doc"])
    assert errors.count() == 0
    archived = spark.createDataFrame([("d", "s1", 9, 9), ("d", "s3", 18, 22), ("d", "s2", 1, 9)], "doc string, section_id string, first_line long, last_line long")
    got = {tuple(r)[1:] for r in ln.route_map(sections, routes, ["doc"], archived).collect()}
    assert got == {
        ("s0", 1, 3, None, "archive", 1, "retired"), ("s1", 4, 9, "A", "x/a.md", 1, "cut"), ("s2", 10, 14, "B", "x/a.md", 1, "merged"),
        ("s3", 15, 22, "C", None, 2, "split"), ("s3", 15, 17, "C", "done/x/c1.md", 1, ""), ("s3", 18, 22, "C", "y/c2.md", 1, "cut"),
    }
    assert {r["note"] for r in ln.route_map(sections, routes, ["doc"]).collect()} == {"retired", "", "merged", "split"}


def test_a_page_without_bound_is_refused(spark):
    rows = spark.range(MAX_PAGE_SIZE + 1).select(F.format_string("n%05d", "id").alias("name"), F.col("id").cast("double").alias("mtime"))
    payload = ix.feed_payload(rows.limit(MAX_PAGE_SIZE), rows).first()["payload"]
    assert payload.endswith(f'"total":{MAX_PAGE_SIZE + 1}}}') and payload.count('"name"') == MAX_PAGE_SIZE
    with pytest.raises(Exception, match="at most"):
        ix.feed_payload(rows, rows).collect()
    lines = ix.feed_lines(rows)
    assert lines.count() == MAX_PAGE_SIZE + 1 and lines.filter("name = 'n00007'").first()["line"] == '{"name":"n00007","mtime":7.0}'


def test_card_of_odd_rows(spark):
    schema = "id string, category string, width int, height int, prompt_id int, score double, caption string, created_at string, v int, steps int"
    rows = [("a", "x", 8, 8, 1, 1.0, None, "2031-01-02T", 2, 40), ("b", None, 8, 8, None, None, "c", "2031-01-01T", 1, 30), ("c", "x", 16, 8, 1, 3.0, None, None, 2, 41)]
    df = spark.createDataFrame(rows, schema)
    classified = df.select("id", F.lit("kept").alias("class")).unionByName(spark.createDataFrame([("z", "nsfw")], "id string, class string"))
    manifest = spark.createDataFrame([(0, 2**30)], "shard int, bytes long")
    report = curate.build_report(classified, df.select("prompt_id").distinct(), manifest, 0.5)
    facts = {(r["block"], r["label"]): (r["rank"], r["n"], r["m"], r["value"]) for r in card.dataset_card(df, report, F.col("v") == 2, ["steps"], min_seeds=2).collect()}
    assert facts == {
        ("head", "rows"): (1, 3, None, None), ("head", "prompts"): (2, 1, None, None), ("head", "main recipe"): (3, 2, None, None), ("head", "captions"): (4, 1, None, None),
        ("days", "2031-01-01"): (1, None, None, None), ("days", "2031-01-02"): (2, None, None, None), ("seeds", "least"): (1, 2, None, None), ("seeds", "median"): (2, 2, None, None),
        ("seeds", "most"): (3, 2, None, None), ("spread", "prompts"): (1, 1, None, pytest.approx(1.6)), ("category", "x"): (1, 2, 1, 2.0), ("size", "8x8"): (1, 2, None, None),
        ("size", "16x8"): (2, 1, None, None), ("recipe", "steps=40"): (1, 0, None, None), ("files", "shards"): (1, 1, None, 1.0), ("removed", "no_sidecar"): (1, 0, None, None),
        ("removed", "not_scored"): (2, 0, None, None), ("removed", "nsfw"): (3, 1, None, 0.5), ("removed", "manual"): (4, 0, None, None),
    }
    empty = card.dataset_card(df.limit(0), report, F.col("v") == 2, ["steps"])
    assert {r["block"]: r["n"] for r in empty.filter("block IN ('head', 'spread') AND rank = 1").collect()} == {"head": 0, "spread": 0}
