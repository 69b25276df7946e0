"""Groups that hold a third of the rows, ties and missing values, against brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import ids, lines, ordering, records, sample, stats
from sievework.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows; key `hot` holds a third of them, half of these with one score."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(200)}"
        score = 5.0 if key == "hot" and rng.random() < 0.5 else rng.choice([None, round(rng.uniform(-9, 900), 3)])
        rows.append((f"id{i:05d}", key, score))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id string, key string, score double").repartition(16)


def by_key(rows):
    out = {}
    for i, key, score in rows:
        out.setdefault(key, []).append((score, i))
    return out


def test_ordered_positions(skewed):
    rows, df = skewed
    got = {r["id"]: r["pos"] for r in ordering.ordered_positions(df.select("id"), ["id"]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(r[0] for r in rows))}


def test_positions_within(skewed):
    rows, df = skewed
    placed = ordering.positions_within(df, ["key"], [F.col("score").asc_nulls_last(), F.col("id")], "rank", size="n")
    got = {r["id"]: (r["rank"], r["n"]) for r in placed.collect()}
    for group in by_key(rows).values():
        ordered = sorted(group, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        for n, (_, i) in enumerate(ordered):
            assert got[i] == (n, len(group))


def test_positions_within_null_key(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "id string, key string")
    got = {r["id"]: r["p"] for r in ordering.positions_within(df, ["key"], ["id"], "p").collect()}
    assert got == {"a": 0, "b": 1, "c": 0}


def test_running_sums(skewed):
    rows, df = skewed
    summed = ordering.running_sums(df, ["id"], {"n": F.lit(1), "s": F.length("key")}).collect()
    total = 0
    for n, r in enumerate(sorted(summed, key=lambda r: r["id"]), 1):
        total += len(r["key"])
        assert (r["n"], r["s"]) == (n, total)


def test_exact_quantiles(skewed):
    rows, df = skewed
    got = {r["key"]: r for r in exact_quantiles(df, ["key"], "score", {"a": 0.1, "b": 0.5, "c": 0.9}).collect()}
    for key, group in by_key(rows).items():
        values = [s for s, _ in group if s is not None]
        if not values:
            assert key not in got
            continue
        want = np.quantile(values, [0.1, 0.5, 0.9])
        assert np.allclose([got[key]["a"], got[key]["b"], got[key]["c"]], want, atol=1e-9)


def test_quantiles_skip_nan_and_null_and_order_extremes(spark):
    values = [None, float("nan"), -1e300, -2.5, -0.0, 0.0, 1e-310, 7.0, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(df, [], "v", {"q0": 0.0, "q5": 0.5, "q1": 1.0}).first()
    known = sorted(v for v in values if v is not None and v == v)
    assert row["q0"] == known[0] and row["q1"] == known[-1]
    assert row["q5"] == statistics.median(known)


def test_values_that_lie_close_together_are_spread(spark):
    """Microsecond times of one hot key, all within a day: the counted values are sorted in many tasks."""
    rows = spark.range(40_000).select(F.lit("k").alias("k"), (F.col("id") * 2_000_000 + 1_704_067_200_000_000).cast("double").alias("v"))
    counted = rows.groupBy("k", "v").agg(F.count("*").alias("c"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in ordering.running_sums(counted, ["k", "v"], {"end": F.col("c")}).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 4 and max(sizes) < 20_000
        got = exact_quantiles(rows, ["k"], "v", {"m": 0.5}).first()["m"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == 1_704_067_200_000_000 + 2_000_000 * 19_999.5


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(df, ["k"], "v", {"m": 0.5}).count() == 0


def test_even_sample_of_hot_and_short_groups(skewed, spark):
    rows, df = skewed
    got = {}
    for r in sample.even_sample(df, ["key"], "score").collect():
        got.setdefault(r["key"], {})[r["slot"]] = r["id"]
    for key, group in by_key(rows).items():
        ordered = sorted(group, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        want = {i: ordered[round(i * (len(ordered) - 1) / 7)][1] for i in range(8)}
        assert got[key] == want
    three = spark.createDataFrame([("a", "g", 1.0), ("b", "g", 2.0), ("c", "g", 3.0)], "id string, key string, score double")
    assert sample.even_sample(three, ["key"], "score").count() == 8
    # Half positions go to the even rank.
    halves = sample.even_sample(three, ["key"], "score", k=5).orderBy("slot")
    assert [r["rank"] for r in halves.collect()] == [round(i * 2 / 4) for i in range(5)]


def test_best_per_group_ties_nulls_and_null_group(spark):
    rows = [("b", "g", 2.0), ("a", "g", 2.0), ("c", "g", None), ("d", "h", float("nan")), ("e", "h", 1.0), ("f", None, 9.0)]
    df = spark.createDataFrame(rows, "id string, key string, score double")
    assert {(r["key"], r["id"]) for r in sample.best_per_group(df, "key", "score").collect()} == {("g", "a"), ("h", "e")}


@pytest.mark.parametrize("n_picks", [1, 3, 4, 5])
def test_fill_top_k_completes_the_row(spark, n_picks):
    rows = [(f"i{i}", float(i % 7)) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, score double")
    picks = df.orderBy("id").limit(n_picks)
    chosen = {r["id"] for r in picks.collect()}
    want = sorted((r for r in rows if r[0] not in chosen), key=lambda r: (-r[1], r[0]))[: -n_picks % 4]
    assert [r["id"] for r in sample.fill_top_k(df, picks, "score").orderBy(F.desc("score"), "id").collect()] == [w[0] for w in want]


def test_multiset_gain_with_a_frequent_line(spark):
    rng = random.Random(3)
    new = [(d, n, "common" if rng.random() < 0.4 else f"l{rng.randrange(50)}") for d in range(40) for n in range(1, 40)]
    base = [("common", 300), *[(f"l{i}", i) for i in range(0, 50, 2)], ("unused", 9)]
    got = lines.multiset_gain(
        spark.createDataFrame(new, "doc int, n int, line string").repartition(9),
        spark.createDataFrame(base, "line string, n bigint"), ["doc", "n"],
    )
    left, want = dict(base), set()
    for d, n, line in new:
        if left.get(line, 0) > 0:
            left[line] -= 1
        else:
            want.add((d, n, line))
    assert {tuple(r) for r in got.collect()} == want


def test_duplicate_keys_of_a_hot_slug(spark):
    rows = [(f"p{i:04d}", "hot" if i % 3 == 0 else f"s{i // 2}") for i in range(900)]
    got = {tuple(r) for r in records.duplicate_keys(spark.createDataFrame(rows, "path string, slug string")).collect()}
    seen, want = {}, set()
    for path, slug in rows:
        if slug in seen:
            want.add((path, slug, seen[slug]))
        seen[slug] = path
    assert got == want


def test_dense_prompt_id(spark):
    df = spark.createDataFrame([(s,) for s in ["b", "a", "é", "b", "Z", "a"]], "prompt_subject string")
    got = {r["prompt_subject"]: r["prompt_id"] for r in ids.dense_prompt_id(df).collect()}
    assert got == {s: i for i, s in enumerate(sorted({"b", "a", "é", "Z"}))}
    with pytest.raises(Exception):
        ids.dense_prompt_id(spark.createDataFrame([(None,)], "prompt_subject string")).collect()


def test_sweep_prompt(spark):
    df = spark.createDataFrame([(p, float(i * (p + 1))) for p in range(3) for i in range(30)], "prompt_id int, score double")
    spread = stats.seed_spread(df)
    assert stats.sweep_prompt(spread, min_n=31).count() == 0
    assert stats.sweep_prompt(spread, min_n=30).first()["prompt_id"] == 2
    assert stats.sweep_prompt(spread, explicit=1).first()["prompt_id"] == 1
