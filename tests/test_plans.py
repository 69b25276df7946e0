"""What the plans must and must not hold, so that they keep working at scale."""

import re

import pytest
from pyspark.sql import functions as F

from sievework.operators import curate, ids, index, sample, stats
from sievework.plans import QUERIES
from sievework.plans.registry import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(QUERIES["category_counts"](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all(s == "event_type:string" for s in schemas)


def test_filters_reach_the_scan(events):
    assert "GreaterThan(value,6.5)" in plan(events.select("event_id", "value").filter("value > 6.5"))


def test_pages_are_top_k(events):
    idx = events.select(F.col("event_id").cast("string").alias("name"), F.col("value").alias("mtime"))
    assert "TakeOrderedAndProject" in plan(index.keyset_page(idx, before=9.0))
    assert "TakeOrderedAndProject" in plan(index.initial_page(idx))


def test_ranked_filters_cut_groups_before_the_shuffle(events):
    best = plan(sample.best_per_group(events.withColumnRenamed("event_id", "id"), "event_type", "value"))
    assert best.count("WindowGroupLimit") == 2
    capped = plan(ids.run_cap(events, "event_id", "value", subject="user_id", per_subject=40))
    assert capped.count("WindowGroupLimit") == 2


def test_order_is_spread_over_partitions(spark, events, monkeypatch):
    """No global rank runs over the rows: only one row per partition is summed in one task."""
    from sievework.operators import ordering

    monkeypatch.setattr(ordering, "freeze", lambda df: df)
    text = plan(ordering.ordered_positions(events.select("event_id"), ["event_id"]))
    assert "rangepartitioning(event_id" in text
    single = text.split("Exchange SinglePartition")[1]
    assert "HashAggregate" in single and "row_number" not in text


def test_quantiles_count_before_they_order(events):
    text = plan(stats.seed_spread(events, "user_id", "value"))
    assert "partial_count" in text and "percentile" not in text
    # Counted values are range-sorted and summed per partition, never per key.
    assert "Window" not in text or not re.findall(r"Window \[[^\n]*\], \[user_id", text)


def test_no_query_pairs_rows_without_a_key(spark, sf_dir):
    for name in ("weighted_draw", "plan_jobs", "era_asof", "range_coverage", "route_sections", "exclusion_class", "totals"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_expression_operators_do_not_shuffle(spark, sf_dir):
    for name in ("slugify", "parse_artifact_name", "era_asof", "attribution_fill", "model_attribution", "front_matter",
                 "split_sections", "section_digest", "validate_records", "linear_head", "l2_normalize", "softmax_prob",
                 "seed_schedule", "escape_text", "payload_probe"):
        assert "Exchange" not in plan(QUERIES[name](spark, sf_dir)), name


def test_counts_need_one_small_shuffle(spark, sf_dir):
    text = plan(curate.counts_with_zeros(table(spark, sf_dir, "events"), "event_type", ["view", "none"]))
    assert text.count("Exchange") == 1 and "partial_count_if" in text or "partial_count" in text
