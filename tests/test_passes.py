"""How often, and in how many tasks, queries read and parse their rows."""

from sievework.plans import QUERIES

from .test_plans import plan


def test_card_reads_written_rows(spark, sf_dir):
    # Classes and kept rows are written once; no block of the card goes back to the table.
    assert "FileScan" not in plan(QUERIES["dataset_card_facts"](spark, sf_dir))


def test_records_are_dealt_out_before_they_are_parsed(spark, sf_dir):
    for name in ("misfiled_records", "validate_records"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "hashpartitioning(o_orderkey" in text.split("MapInArrow")[-1], name


def test_sidecar_files_are_opened_once(spark, sf_dir):
    # What is left to scan are the files of the second folder.
    assert plan(QUERIES["open_extra"](spark, sf_dir)).count("FileScan text") == 1


def test_a_second_build_plans_once(spark, sf_dir, monkeypatch):
    from sievework.operators import publish

    planned, plan_build = [], publish.plan_build
    monkeypatch.setattr(publish, "plan_build", lambda *args, **more: planned.append(1) or plan_build(*args, **more))
    QUERIES["publish_again"](spark, sf_dir)
    assert len(planned) == 2
