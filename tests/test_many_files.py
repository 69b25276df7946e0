"""Clustered tables of many files: few tasks write them, and each file still has its span of keys."""

from pyspark.sql import functions as F

from sievework.operators import index as ix, pages
from sievework.sources import clustered

from .test_kept import kept, same


def test_tasks_grow_slower_than_files():
    assert clustered.writing_tasks(5, 12) == 5
    assert clustered.writing_tasks(1_000, 12) == 48
    assert clustered.writing_tasks(72_000, 12) == 1_125


def test_a_task_writes_several_files(spark, tmp_path, monkeypatch):
    asked, ranged = [], type(spark.range(0)).repartitionByRange
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda df, n, *order: asked.append(n) or ranged(df, n, *order))
    monkeypatch.setattr(clustered, "TASKS_PER_CORE", 0)
    rows, folder = kept(spark, tmp_path)
    assert asked == [1, 1]
    files = clustered.catalogue(spark, folder).collect()
    assert len(files) == 30 and {f["rows"] for f in files} == {100} and sum(f["rows"] for f in files) == rows.count()
    for run in {f["file"].split("/")[0] for f in files}:
        spans = sorted((f["low"], f["high"]) for f in files if f["file"].startswith(run) and f["low"] is not None)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for before, limit, name in [(0, 200, None), (50, 20, "n01000"), ("200", 1, None)]:
        assert same(ix.keyset_page(rows, before, limit, name).select("name", "mtime"), pages.open_page(spark, folder, before, limit, name))
    assert len(pages.open_since(spark, folder, 390).inputFiles()) <= 4
    assert pages.index_size(spark, folder).first()["total"] == rows.agg(F.count("*")).first()[0]
