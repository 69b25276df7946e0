"""Builds of many shards: how many tasks write them, and that several from one task come out right."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievework.operators import publish
from sievework.sources import readers, sinks

from .test_build import build_inputs, image_table


def test_tasks_grow_slower_than_shards():
    assert publish.writing_tasks(3, 12) == 3
    assert publish.writing_tasks(48, 12) == publish.writing_tasks(700, 12) == 48
    assert publish.writing_tasks(43_000, 12) == 2_688


@pytest.mark.parametrize("files", [False, True])
def test_a_task_writes_several_shards(spark, tmp_path, monkeypatch, files):
    dealt = []

    def saved(rows, *args, **options):
        dealt.append(rows.rdd.getNumPartitions())
        sinks.save(rows, *args, **options)

    monkeypatch.setattr(publish, "TASKS_PER_CORE", 0)
    monkeypatch.setattr(publish, "save", saved)
    names, payloads, sidecars, scores, manual = build_inputs(spark)
    if files:
        os.makedirs(tmp_path / "in")
        for name in names:
            (tmp_path / "in" / f"{name}.png").write_bytes(name.encode())
    images = publish.PayloadFiles(str(tmp_path / "in"), lambda: bytes, ".x") if files else image_table(payloads)
    manifest = publish.publish(payloads, sidecars, scores, manual, images, str(tmp_path / "set")).collect()
    # Three shards in one task, each in its own file and order.
    assert dealt == [1] and sorted((r["rows"], r["action"]) for r in manifest) == [(126, "rebuild"), (500, "rebuild"), (500, "rebuild")]
    seen = []
    for r in sorted(manifest, key=lambda r: r["shard"]):
        shard = pq.read_table(f"{tmp_path}/set/data/{r['file']}")
        assert [x["bytes"].decode() for x in shard.column("image").to_pylist()] == shard.column("id").to_pylist()
        seen += shard.column("id").to_pylist()
    assert seen == [x for i, x in enumerate(names) if i not in (0, 3, 5, 7)]
