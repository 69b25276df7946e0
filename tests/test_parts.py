"""Tables that are folders of part files, as larger ones are."""

import os

import pytest

from sievework.plans import QUERIES

from .oracle import bag


@pytest.mark.parametrize("name, read", [("stream_score", "embeddings"), ("stream_feed", "events"), ("stream_jobs", "orders")])
def test_streams_read_folders_of_parts(spark, sf_dir, tmp_path, name, read):
    for file in os.listdir(sf_dir):
        if file != f"{read}.parquet":
            os.symlink(f"{sf_dir}/{file}", tmp_path / file)
    spark.read.parquet(f"{sf_dir}/{read}.parquet").repartition(3).write.parquet(str(tmp_path / f"{read}.parquet"))
    whole, parts = QUERIES[name](spark, sf_dir), QUERIES[name](spark, str(tmp_path))
    assert parts.count() > 0
    assert bag(parts.columns, parts.collect()) == bag(whole.columns, whole.collect())
