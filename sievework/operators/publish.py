"""The main job: payloads, sidecars and scores to shards, metadata and a report.

A build is incremental and shows at once or not at all. A shard's file is named by its fingerprint:
the ordered ids, all row values, what identifies the payloads, and the writer's settings. A shard
whose file is there already, from an earlier build or from one that broke off, is not written again.
Each build has a folder of its own for its metadata, report and manifest (shard, fingerprint, file),
and becomes the current one by a commit, its last step. Readers go through the commit
(`sources.readers.open_build`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from sievework import schema as S
from sievework.operators.curate import build_report, exclusion_class, flatten_recipe
from sievework.operators.ids import dense_prompt_id, prompt_id_join, shard_assign, shard_fingerprints
from sievework.operators.ordering import ordered_positions
from sievework.session import freeze
from sievework.sources import commits
from sievework.sources.files import remove_folder
from sievework.sources.readers import MANIFEST, build_folder, parse_sidecars, stored_files
from sievework.sources.sinks import ShardSource, packed, save
from sievework.sources.writers import remove_files, shard_name, write_metadata, write_report


# Shards that a task writes one after the other, once there are several for each core.
SHARDS_PER_TASK, TASKS_PER_CORE = 16, 4


@dataclass
class PayloadFiles:
    """Payloads as `<id>.png` in a shared folder, with the encoder to apply."""

    folder: str
    make_encoder: Callable[[], Callable[[bytes], bytes]]
    suffix: str


@dataclass
class Build:
    classified: DataFrame
    prompt_ids: DataFrame
    rows: DataFrame
    placed: DataFrame


def plan_build(
    payloads: DataFrame,
    sidecars: DataFrame,
    scores: DataFrame,
    manual: DataFrame,
    threshold: float = 0.5,
    rows_per_shard: int = S.ROWS_PER_SHARD,
) -> Build:
    """payloads (id), sidecars (id, raw), scores, manual (id) -> the rows to publish.

    Classes are decided on ids and scores only; JSON is parsed for kept rows only. What several
    later steps read is written once, and only ids are put in order.
    """
    classified = freeze(exclusion_class(payloads.select("id"), sidecars, scores, manual, threshold))
    kept = classified.filter(F.col("class") == "kept").drop("class")
    parsed = parse_sidecars(kept.join(sidecars, "id"), policy="fail").drop("raw")
    parsed = freeze(parsed.withColumn("prompt_subject", F.col("meta.prompt_subject")))
    prompt_ids = dense_prompt_id(parsed)
    rows = flatten_recipe(prompt_id_join(parsed, prompt_ids), keep_extra=True)
    return Build(classified, prompt_ids, rows, shard_assign(kept.select("id"), rows_per_shard=rows_per_shard))


def identified(payloads: DataFrame, images: DataFrame | PayloadFiles) -> DataFrame:
    """(id, payload): what tells whether a payload is the same as in an earlier build.

    For files their length and time of change, as far as `payloads` has them; for tables the digest
    of `content`, the payload before it is encoded, or of the image itself where there is none.
    """
    if isinstance(images, PayloadFiles):
        known = [F.col(c).cast("string") for c in ("length", "mtime") if c in payloads.columns]
        return payloads.select("id", F.concat_ws(" ", *known).alias("payload"))
    if "content" in payloads.columns:
        return payloads.select("id", F.md5("content").alias("payload"))
    return images.select("id", F.concat_ws(" ", F.md5("image.bytes"), "image.path").alias("payload"))


def writing_tasks(shards: int, cores: int) -> int:
    """Into how many tasks the shards to be written are dealt.

    A task for each would have Spark start more tasks than it has files to write at once, and fetch
    blocks that grow with the square of the build: every task from every one before it.
    """
    return min(shards, max(TASKS_PER_CORE * cores, -(-shards // SHARDS_PER_TASK)))


def wanted_shards(build: Build, payloads: DataFrame, settings: str) -> DataFrame:
    """(shard, rows, fingerprint, file) of every shard of the build, by number."""
    columns = [name for name, _ in S.RECIPE_COLUMNS if name != "id"]
    rows = build.rows.join(build.placed.select("id", "pos", "shard"), "id").join(payloads, "id")
    prints = shard_fingerprints(rows, [*columns, "payload"], build=settings)
    return prints.withColumn("file", F.concat("fingerprint", F.lit(".parquet")))


def shard_actions(wanted: DataFrame, stored: DataFrame, before: DataFrame) -> DataFrame:
    """(shard, rows, fingerprint, file, action) of the shards of this build and of those it gives up.

    `stored` has the files that are there, `before` the manifest of the build before. `reuse` takes
    a file that is there, `rebuild` writes it, and `drop` is a shard of the build before that this
    one has no more.
    """
    there = stored.select("file", F.lit(True).alias("there")).distinct()
    kept = wanted.join(there, "file", "left").select(
        "shard", "rows", "fingerprint", "file", F.when(F.col("there"), "reuse").otherwise("rebuild").alias("action")
    )
    gone = before.join(wanted.select("shard"), "shard", "left_anti")
    return kept.unionByName(gone.select("shard", "rows", "fingerprint", "file", F.lit("drop").alias("action")))


def publish(
    payloads: DataFrame,
    sidecars: DataFrame,
    scores: DataFrame,
    manual: DataFrame,
    images: DataFrame | PayloadFiles,
    folder: str,
    threshold: float = 0.5,
    settings: str = "",
    keep: int = 2,
) -> DataFrame:
    """Makes a build below `folder` the current one; returns its manifest.

    The manifest has (shard, rows, bytes, fingerprint, file, action): the shard's published name, its
    file in `data/`, and whether it was written (`rebuild`) or found (`reuse`). `images` is a table
    (id, image), whose bytes are shuffled to their shards, or a `PayloadFiles`, whose files are read
    by the task that writes the shard; only rows of shards to be written are moved. `payloads` may
    have what identifies them (see `identified`); with `content` the images are made from it, and
    only those of shards to be written are. `settings` names what else the files depend on (the
    encoder and its options): another name rebuilds all.
    The `keep` newest builds stay readable; files that only older ones want are removed.
    """
    spark, name = payloads.sparkSession, uuid.uuid4().hex
    own, data = build_folder(folder, name), f"{folder}/data"
    build = plan_build(payloads, sidecars, scores, manual, threshold)
    write_metadata(build.rows, f"{own}/metadata")
    # The shards read what was just written, so ids are joined and recipes flattened once. The open
    # map stays with the metadata: shard files have a fixed schema.
    build = replace(build, rows=spark.read.parquet(f"{own}/metadata").drop("extra"))
    suffix = images.suffix if isinstance(images, PayloadFiles) else ""
    written_by = f"{settings}\n{suffix}\n{S.ROWS_PER_GROUP}\nzstd"
    wanted = freeze(wanted_shards(build, identified(payloads, images), written_by))
    before = commits.current(folder)
    old = spark.createDataFrame([], MANIFEST) if before is None else spark.read.parquet(f"{build_folder(folder, before)}/manifest")
    shard_actions(wanted, stored_files(wanted, data), old).write.parquet(f"{own}/actions")
    actions = spark.read.parquet(f"{own}/actions")
    todo = ordered_positions(actions.filter("action = 'rebuild'").select("shard", "file"), ["shard"], "place")
    shards = todo.count()
    if shards:
        tasks = writing_tasks(shards, spark.sparkContext.defaultParallelism)
        todo = todo.withColumn("task", F.col("place") % tasks).drop("place")
        rows = build.rows.join(build.placed.select("id", "pos", "shard"), "id").join(todo, "shard")
        rows = rows if isinstance(images, PayloadFiles) else rows.join(images.select("id", "image"), "id")
        # The tasks are numbered without gaps and differ by a shard at most.
        dealt = rows.repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("file", "pos").drop("task", "shard")
        options = {"payloads": packed((images.folder, images.make_encoder, images.suffix))} if isinstance(images, PayloadFiles) else {}
        save(dealt, ShardSource, data, f"{own}/written", rows_per_group=str(S.ROWS_PER_GROUP), **options)
    total = wanted.agg(F.count("*").alias("n")).scalar()
    kept = actions.filter("action <> 'drop'")
    missing = F.raise_error(F.concat(F.lit("no file for shard "), F.col("shard").cast("string"))).cast("bigint")
    sized = kept.join(stored_files(kept, data), "file", "left").withColumn("bytes", F.coalesce("bytes", missing))
    named = shard_name(F.col("shard"), total).alias("name")
    sized.select("shard", named, "rows", "bytes", "fingerprint", "file", "action").write.parquet(f"{own}/manifest")
    manifest = spark.read.parquet(f"{own}/manifest")
    report = build_report(build.classified, build.prompt_ids, manifest, threshold)
    excluded = build.classified.filter(F.col("class") != "kept").select("class", "id")
    write_report(report, excluded, own)
    commits.commit(folder, name)
    clean(spark, folder, keep)
    return manifest.select(F.col("name").alias("shard"), "rows", "bytes", "fingerprint", "file", "action")


def clean(spark, folder: str, keep: int = 2) -> DataFrame | None:
    """Forgets all builds but the newest `keep` and removes the shard files that only they want.

    Files that no build wants, such as those of builds that broke off, go too. Not for a folder that
    another build is being made in. Returns the removed names.
    """
    forgotten = commits.forget(folder, keep)
    kept = [f"{build_folder(folder, name)}/manifest" for _, name in commits.commits(folder)]
    if not kept:
        return None
    removed = remove_files(spark, f"{folder}/data", spark.read.schema(MANIFEST).parquet(*kept).select("file").distinct())
    for name in forgotten:
        remove_folder(build_folder(folder, name))
    return removed
