"""Scans, sinks, the build and streams, on files in temporary folders."""

import json
import os
import struct
import subprocess
import sys
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievework import schema as S
from sievework.operators import ids, jobs, publish, scoring
from sievework.session import build_session, shared_folder
from sievework.sources import commits, files, readers, sinks, writers
from sievework.streaming import feeds


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", width, height) + b"\x08\x06\0\0\0" + b"rest"


def test_payload_scan_and_probe(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a b.png": png(640, 70000), "c.png": b"junk", "d.png": png(1, 1)[:32], "e.txt": b"", "sub/f.png": png(2, 2)}.items():
        (tmp_path / name).write_bytes(data)
    listed = readers.scan_payloads(spark, str(tmp_path))
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    assert {r["name"] for r in listed.collect()} == {"a b.png", "c.png", "d.png"}
    probed = {r["stem"]: (r["readable"], r["width"], r["height"]) for r in readers.payload_probe(readers.scan_payloads(spark, str(tmp_path), content=True)).collect()}
    assert probed == {"a b": (True, 640, 70000), "c": (False, None, None), "d": (False, None, None)}


def test_sidecar_policies(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"category": "food", "seed": 5, "freeu": {"b1": 1.5}}, indent=2))
    (tmp_path / "bad.json").write_text('{"category": ')
    (tmp_path / "notes.txt").write_text("{}")
    skip = {r["stem"]: r for r in readers.scan_sidecars(spark, str(tmp_path), "skip").collect()}
    assert set(skip) == {"good", "bad"} and skip["bad"]["broken"] and not skip["good"]["broken"]
    assert skip["good"]["meta"]["freeu"]["b1"] == 1.5 and skip["good"]["meta"]["vae"] is None
    assert readers.scan_sidecars(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception):
        readers.scan_sidecars(spark, str(tmp_path), "fail").collect()


def test_scores_resume(spark, tmp_path):
    path = str(tmp_path / "scores")
    assert readers.scan_scores(spark, path, resume=True).count() == 0
    with pytest.raises(Exception):
        readers.scan_scores(spark, path)
    scores = spark.createDataFrame([("a", 5.0, 0.1)], S.SCORE_SCHEMA)
    writers.append_scores(scores, path)
    writers.append_scores(scores, path)
    assert readers.scan_scores(spark, path).count() == 2


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a b\n\n c\td a e\n")
    assert {r["id"] for r in readers.scan_id_list(spark, str(tmp_path / "ids.txt")).collect()} == set("abcde")


def build_inputs(spark, n=1130):
    names = [f"20260601-{i:06d}_flux_food_x_s{i}" for i in range(n)]
    payloads = spark.createDataFrame([(x, x.encode()) for x in names], "id string, content binary").repartition(7)
    raw = [
        json.dumps({"category": "food", "prompt_subject": f"s{i % 9}", "seed": i, "extra": {"meme": {"top_text": "t"}} if i % 5 == 0 else {}})
        for i in range(n)
    ]
    # The first has no sidecar; a sidecar without payload is ignored.
    sidecars = spark.createDataFrame([*zip(names[1:], raw[1:]), ("lonely", "{}")], "id string, raw string")
    scores = spark.createDataFrame([(x, i / 100, 0.9 if i == 7 else 0.1) for i, x in enumerate(names) if i != 3], S.SCORE_SCHEMA)
    manual = spark.createDataFrame([(names[5],)], "id string")
    return names, payloads, sidecars, scores, manual


def image_table(payloads):
    return payloads.select("id", F.struct(F.col("content").alias("bytes"), F.concat("id", F.lit(".x")).alias("path")).alias("image"))


def test_publish(spark, tmp_path):
    names, payloads, sidecars, scores, manual = build_inputs(spark)
    folder = str(tmp_path / "set")
    manifest = publish.publish(payloads, sidecars, scores, manual, image_table(payloads), folder)
    kept = [x for i, x in enumerate(names) if i not in (0, 3, 5, 7)]
    want = {f"train-0000{i}-of-00003.parquet": len(kept[i * 500 : i * 500 + 500]) for i in range(3)}
    assert {r["shard"]: r["rows"] for r in manifest.collect()} == want
    file_of = {r["shard"]: r["file"] for r in manifest.collect()}
    assert sorted(os.listdir(f"{folder}/data")) == sorted(file_of.values())
    seen = []
    for name in sorted(want):
        shard = pq.ParquetFile(f"{folder}/data/{file_of[name]}")
        assert shard.schema_arrow.equals(writers.shard_schema())
        assert [shard.metadata.row_group(g).num_rows for g in range(shard.num_row_groups)][:-1] == [100] * (shard.num_row_groups - 1)
        assert shard.metadata.row_group(0).column(0).compression == "ZSTD"
        table = shard.read()
        seen += table.column("id").to_pylist()
        assert table.column("image").to_pylist()[0]["bytes"].decode() == table.column("id").to_pylist()[0]
    features = json.loads(shard.metadata.metadata[S.FEATURES_KEY])["info"]["features"]
    assert list(features) == ["image"] + [c[0] for c in S.RECIPE_COLUMNS] and features["seed"]["dtype"] == "int64"
    assert seen == kept
    rows, report = readers.scan_metadata(spark, folder)
    assert sorted(r["id"] for r in rows.select("id").collect()) == kept
    assert rows.columns == [c[0] for c in S.RECIPE_COLUMNS] + ["extra"] and rows.schema["laion_aesthetic"].dataType.simpleString() == "float"
    got = report.first()
    assert (got["rows"], got["prompts"], got["shards"]) == (len(kept), 9, 3)
    assert got["shard_bytes"] == sum(os.path.getsize(f"{folder}/data/{n}") for n in file_of.values())
    assert got["excluded_counts"].asDict() == {"manual": 1, "no_sidecar": 1, "not_scored": 1, "nsfw": 1}
    excluded = {(r["class"], r["id"]) for r in spark.read.parquet(f"{readers.build_folder(folder, commits.current(folder))}/excluded").collect()}
    assert excluded == {("manual", names[5]), ("no_sidecar", names[0]), ("not_scored", names[3]), ("nsfw", names[7])}


def build_rows(spark, folder):
    return sorted((r["id"], r["shard"]) for r in readers.open_build(spark, folder)[0].select("id", "shard").collect())


def test_a_later_build_replaces_an_earlier_one_at_once(spark, tmp_path):
    names, payloads, sidecars, scores, manual = build_inputs(spark)
    folder = str(tmp_path / "set")
    for excluded in (manual, spark.createDataFrame([(x,) for x in names[:700]], "id string"), manual):
        manifest = publish.publish(payloads, sidecars, scores, excluded, image_table(payloads), folder, keep=1)
        named = {r["shard"]: r["rows"] for r in manifest.collect()}
        assert sorted(os.listdir(f"{folder}/data")) == sorted(r["file"] for r in manifest.collect())
        assert len(os.listdir(f"{folder}/builds")) == 1
        back = build_rows(spark, folder)
        left_out = {r["id"] for r in excluded.collect()}
        assert len(back) == sum(named.values()) == len({i for i, _ in back}) and not left_out & {i for i, _ in back}
        assert {s for _, s in back} == set(named)


def test_only_changed_shards_are_written(spark, tmp_path):
    names, payloads, sidecars, scores, manual = build_inputs(spark)
    folder = str(tmp_path / "set")

    def run(side=sidecars, own=payloads, **more):
        manifest = publish.publish(own, side, scores, manual, image_table(own), folder, **more)
        return {r["shard"][6:11]: (r["action"], r["file"]) for r in manifest.collect()}

    def times():
        return {n: os.stat(f"{folder}/data/{n}").st_mtime_ns for n in os.listdir(f"{folder}/data")}

    first, before = run(), times()
    assert {a for a, _ in first.values()} == {"rebuild"}
    # The same inputs in other partitions: nothing is written.
    again = run(sidecars.repartition(3))
    assert {k: f for k, (_, f) in again.items()} == {k: f for k, (_, f) in first.items()}
    assert {a for a, _ in again.values()} == {"reuse"} and times() == before
    # Two rows of the second shard have another sidecar, and one payload of the third another content.
    side = sidecars.withColumn("raw", F.when(F.col("id").isin(names[600], names[700]), F.regexp_replace("raw", '"seed": \\d+', '"seed": 7')).otherwise(F.col("raw")))
    own = payloads.withColumn("content", F.when(F.col("id") == names[1100], F.lit(b"other")).otherwise(F.col("content")))
    assert {k: a for k, (a, _) in run(side).items()} == {"00000": "reuse", "00001": "rebuild", "00002": "reuse"}
    changed = run(side, own)
    assert {k: a for k, (a, _) in changed.items()} == {"00000": "reuse", "00001": "reuse", "00002": "rebuild"}
    now = times()
    assert all(now[n] == before[n] for n in now if n in before) and now[first["00000"][1]] == before[first["00000"][1]]
    seeds = {r["id"]: (r["seed"], bytes(r["image"]["bytes"])) for r in readers.open_build(spark, folder)[0].select("id", "seed", "image").collect()}
    assert seeds[names[600]] == (7, names[600].encode()) and seeds[names[1100]] == (1100, b"other")
    # Without their raw content, payloads are told by the images.
    bare = publish.identified(payloads.select("id"), image_table(payloads))
    assert bare.select("payload").distinct().count() == len(names) and publish.identified(payloads, image_table(payloads)).count() == len(names)
    # Another encoder changes every file.
    assert {a for a, _ in run(side, own, settings="v2").values()} == {"rebuild"}


def test_a_build_that_breaks_off_never_shows_and_is_taken_up(spark, tmp_path):
    names, payloads, sidecars, scores, manual = build_inputs(spark)
    files.write_files(payloads.withColumn("name", F.concat("id", F.lit(".png"))), str(tmp_path / "in"), "name", "content").count()
    found = readers.scan_payloads(spark, str(tmp_path / "in")).withColumnRenamed("stem", "id")
    folder, fault = str(tmp_path / "set"), str(tmp_path / "fault")

    def encoder():
        def encode(data):
            if os.path.exists(fault) and data.decode() == names[700]:
                raise ValueError("broken payload")
            return data.upper()

        return encode

    source = publish.PayloadFiles(str(tmp_path / "in"), encoder, ".up")
    publish.publish(found, sidecars, scores, manual, source, folder)
    whole = build_rows(spark, folder)
    current, listing = commits.current(folder), sorted(os.listdir(f"{folder}/data"))
    side = sidecars.withColumn("raw", F.regexp_replace("raw", '"seed": (\\d+)', '"seed": 1$1'))
    open(fault, "w").close()
    with pytest.raises(Exception, match="broken payload"):
        publish.publish(found, side, scores, manual, source, folder)
    # Readers see the build before; no file is half written.
    assert commits.current(folder) == current and build_rows(spark, folder) == whole
    left = {n: os.stat(f"{folder}/data/{n}").st_mtime_ns for n in os.listdir(f"{folder}/data") if n not in listing}
    assert not [n for n in left if n.endswith(".tmp")] and len(left) < 3
    os.remove(fault)
    manifest = publish.publish(found, side, scores, manual, source, folder, keep=1).collect()
    # What the broken build had finished is not written again, and nothing else is left.
    assert {r["file"] for r in manifest if r["action"] == "reuse"} == set(left)
    assert all(os.stat(f"{folder}/data/{n}").st_mtime_ns == t for n, t in left.items())
    assert sorted(os.listdir(f"{folder}/data")) == sorted(r["file"] for r in manifest)
    seeds = {r["id"]: r["seed"] for r in readers.open_build(spark, folder)[0].select("id", "seed").collect()}
    assert seeds[names[9]] == 19


def test_payload_files_are_read_by_the_shard_writer(spark, tmp_path):
    names, payloads, sidecars, scores, manual = build_inputs(spark, 230)
    files.write_files(payloads.withColumn("name", F.concat("id", F.lit(".png"))), str(tmp_path / "in"), "name", "content").count()
    source = publish.PayloadFiles(str(tmp_path / "in"), lambda: bytes.upper, ".up")
    found = readers.scan_payloads(spark, str(tmp_path / "in")).withColumnRenamed("stem", "id")
    manifest = publish.publish(found, sidecars, scores, manual, source, str(tmp_path / "set")).collect()
    assert [(r["shard"], r["rows"]) for r in manifest] == [("train-00000-of-00001.parquet", 226)]
    cells = pq.read_table(tmp_path / "set/data" / manifest[0]["file"], columns=["id", "image"]).to_pylist()
    assert [c["id"] for c in cells] == [x for i, x in enumerate(names) if i not in (0, 3, 5, 7)]
    assert all(c["image"] == {"bytes": c["id"].upper().encode(), "path": c["id"] + ".up"} for c in cells)


def test_a_build_without_rows(spark, tmp_path):
    names, payloads, sidecars, scores, _ = build_inputs(spark, 20)
    nothing = payloads.select("id")
    folder = str(tmp_path / "set")
    assert publish.publish(payloads, sidecars, scores, nothing, image_table(payloads), folder).count() == 0
    assert build_rows(spark, folder) == [] and readers.scan_metadata(spark, folder)[1].first()["rows"] == 0


def shard_input(spark, n, files_of):
    """Rows 0..n-1 for the shard sink; row i belongs to file i // (n / files_of)."""
    rows = spark.range(n).select(F.format_string("f%02d.parquet", F.floor(F.col("id") / (n // files_of))).alias("file"), F.col("id").alias("pos"), F.col("id").alias("number"))
    filled = [F.lit(None).cast(kind).alias(name) if name != "id" else F.col("number").cast("string").alias("id") for name, kind in S.RECIPE_COLUMNS]
    return rows.select("file", "pos", *filled, F.struct(F.lit(b"x").alias("bytes"), F.lit("p").alias("path")).alias("image"))


def test_attempts_that_fail_after_writing_leave_only_listed_files(tmp_path):
    """A task writes its first shard, dies in its second, and is run again: in a session that retries tasks."""
    script = f"""
import os, sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import functions as F
from sievework.session import build_session
from sievework.sources import sinks
from tests.test_build import shard_input
spark = build_session("retries", master="local[2,3]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path / 'c')!r}}})
flag = {str(tmp_path / 'flag')!r}
class Fails(sinks.ShardFiles):
    def _fill(self, sink, name, batches, encoder):
        rows = super()._fill(sink, name, batches, encoder)
        if name == "f02.parquet" and not os.path.exists(flag):
            open(flag, "w").close()
            raise ValueError("dies after writing")
        return rows
class FailsOnce(sinks.ShardSource):
    def writer(self, schema, overwrite):
        o = self.options
        return Fails(o["path"], o["log"], int(o["rows_per_group"]), None)
rows = shard_input(spark, 60, 6).repartitionById(2, (F.col("pos") / 30).cast("int")).sortWithinPartitions("file", "pos")
sinks.save(rows, FailsOnce, {str(tmp_path / 'data')!r}, {str(tmp_path / 'log')!r}, rows_per_group="4")
assert os.path.exists(flag)
found = {{r["name"]: r["rows"] for r in sinks.written(spark, {str(tmp_path / 'log')!r}).collect()}}
assert found == {{f"f{{i:02d}}.parquet": 10 for i in range(6)}}, found
assert sinks.strangers({str(tmp_path / 'data')!r}, set(found)) == []
assert spark.read.parquet({str(tmp_path / 'data')!r}).count() == 60
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, cwd=os.getcwd())
    assert done.returncode == 0, done.stderr[-3000:]


def test_rows_out_of_order_are_refused_and_leave_no_list(spark, tmp_path):
    rows = shard_input(spark, 20, 2).coalesce(1).orderBy("file", F.desc("pos"))
    with pytest.raises(Exception, match="not in order"):
        sinks.save(rows, sinks.ShardSource, str(tmp_path / "data"), str(tmp_path / "log"), rows_per_group="4")
    assert sinks.strangers(str(tmp_path / "data"), set()) == [] and not os.path.exists(tmp_path / "log/committed.json")


def test_commits_switch_in_one_step(tmp_path):
    folder = str(tmp_path)
    assert commits.current(folder) is None and commits.commits(folder) == []
    assert [commits.commit(folder, n, {"n": n}) for n in ("b", "a", "b", "c")] == [0, 1, 2, 3]
    assert commits.current(folder) == "c" and commits.content(folder, 1, "a") == {"n": "a"}
    assert commits.forget(folder, 2) == ["a"] and commits.commits(folder) == [(2, "b"), (3, "c")]
    # A file that is being written has no number yet.
    (tmp_path / "commits" / "x.tmp").write_text("")
    assert commits.current(folder) == "c"


def test_new_files_stay_and_others_are_replaced(tmp_path):
    path = str(tmp_path / "d/f")
    assert files.put_new(path, lambda sink: sink.write(b"one")) == 3
    assert files.put_new(path, lambda sink: sink.write(b"other")) == 3
    assert open(path, "rb").read() == b"one"
    assert files.put_file(path, lambda sink: sink.write(b"other")) == 5 and open(path, "rb").read() == b"other"

    def fails(sink):
        sink.write(b"half")
        raise ValueError("no")

    with pytest.raises(ValueError):
        files.put_file(path, fails)
    assert open(path, "rb").read() == b"other" and os.listdir(tmp_path / "d") == ["f"]


def test_changed_exclusions_do_not_reuse_shards(spark):
    rows = spark.createDataFrame([(f"i{i:03d}", i) for i in range(40)], "id string, seed int")

    def prints(df, build=""):
        return ids.shard_fingerprints(ids.shard_assign(df, rows_per_shard=10), ["seed"], build=build)

    def actions(wanted, stored):
        return {r["shard"]: r["action"] for r in ids.shard_reuse(wanted, stored).collect()}

    stored = prints(rows)
    assert set(actions(prints(rows.repartition(5)), stored).values()) == {"reuse"}
    # The same number of shards, one id changed in the third.
    swapped = rows.filter("id <> 'i025'").unionByName(spark.createDataFrame([("i0255", 1)], "id string, seed int"))
    assert actions(prints(swapped), stored) == {0: "reuse", 1: "reuse", 2: "rebuild", 3: "reuse"}
    assert actions(prints(rows.filter("id < 'i025'")), stored) == {0: "reuse", 1: "reuse", 2: "rebuild", 3: "drop"}
    changed = rows.withColumn("seed", F.when(F.col("id") == "i000", 99).otherwise(F.col("seed")))
    assert actions(prints(changed), stored)[0] == "rebuild"
    assert set(actions(prints(rows, build="v2"), stored).values()) == {"rebuild"}


def test_sidecar_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "food", None), ("b", None, 3)], "stem string, category string, seed int")
    written = writers.write_sidecars(df, str(tmp_path), "stem", ["category", "seed"]).collect()
    assert {r["name"] for r in written} == {"a.json", "b.json"}
    assert json.loads((tmp_path / "b.json").read_text()) == {"category": None, "seed": 3}
    back = {r["stem"]: r["meta"]["seed"] for r in readers.scan_sidecars(spark, str(tmp_path)).collect()}
    assert back == {"a": None, "b": 3}


def test_scoring_splits_unreadable_payloads(spark):
    def make():
        return lambda batch: [None if b == b"bad" else (len(b) / 3, 0.123456) for b in batch]

    df = spark.createDataFrame([("a", b"xy"), ("b", b"bad"), ("c", b"")], "id string, content binary")
    good, bad = scoring.split_scored(scoring.batch_score(df, make, batch_size=2))
    assert {(r["id"], r["laion_aesthetic"], r["nsfw_prob"]) for r in good.collect()} == {("a", 0.6667, 0.12346), ("c", 0.0, 0.12346)}
    assert [r["id"] for r in bad.collect()] == ["b"]


def finish(query):
    query.awaitTermination(120)
    query.stop()


def test_feed_delivers_each_record_once(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([("a", 1.0)], "name string, mtime double").schema
    for rows in ([("a", 1.0), ("b", 3.0)], [("c", 2.0)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        finish(feeds.stream_feed(feeds.record_stream(spark, source, schema), sink, log, poll_seconds=None))
    assert sorted(r["name"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_high_water_never_delivers_late_rows(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([("a", 1.0)], "name string, mtime double").schema
    for rows in ([("a", 1.0), ("b", 3.0)], [("c", 2.0), ("d", 3.0)], [("e", 4.0), ("f", 2.5)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        finish(feeds.stream_high_water(feeds.record_stream(spark, source, schema), sink, log, poll_seconds=None))
    assert sorted(r["name"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "e"]


def test_scores_are_not_made_twice(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([("a", b"x")], "id string, content binary").schema
    for rows in ([("a", b"1"), ("b", b"2"), ("a", b"1")], [("b", b"other"), ("c", b"3")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        records = feeds.record_stream(spark, source, schema)
        finish(feeds.score_new(records, lambda df: df.select("id", F.length("content").alias("n")), sink, log, poll_seconds=None))
    assert sorted((r["id"], r["n"]) for r in spark.read.parquet(sink).collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_scoring_a_batch_costs_what_the_batch_holds(spark, tmp_path):
    """Every batch reads its own rows only, and the state says which ids it has added; one id comes very often."""
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([("a", b"x")], "id string, content binary").schema
    read, added, calls = [], [], spark.sparkContext.accumulator(0)

    def scored(df):
        def run(batches):
            for batch in batches:
                calls.add(batch.num_rows)
                yield batch.select(["id"])

        return df.mapInArrow(run, "id string")

    for n in range(4):
        fresh = [(f"{n}-{i}", b"1") for i in range(50)]
        rows = spark.createDataFrame(fresh + [("hot", b"2")] * 500 + [("0-1", b"3")], schema)
        rows.write.mode("append").parquet(source)
        query = feeds.score_new(feeds.record_stream(spark, source, schema), scored, sink, log, poll_seconds=None)
        finish(query)
        done = [p for p in query.recentProgress if p["numInputRows"]]
        read.append(sum(p["numInputRows"] for p in done))
        added.append(sum(o["numRowsUpdated"] for p in done for o in p["stateOperators"]))
        assert all(d["description"].startswith("FileStreamSource") for p in done for d in p["sources"])
    assert read == [551] * 4 and added == [51, 50, 50, 50]
    ids_scored = [r["id"] for r in spark.read.parquet(sink).collect()]
    assert len(ids_scored) == len(set(ids_scored)) == calls.value == 201
    # Before the shuffle a task leaves out what it has just seen.
    assert feeds.first_of_task(spark.createDataFrame([("hot", b"")] * 900, schema).coalesce(2), "id").count() <= 2


def test_every_feed_has_a_mark_of_its_own(spark, tmp_path):
    schema = "name string, feed string, mtime double"
    slices = [
        [("a1", "a", 5.0), ("b1", "b", 50.0), ("n1", None, 1.0), ("x", "a", None)],
        # Late in its feed, though above the other's mark, and the other way round.
        [("a2", "a", 4.0), ("a3", "a", 6.0), ("b2", "b", 40.0), ("b3", "b", 51.0), ("a4", "a", 5.0), ("n2", None, 1.0), ("n3", None, 2.0), ("c1", "c", 0.5)],
        [("a5", "a", 5.5), ("a6", "a", 6.5), ("b4", "b", 50.5), ("y", "b", None), ("c2", "c", 0.25)],
    ]
    late = {"a2", "b2", "a4", "n2", "a5", "b4", "y", "c2"}
    for strict in (True, False):
        source, sink, log = (str(tmp_path / f"{n}-{strict}") for n in ("in", "out", "log"))
        for rows in slices:
            df = spark.createDataFrame(rows, schema)
            df.write.mode("append").parquet(source)
            # Each slice is read by a new query: the marks come from the checkpoint.
            finish(feeds.stream_high_water(feeds.record_stream(spark, source, df.schema), sink, log, poll_seconds=None, feed="feed", strict=strict))
        got = spark.read.parquet(sink)
        if strict:
            assert sorted(r["name"] for r in got.collect()) == sorted(r[0] for s in slices for r in s if r[0] not in late)
        else:
            assert {r["name"]: r["late"] for r in got.collect()} == {r[0]: r[0] in late for s in slices for r in s}


def test_one_mark_with_late_rows(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([("a", 1.0)], "name string, mtime double").schema
    for rows in ([("a", 1.0), ("b", 3.0)], [("c", 2.0), ("d", 4.0), ("n", None)], [("e", 5.0), ("f", 3.5)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        finish(feeds.stream_high_water(feeds.record_stream(spark, source, schema), sink, log, poll_seconds=None, strict=False))
    assert {r["name"]: r["late"] for r in spark.read.parquet(sink).collect()} == {"a": False, "b": False, "c": True, "d": False, "n": True, "e": False, "f": True}


def test_endless_source_goes_on_where_it_stopped(spark, tmp_path):
    sink, log = str(tmp_path / "out"), str(tmp_path / "log")

    def start(end):
        indexes = jobs.index_source(spark, start=7, end=end, per_trigger=9, partitions=2)
        return feeds.stream_append(indexes, lambda df: df, sink, log, poll_seconds=0)

    for _ in range(2):
        query = start(None)
        while sum(p["numInputRows"] for p in query.recentProgress) < 18:
            assert query.exception() is None
            query.awaitTermination(0.1)
        query.stop()
    reached = max(r["index"] for r in spark.read.parquet(sink).collect())
    end = reached + 31
    query = start(end)
    query.processAllAvailable()
    query.stop()
    assert sorted(r["index"] for r in spark.read.parquet(sink).collect()) == list(range(7, end))


def test_totals_are_whole_at_any_time(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = spark.createDataFrame([("a",)], "cat string").schema
    want, held = Counter(), []
    for n in range(2 * feeds.DELTAS + 4):
        rows = ["a", None, f"c{n % 5}"]
        want.update(rows)
        spark.createDataFrame([(r,) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        finish(feeds.stream_totals(feeds.record_stream(spark, source, schema), ["cat"], sink, log, poll_seconds=None))
        assert {r["cat"]: r["n"] for r in feeds.totals_of(spark, sink).collect()} == dict(want)
        # A table that a reader has opened stays as it was while the next ones are made.
        held.append((feeds.totals_of(spark, sink), dict(want)))
        for table, then in held[-3:]:
            assert {r["cat"]: r["n"] for r in table.collect()} == then
    # Half a batch without its commit does not show.
    spark.createDataFrame([("a", 999, 10**6)], "cat string, n bigint, batch bigint").write.parquet(f"{sink}/table-999-x")
    assert {r["cat"]: r["n"] for r in feeds.totals_of(spark, sink).collect()} == dict(want)
    assert len(commits.commits(sink)) <= 3 * feeds.DELTAS and len(os.listdir(sink)) <= 3 * feeds.DELTAS + 3


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert build_session() is not None


def test_write_files_in_subfolders(spark, tmp_path):
    df = spark.createDataFrame([("a/b/c.txt", "x")], "name string, t string")
    assert files.write_files(df, str(tmp_path), "name", "t").collect()[0]["bytes"] == 1
    assert (tmp_path / "a/b/c.txt").read_text() == "x" and os.listdir(tmp_path / "a/b") == ["c.txt"]
