"""WARC archives: records written with an index, read back by coalesced byte ranges.

Every record is one gzip member, so any record can be read alone by offset and length. The writer
returns one index row per record (file, offset, length, URL, digest, ...), which is stored first;
readers take the rows they want from it, sort them by place, merge neighbouring ranges into one
read, and check each payload against its digest.

A payload that is stored already becomes a revisit record that names the record which holds it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import slices
from sievework.session import freeze, work_path
from sievework.sources.files import open_folder

LEAST = 1000
ARCHIVE_BYTES = 1 << 28
GAP = 1 << 16
RANGE = 1 << 23
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

# Archive bytes that a reading task is given.
TASK_BYTES = 16 << 20
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
READ = "page_id bigint, url string, record_type string, refers_id bigint, payload_bytes bigint, digest string"


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to): refers_to is null for records that keep their payload.

    Of equal payloads of at least `least` bytes the largest page_id keeps it. Digests are compared,
    not payloads; only digests that occur more than once meet the pages again.
    """
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"),
        F.coalesce(pages["html"].cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= least)
    keeper = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = rows.join(keeper, "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper")), F.col("keeper"))
    return shared.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """The bytes of one record; line breaks in the URL are escaped."""
    head = HTTP.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    labelled = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", labelled),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to, digest)),
        ("Page-Id", page_id),
        ("Refers-To-Page-Id", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first.encode() != VERSION:
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    return fields, block.partition(b"\r\n\r\n")[2]


def write(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Writes the records below `folder` and returns their index, lazily; store the index to write them.

    Each task writes files of its own, whose names no other attempt uses. A repeated or lost attempt
    leaves files that no index row names.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        sink, name, at = None, "", 0
        for part in slices(batches):
            out = []
            for row in part.to_pylist():
                if sink is None or at >= archive_bytes:
                    if sink is not None:
                        sink.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                refers = row["refers_to"]
                data = gzip.compress(record(row["page_id"], row["url"], row["payload"], row["digest"], refers, date), 6, mtime=0)
                sink.write(data)
                out.append((name, at, len(data), row["url"], row["digest"], row["page_id"], "response" if refers is None else "revisit"))
                at += len(data)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        if sink is not None:
            sink.close()

    return planned.mapInArrow(put, INDEX)


def merged(rows: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> Iterator[tuple[int, int, int]]:
    """(first row, end row, bytes) of the reads that cover sorted (offset, length) rows.

    Ranges at most `gap` apart are read together, up to about `most` bytes.
    """
    start = 0
    for i in range(1, len(rows) + 1):
        begin, end = rows[start][0], rows[i - 1][0] + rows[i - 1][1]
        if i == len(rows) or rows[i][0] > end + gap or rows[i][0] + rows[i][1] - begin > most:
            yield start, i, end - begin
            start = i


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows as they are in the archives: see `READ`.

    Index rows are sorted by place over the cluster, so each task reads its files front to back; there
    are as many tasks as the records' bytes ask for, at `TASK_BYTES` each. Payloads of responses are checked against their digest; revisits carry no payload here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        name, source = None, None
        for batch in slices(batches, 4096):
            rows, at = batch.to_pylist(), 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end]["file"] == rows[at]["file"]:
                    end += 1
                if rows[at]["file"] != name:
                    if source is not None:
                        source.close()
                    name = rows[at]["file"]
                    source = system.open_input_file(f"{base}/{name}")
                for first, last, size in merged([(r["offset"], r["length"]) for r in rows[at:end]]):
                    begin = rows[at + first]["offset"]
                    data = source.read_at(size, begin)
                    out = []
                    for r in rows[at + first : at + last]:
                        place = r["offset"] - begin
                        fields, payload = parse(gzip.decompress(data[place : place + r["length"]]))
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kept = fields["WARC-Type"] == "response"
                        if kept and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name} at {r['offset']}: payload and digest differ")
                        number = {k: int(fields[k]) for k in ("Page-Id", "Refers-To-Page-Id") if k in fields}
                        out.append((number.get("Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number.get("Refers-To-Page-Id"), len(payload) if kept else None, digest))
                    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page_id", "url", "record_type", "refers_id", "payload_bytes", "digest"])
                at = end

    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = -(-total // TASK_BYTES) or 1
    placed = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, READ)


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Writes all pages, reads the archives back, and gives one row per page:
    (page_id, payload_bytes, payload_digest, record_type, refers_to).

    `pages` has page_id, url and html; null html is an empty payload, a null URL or page_id is left
    out of its record. Rows that repeat both page_id and payload are all responses; a null page_id
    with a payload that a numbered page has too is a revisit. A revisit's length is that of the
    payload of the record it names. No rows give no rows and no files.
    """
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")
    write(plan(pages, least), f"{folder}/records").write.parquet(f"{folder}/index")
    records = freeze(read(spark.read.parquet(f"{folder}/index"), f"{folder}/records"))
    named = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_id"), "digest").agg(F.max("payload_bytes").alias("kept_bytes"))
    full = records.join(named, ["refers_id", "digest"], "left")
    size = F.coalesce("payload_bytes", "kept_bytes")
    return full.select("page_id", size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_id").alias("refers_to"))
