"""Benchmark decontamination by a prefix-filtered set join over word shingles.

A benchmark item is cut into windows of `WINDOW` words; a document is contaminated where it holds
all words of a window in their order. A window is a set of shingles, and a document that contains
the window contains each of them. Shingles are ordered by rarity, counted over all documents, and
for full containment the necessary prefix of that order is one shingle: the rarest. Documents are
joined to windows on this shingle alone. Of the pairs that meet, the place of the shingle in the
document and in the window gives where the window would start, which must lie inside the document
(positional bound) and leave room for all its words (length bound); then the words themselves are
compared.

Two passes read the documents. The first counts the benchmark's shingles in them. The second looks
for prefix shingles only and writes one row per document: its number of words and, for each hit,
the place and the words around it, so that no text moves between tasks. What a pass looks for goes
to the workers as a bit table of at most 32 MB, whatever the benchmark's size; a shingle that only
shares its bit is dropped by the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.llm.common import map_rows, slices
from sievework.session import work_path

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
# Bits of the largest table sent to the workers, as a power of two: 32 MB.
MOST_BITS = 28
# The table has that many bits for each hash in it, as a power of two, while it is below the largest.
SPARE_BITS = 10
# Different words whose hashes a worker keeps.
KEPT_WORDS = 200_000
# What is not part of a word becomes a blank, A-Z become a-z; all bytes of other characters stay.
_PLAIN = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, with A-Z lower-cased: the runs of `WORD`."""
    return text.encode().translate(_PLAIN).split() if text else []


class _WordHashes(dict):
    """The hash of a word, kept for frequent ones."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _WordHashes()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hash of the `size` words from each place on, as signed 64-bit numbers."""
    own = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ own[i : i + n]) * _FACTORS[i % 4]
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _wanted(hashes: DataFrame, most: int):
    """A broadcast (bits, table) of the column `hash`: the bit of each hash's leading `bits` is set.

    The table is made of bitmaps of 4 KB each, at most 2 ** `most` bits in all.
    """
    bits = min(most, max(15, hashes.select("hash").distinct().count().bit_length() + SPARE_BITS))
    slot = F.shiftrightunsigned("hash", 64 - bits) + 1
    bitmaps = hashes.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("map"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for bucket, bitmap in bitmaps.collect():
        table[(bucket - 1) * len(bitmap) : bucket * len(bitmap)] = np.frombuffer(bitmap, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast((bits, table))


def _places(wanted: tuple[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Where the hashes' bits are set."""
    bits, table = wanted
    slot = (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def _sizes(windows: DataFrame, shingle: int) -> list[int]:
    """The shingle sizes in use, at most `shingle` rows: a window shorter than a shingle is one shingle of its own length."""
    return sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect())


def benchmark_windows(items: DataFrame, item: str, text: str, window: int = WINDOW) -> DataFrame:
    """Rows (item, words array<string>): the different windows of each item; an item shorter than a window is one.

    Null or wordless texts have none; an item that comes twice counts once per window.
    """

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in tuples:
            found = [w.decode() for w in words_of(t)]
            for start in range(max(len(found) - window + 1, 1) if found else 0):
                yield k, found[start : start + window]

    kind = items.select(F.col(item)).schema[0].dataType.simpleString()
    return map_rows(items, [item, text], f"item {kind}, words array<string>", rows, 512).distinct()


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Rows (words, place, hash): the shingles of each window and where in it they start."""

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for (w,) in tuples:
            for place, h in enumerate(shingle_hashes([x.encode() for x in w], min(len(w), shingle)).tolist()):
                yield w, place, h

    return map_rows(windows, ["words"], "words array<string>, place int, hash bigint", rows)


def shingle_counts(docs: DataFrame, text: str, shingles: DataFrame, sizes: list[int], most: int = MOST_BITS) -> DataFrame:
    """Rows (hash, n): how often each of the shingles (column `hash`, of `sizes` words) comes in all documents.

    Shingles that never come have no row; others that share a bit with one may have one.
    """
    table = _wanted(shingles, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = table.value
        for part in slices(batches):
            found = []
            for t in part.column(0).to_pylist():
                own = words_of(t)
                for size in sizes:
                    hashes = shingle_hashes(own, size)
                    found.append(hashes[_places(wanted, hashes)])
            values, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["hash", "n"])

    counted = docs.select(docs[text].alias("t")).mapInArrow(run, "hash bigint, n bigint")
    return counted.groupBy("hash").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, docs: DataFrame, text: str, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """Rows (hash, place, words, size): each different window with its rarest shingle.

    Ties go to the earlier shingle. A window with a shingle that no document holds occurs nowhere
    and has no row.
    """
    shingled = _window_shingles(windows.select("words").distinct(), shingle)
    counts = shingle_counts(docs, text, shingled, _sizes(windows, shingle), most)
    rarest = shingled.join(counts, "hash", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "place", "hash")).alias("best"),
    )
    return rarest.filter(F.col("best.n") > 0).select("best.hash", "best.place", "words", F.size("words").alias("size"))


def candidates(docs: DataFrame, key: str, text: str, prefix: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """Rows (key, n_words, found array<struct<hash, place, before, around>>), one per document.

    `found` lists where a prefix shingle comes, with the words up to a window around it; `before`
    of these stand before the shingle.
    """
    table, sizes = _wanted(prefix, most), _sizes(prefix, shingle)

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        wanted = table.value
        for k, t in tuples:
            own, found = words_of(t), []
            for size in sizes:
                hashes = shingle_hashes(own, size)
                for p in _places(wanted, hashes).tolist():
                    start = max(0, p - window + size)
                    found.append((int(hashes[p]), p, p - start, [w.decode() for w in own[start : p + window]]))
            yield k, len(own), found

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, found array<struct<hash:bigint,place:int,before:int,around:array<string>>>"
    return map_rows(docs, [key, text], schema, rows, 256)


def _verified(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """Rows (row, start, size, words): where a document holds a whole window."""
    first = F.col("before") - F.col("offset")
    fits = (first >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))
    same = F.slice("around", first + 1, F.col("size")) == F.col("words")
    shifted = prefix.select("hash", F.col("place").alias("offset"), "words", "size")
    met = found.join(shifted, "hash").withColumn("start", F.col("place") - F.col("offset"))
    return met.filter(fits).filter(F.when(fits, same)).select("row", "start", "size", "words")


def _covered(hits: DataFrame) -> DataFrame:
    """Rows (row, n_hit): words inside any of a document's hits, each once."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "start", (F.col("start") + F.col("size")).alias("end"))
    fresh: Column = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    return spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("row").agg(F.sum("fresh").cast("bigint").alias("n_hit"))


def decontaminate(
    docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str,
    window: int = WINDOW, shingle: int = SHINGLE, most: int = MOST_BITS,
) -> DataFrame:
    """Rows (key, n_words, n_hit, n_items, items_sha256, contaminated), one per document.

    `n_hit` counts the words inside any occurrence of an item's window, each once; `n_items` the
    items with an occurring window, whose keys, sorted as strings and joined by commas, give
    `items_sha256`. Null and wordless texts have no words; such items no windows; items with a null
    key do not count as items, but their windows hit; items with equal windows all count. Repeated
    rows and keys stay apart; no items leave every document clean.
    """
    spark = docs.sparkSession
    windows_path, found_path = work_path(spark, "windows"), work_path(spark, "candidates")
    benchmark_windows(items, item, item_text, window).write.parquet(windows_path)
    windows = spark.read.parquet(windows_path)
    prefix_path = work_path(spark, "prefixes")
    prefixes(windows, docs, text, shingle, most).write.parquet(prefix_path)
    prefix = spark.read.parquet(prefix_path)
    candidates(docs, key, text, prefix, window, shingle, most).withColumn("row_", F.monotonically_increasing_id()).write.parquet(found_path)
    rows = spark.read.parquet(found_path)
    row, own = F.col("row_").alias("row"), rows[rows.columns[0]]
    found = rows.filter(F.size("found") > 0).select(row, "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    hits_path = work_path(spark, "hits")
    _verified(found, prefix).write.parquet(hits_path)
    hits = spark.read.parquet(hits_path)
    held = hits.select("row", "words").distinct().join(windows, "words").select("row", F.col("item").cast("string").alias("item")).filter("item IS NOT NULL")
    listed = held.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.select(row, own.alias("key"), "n_words").join(_covered(hits), "row", "left").join(listed, "row", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
