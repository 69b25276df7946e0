"""URL rules held in a Bloom filter cascade.

The first filter encodes the listed keys. Keys of the corpus that pass it without being listed are
encoded by the second, listed keys that pass the second by the third, and so on until nothing is
left over. As every key the corpus can ask for took part, the cascade answers for the corpus
exactly: a key is listed if the first level that it fails has an odd number (counted from zero),
and URLs are judged without a join.

A key is a host suffix with a path beginning, marked with the verdict of its list. Filters are sent
to all tasks only up to `MOST_BYTES`; a longer list is cut by hash into parts with a cascade each,
which judge one after another, and the longest rule of all parts wins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sievework.llm.common import map_rows, slices
from sievework.session import freeze

RATE = 0.01
MOST_BYTES = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A key seen by one task is handed on once, as long as it stays in a memory of this many keys.
_SEEN = 100_000


@dataclass
class Bloom:
    """A Bloom filter; `level` sets its hash functions apart from those of other levels."""

    level: int
    bits: int
    hashes: int
    words: np.ndarray

    def places(self, key: str) -> list[int]:
        data = key.encode()
        a, b = xxhash.xxh64_intdigest(data, 2 * self.level), xxhash.xxh64_intdigest(data, 2 * self.level + 1) | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in self.places(key))


def listed(levels: list[Bloom], key: str) -> bool:
    """What the cascade says of a key of its universe."""
    for i, bloom in enumerate(levels):
        if key not in bloom:
            return i % 2 == 1
    return len(levels) % 2 == 1


def bits_for(n: int, rate: float = RATE) -> int:
    """Bits of a filter for n keys, in whole words."""
    return max(64, -(-math.ceil(-n * math.log(rate) / math.log(2) ** 2) // 64) * 64)


def _hash_count(rate: float) -> int:
    return max(1, round(-math.log2(rate)))


def build(keys: DataFrame, n: int, level: int, rate: float = RATE) -> Bloom:
    """A filter of the `key` column; words are combined per task before they meet."""
    bits, hashes = bits_for(n, rate), _hash_count(rate)
    empty = Bloom(level, bits, hashes, np.zeros(0, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            places = np.unique(np.array([p for k in batch.column(0).to_pylist() for p in empty.places(k)], np.int64))
            words, start = np.unique(places >> 6, return_index=True)
            if len(words):
                values = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (places & 63).astype(np.uint64)), start)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(values.view(np.int64))], ["w", "v"])

    rows = keys.select("key").mapInArrow(run, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v"))
    words = np.zeros(bits // 64, np.uint64)
    # As many rows as the filter has words; `cascades` bounds them.
    for r in rows.collect():
        words[r["w"]] = np.uint64(r["v"] & (2**64 - 1))
    return Bloom(level, bits, hashes, words)


def _passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(bloom)

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        return ((k,) for (k,) in tuples if k in sent.value)

    return map_rows(keys, ["key"], "key string", rows)


def cascade(keys: DataFrame, universe: Callable[[Bloom], DataFrame], rate: float = RATE) -> list[Bloom]:
    """The levels for the distinct listed `keys`; `universe` gives the corpus keys that pass a filter.

    Each level holds about `rate` of the keys of the level two before, so there are few levels.
    """
    levels = [build(keys, keys.count(), 0, rate)]
    inside, outside = keys, freeze(universe(levels[0]).join(keys, "key", "left_anti"))
    while n := outside.count():
        levels.append(build(outside, n, len(levels), rate))
        inside, outside = outside, freeze(_passing(inside, levels[-1]))
    return levels


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: str, path: str, lengths: list[int], longest: int) -> Iterator[tuple[int, int, str]]:
    """(length, host length, rule) of every rule that could fit, for the path lengths that rules have.

    Hosts are cut from the end, up to the length of the longest host of a rule, however long they are.
    """
    at = len(host)
    while at >= 0:
        at = host.rfind(".", max(0, len(host) - longest - 1), at)
        size = len(host) - at - 1
        if size > longest:
            return
        suffix = host[at + 1 :]
        for n in lengths:
            if n <= len(path):
                yield size + n, size, suffix + path[:n]


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows (key, host, path, rule, verdict), one per input row.

    `rules` has host, path and verdict (allow or block). A rule fits its host and all subdomains if
    the URL's path begins with the rule's; the longest rule wins, of equal ones that with the longer
    host, of a rule in both lists the blocking one. URLs that no rule fits are not on a list: null
    rule, allowed. A null URL or one without :// has an empty host and path. Repeated rules count
    once, rules with a null host, path or verdict not at all; repeated rows and null keys stay.
    """
    spark = pages.sparkSession
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    lengths = sorted(r["n"] for r in known.select(F.length("path").alias("n")).distinct().collect())
    longest = known.agg(F.coalesce(F.max(F.length("host")), F.lit(0)).alias("n")).first()["n"]
    keys = freeze(known.select(F.concat(F.substring("verdict", 1, 1), F.translate("host", UPPER, LOWER), "path").alias("key")).distinct())
    parts = -(-bits_for(keys.count()) // (8 * most_bytes))
    rows = pages.select(pages[key].alias("k"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    kind = rows.schema["k"].dataType.simpleString()
    judged = rows.withColumns({"rule": F.lit(None).cast("string"), "size": F.lit(-1), "wide": F.lit(-1), "mark": F.lit("a")})

    for part in range(parts):
        own = freeze(keys.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part))

        def universe(bloom: Bloom) -> DataFrame:
            sent = spark.sparkContext.broadcast(bloom)

            def run(tuples: Iterator[tuple]) -> Iterator[tuple]:
                seen: set[str] = set()
                for host, path in tuples:
                    for _, _, rule in candidates(host, path, lengths, longest):
                        for asked in ("a" + rule, "b" + rule):
                            if asked not in seen and asked in sent.value:
                                if len(seen) >= _SEEN:
                                    seen.clear()
                                seen.add(asked)
                                yield (asked,)

            return map_rows(rows, ["host", "path"], "key string", run).distinct()

        levels = spark.sparkContext.broadcast(cascade(own, universe))

        def run(tuples: Iterator[tuple], levels=levels) -> Iterator[tuple]:
            for k, host, path, rule, size, wide, mark in tuples:
                for n, w, found in sorted(candidates(host, path, lengths, longest), reverse=True):
                    if (n, w) < (size, wide):
                        break
                    hit = next((m for m in "ba" if listed(levels.value, m + found)), None)
                    if hit and (n, w, hit) > (size, wide, mark if rule is not None else ""):
                        rule, size, wide, mark = found, n, w, hit
                        break
                yield k, host, path, rule, size, wide, mark

        schema = f"k {kind}, host string, path string, rule string, size int, wide int, mark string"
        judged = map_rows(judged, judged.columns, schema, run)

    verdict = F.when(F.col("mark") == "b", "block").otherwise("allow")
    return judged.select(F.col("k").alias(key), "host", "path", "rule", verdict.alias("verdict"))
