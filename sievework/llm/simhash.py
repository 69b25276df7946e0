"""SimHash near-duplicates through an inverted index of fingerprint bytes with count filtering.

Two 64-bit fingerprints that differ in at most three bits share at least five of their eight
positional bytes. Lists of single bytes would hold 1/256 of all fingerprints each, so the index is
kept on four bytes at once: the 14 sets of four positions whose numbers cancel by exclusive or.
Any five positions contain exactly one of them, so a pair that shares five bytes meets in some list.
For pairs that meet, the shared positional bytes are tallied; pairs with five or more are verified
bit by bit.

A list that many fingerprints share (a large group of near copies) is split once more by a fifth
byte, of which the pair must share one of four. Such a list holds at most 2**24 fingerprints,
whatever the data; above `BLOCK` it is searched by flipping up to three of the 24 open bits, which
is linear in its length. Only links that span a list's groups leave it, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from sievework.llm.common import map_rows, slices, unused
from sievework.llm.components import components
from sievework.session import freeze

SEED = 42
BYTES = 8
MAX_BITS = 3
SHARED = BYTES - MAX_BITS
BLOCKS = [c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
# Fingerprints of one list that are compared pair by pair; longer lists are split.
BLOCK = 1500
_HASHES = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned SimHash of the word shingles of a whole text, repeats included; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        hashes = iter([digest(line, SEED)])
        total = 1
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(found) - words + 1].tolist()
        hashes = (digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist()))
        total = len(starts)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, _HASHES):
        part = np.fromiter(hashes, np.uint64, min(_HASHES, total - start))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """Rows (id, fp): the fingerprint of each row's whole text as a signed 64-bit number."""

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for k, t in tuples:
            f = fingerprint(t, words)
            yield k, f - (1 << 64) if f >> 63 else f

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    return map_rows(docs, [key, text], f"id {kind}, fp bigint", rows)


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _lists(distinct: DataFrame) -> DataFrame:
    """One row per fingerprint and block of four positions: (list id, the four bytes, fp)."""
    keys = F.array(*[F.struct(F.lit(i).alias("p"), F.col("fp").bitwiseAND(F.lit(_mask(b))).alias("m")) for i, b in enumerate(BLOCKS)])
    return distinct.select("fp", F.explode(keys).alias("k")).select("k.p", "k.m", "fp")


def _split(lists: DataFrame) -> DataFrame:
    """The rows of long lists once more for each of the other four positions, with its byte in the key."""
    out = []
    for i, block in enumerate(BLOCKS):
        for p in range(BYTES):
            if p not in block:
                out.append((i, 100 + i * BYTES + p, _mask((*block, p))))
    options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for i, p, m in out])
    own = F.filter(options, lambda o: o["i"] == F.col("p"))
    return lists.select("fp", F.explode(own).alias("k")).select("k.p", "k.m", "fp")


def _spanning(links: Iterator[tuple[int, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """Links (i, j) that join the same groups as all the given ones."""
    label, out = np.arange(n), []
    for i, js in links:
        for lab in np.unique(label[js]):
            if lab != label[i]:
                out.append((i, int(js[label[js] == lab][0])))
                label[label == lab] = label[i]
    return out


def _compare(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of a short list: tally shared bytes, keep pairs with enough, verify their bits."""

    def links() -> Iterator[tuple[int, np.ndarray]]:
        step = max(1, (1 << 19) // len(fps))
        for start in range(0, len(fps), step):
            differing = fps[start : start + step, None] ^ fps[None, :]
            shared = (differing.view(np.uint8).reshape(*differing.shape, BYTES) == 0).sum(axis=2, dtype=np.uint8)
            near = (shared >= SHARED) & (np.bitwise_count(differing) <= MAX_BITS)
            for r in range(near.shape[0]):
                js = np.flatnonzero(near[r])
                js = js[js > start + r]
                if len(js):
                    yield start + r, js

    return _spanning(links(), len(fps))


def _flip(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a long list that agrees in five bytes, by flipping up to three of the 24 other bits."""
    spread = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = [i for i in range(64) if spread >> i & 1]
    small = np.zeros(len(fps), np.int64)
    for to, bit in enumerate(free):
        small |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << to
    place = np.full(1 << len(free), -1, np.int32)
    place[small] = np.arange(len(fps))
    masks = [sum(1 << b for b in c) for r in range(1, MAX_BITS + 1) for c in combinations(range(len(free)), r)]
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        for mask in masks:
            other = place[small ^ mask]
            label = np.where(other >= 0, np.minimum(label, label[other]), label)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return [(i, int(j)) for i, j in enumerate(label) if i != j]


def _list_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each list; the rows of a list come together."""
    rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def close(p: np.ndarray, m: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero((p[1:] != p[:-1]) | (m[1:] != m[:-1])) + 1
        a, b = [], []
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
            if e - s == 2:
                if (int(f[s]) ^ int(f[s + 1])).bit_count() <= MAX_BITS:
                    a.append(f[s])
                    b.append(f[s + 1])
            elif e - s > 2:
                fps = np.unique(f[s:e])
                for i, j in _compare(fps) if len(fps) <= BLOCK else _flip(fps):
                    a.append(fps[i])
                    b.append(fps[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(tuple(batch.column(i).to_numpy() for i in range(2)) + (batch.column(2).to_numpy().view(np.uint64),))
        p, m, f = (np.concatenate(c) for c in zip(*rest)) if rest[0][0][0] != rest[-1][0][-1] or rest[0][1][0] != rest[-1][1][-1] else (None, None, None)
        if p is None:
            continue
        last = int(np.flatnonzero((p != p[-1]) | (m != m[-1]))[-1]) + 1
        yield from close(p[:last], m[:last], f[:last])
        rest = [(p[last:], m[last:], f[last:])]
    if rest:
        yield from close(*(np.concatenate(c) for c in zip(*rest)))


def near_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (a, b) of fingerprints that lie within three bits or are joined by such steps.

    They join the same groups as all pairs within three bits; `distinct` has one row per fp.
    """
    lists = _lists(distinct)
    sizes = lists.groupBy("p", "m").agg(F.count("*").alias("n")).filter("n > 1")
    sized = freeze(lists.join(sizes, ["p", "m"]))
    short = sized.filter(F.col("n") <= block).select("p", "m", "fp")
    long = _split(sized.filter(F.col("n") > block).select("p", "m", "fp"))
    ready = short.unionByName(long).repartition("p", "m").sortWithinPartitions("p", "m")
    return ready.mapInArrow(_list_links, "a bigint, b bigint")


def _grouped(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Rows (id, fp, root, component_id), one per input row; root tells groups apart, also those without a key."""
    marked = freeze(fingerprints(docs, key, text, words))
    classes = freeze(marked.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(near_links(classes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """Rows (key, fingerprint, component_id), one per input row.

    `fingerprint` is 16 lower-case hex digits; `component_id` is the smallest key of the rows whose
    fingerprints can be reached by steps of at most three bits. Null and empty texts have the
    fingerprint zero and link like any other; equal texts link; a row with a null key counts for
    its group but never names it (a group of null keys only has a null component_id). Repeated keys
    give repeated rows. No rows give no rows.
    """
    out = _grouped(docs, key, text, words)
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_fingerprint(df: DataFrame, text: str, name: str, words: int) -> DataFrame:
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = np.array([fingerprint(t, words) for t in part.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], [*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """One row of each group of near duplicates, with all its columns as they are.

    The row of the group's smallest key stays; if several rows of the group have that key, or none
    has a key, the smallest of them by all columns. Only rows with repeated or null keys are moved.
    """
    own, many, packed, print_, root = unused(docs, "key_", "many_", "row_", "print_", "root_")
    rows = freeze(_grouped(docs, key, text, words))
    keeps = F.col("id").eqNullSafe(F.col("component_id"))
    per_key = rows.groupBy("id").agg(F.count("*").alias("n"), F.max(keeps).alias("keeps")).filter("keeps")
    kept = freeze(per_key.select(F.col("id").alias(own), ((F.col("n") > 1) | F.col("id").isNull()).alias(many)))
    chosen = docs.join(kept, docs[key].eqNullSafe(kept[own]))
    columns = [docs[c] for c in docs.columns]
    single = chosen.filter(~F.col(many)).select(*columns)
    repeated = _with_fingerprint(chosen.filter(many).select(*columns), text, print_, words)
    named = rows.filter(keeps).select(F.col("id").alias(own), F.col("fp").alias(many), F.col("root").alias(root)).distinct()
    met = repeated.join(named, repeated[key].eqNullSafe(named[own]) & (repeated[print_] == named[many]))
    first = met.groupBy(root).agg(F.min(F.struct(*[repeated[c] for c in docs.columns])).alias(packed))
    return single.unionByName(first.select(f"{packed}.*"))
