"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes come from rotations learned on a bounded sample (`SAMPLE`): principal directions, then rotated
until the signs lose least. More bits than dimensions take several rotations. A code is cut into
substrings of 16 bits with an index each. Two codes within r bits agree in some substring up to
r / substrings bits, so looking up the values that near in every index finds every code within r
bits; those are measured bit by bit, and what remains is ranked by the cosine of the original
vectors.

The radius is not guessed: for `AUDIT` sampled queries the true neighbours are found by brute force,
and the radius is the one that holds the wanted share of them. Recall is measured the same way.

Rows are indexed in blocks of at most `BLOCK`, queries go to all blocks in sets of at most `SET`;
a block hands on its best k per query, so no task or driver sees more than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sievework.llm.vectors import matrix, unit, usable
from sievework.session import freeze

BITS = 256
PIECE = 16
SAMPLE = 10_000
AUDIT = 64
KEEP = 0.98
BLOCK = 1 << 14
SET = 4096
_TURNS = 20


@dataclass
class Coder:
    """Directions whose signs are the bits of a code."""

    mean: np.ndarray
    directions: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row of 16-bit substrings per vector."""
        bits = (unit(x) - self.mean) @ self.directions > 0
        packed = np.packbits(bits, axis=1, bitorder="little")
        return packed.view("<u2").reshape(len(x), -1)


def learn(sample: np.ndarray, bits: int = BITS) -> Coder:
    """Rotations for codes of `bits` bits, a multiple of 16; the same sample gives the same codes."""
    x = unit(sample)
    mean, dims = x.mean(axis=0), x.shape[1]
    x = x - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    rng, out, left = np.random.default_rng(11), [], bits
    while left > 0:
        take = min(dims, left)
        low = x @ axes[:take].T
        turn, _ = np.linalg.qr(rng.normal(size=(take, take)))
        for _ in range(_TURNS):
            u, _, vt = np.linalg.svd(np.sign(low @ turn).T @ low)
            turn = (u @ vt).T
        out.append(axes[:take].T @ turn)
        left -= take
    return Coder(mean, np.concatenate(out, axis=1))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _cosines(rows: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    return (rows * query).sum(axis=1) / (norms * np.sqrt((query * query).sum()))


class Block:
    """The index of one block of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, coder: Coder) -> None:
        self.ids, self.x, self.norms = ids, x, np.sqrt((x * x).sum(axis=1))
        self.codes = coder.codes(x)
        # Per substring: its values, and for each row which value it has.
        self.tables = [np.unique(self.codes[:, p], return_inverse=True) for p in range(self.codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes are at most `radius` bits from the given one."""
        reach = radius // len(self.tables)
        found = np.zeros(len(self.ids), bool)
        for p, (values, row_value) in enumerate(self.tables):
            found |= (np.bitwise_count(values ^ code[p]) <= reach)[row_value]
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]

    def nearest(self, query_id: int, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != query_id]
        scores = _cosines(self.x[rows], self.norms[rows], query)
        best = _best(scores, self.ids[rows], k)
        return self.ids[rows[best]], scores[best]


def _blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), matrix(batch.column(1))))
            n += batch.num_rows
        while n >= size:
            ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            yield ids[:size], x[:size]
            held, n = [(ids[size:], x[size:])], n - size
    if n:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


_FOUND = "query_id bigint, vec_id bigint, score double, bits int"


def _search(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], coder: Coder, radius: int | None, k: int) -> DataFrame:
    """The best k of each block for each query: within `radius` bits, or among all rows if None."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, coder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (query_ids, query_x), learned = sent.value
        query_codes = learned.codes(query_x)
        for ids, x in _blocks(batches):
            block = Block(ids, x, learned)
            out: list[tuple] = []
            for q in range(len(query_ids)):
                near = np.arange(len(ids)) if radius is None else block.within(query_codes[q], radius)
                found, scores = block.nearest(query_ids[q], query_x[q], near, k)
                bits = np.zeros(len(found), np.int32)
                if radius is None and len(found):
                    place = [int(np.flatnonzero(ids == f)[0]) for f in found]
                    bits = np.bitwise_count(block.codes[place] ^ query_codes[q]).sum(axis=1, dtype=np.int32)
                out.append((np.full(len(found), query_ids[q]), found, scores, bits))
            arrays = [pa.array(np.concatenate(c)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))], ["query_id", "vec_id", "score", "bits"])

    found = rows.mapInArrow(run, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)


def search(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
    bits: int = BITS, sample: int = SAMPLE, keep: float = KEEP,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of every query, nearest first.

    Queries are the rows whose key is divisible by `every`, candidates all rows with another key.
    Scores are cosines in double precision, ties go to the smaller key. Vectors that are null, zero
    or hold null or non-finite parts, and rows with a null key, take no part; of repeated keys every
    row is a candidate. Fewer than k candidates are all returned,
    no candidates give no rows. A repeated key asks with its smallest vector. A query with fewer than k codes in its radius is searched among all rows.
    """
    rows = freeze(usable(df, key, vector))
    total = rows.count()
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0)
    if not total:
        return rows.select(*[F.lit(None).cast(t).alias(c) for c, t in (("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "double"))]).limit(0)

    def drawn(of: DataFrame, count: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """About `n` rows drawn by a hash, never more than twice as many."""
        parts = 1 << 30
        some = of.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)) < max(1, min(parts, n * parts // max(count, 1))))
        return _arrays(some.limit(2 * n).collect())

    n_asked = asked.select("id").distinct().count()
    _, sampled = drawn(rows, total, sample)
    if len(sampled) < 2:
        _, sampled = _arrays(rows.limit(2).collect())
    coder = learn(sampled, bits)
    audit = drawn(asked, n_asked, AUDIT)
    radius = bits
    if len(audit[0]):
        audit = audit[0][:AUDIT], audit[1][:AUDIT]
        distances = sorted(r["bits"] for r in _search(rows, audit, coder, None, k).select("bits").collect())
        if distances:
            radius = min(bits, distances[min(len(distances) - 1, int(keep * len(distances)))])

    parts = -(-n_asked // SET)
    results = None
    for part in range(parts):
        own = asked.groupBy("id").agg(F.min("v").alias("v")).filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        queries = _arrays(own.collect())
        if not len(queries[0]):
            continue
        found = freeze(_search(rows, queries, coder, radius, k))
        enough = {r["query_id"] for r in found.groupBy("query_id").count().filter(F.col("count") >= k).collect()}
        short = np.array([q not in enough for q in queries[0]])
        if short.any():
            again = _search(rows, (queries[0][short], queries[1][short]), coder, None, k)
            found = found.filter(~F.col("query_id").isin([int(q) for q in queries[0][short]])).unionByName(again)
        results = found if results is None else results.unionByName(found)
    if results is None:
        results = _search(rows.limit(0), (np.zeros(0, np.int64), np.zeros((0, sampled.shape[1]))), coder, None, k)
    return results.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, **options) -> float:
    """Share of the true k nearest that `search` finds, over all its queries; brute force, for tests and reports."""
    found = search(df, key, vector, every, k, **options).select("query_id", "vec_id")
    rows = usable(df, key, vector)
    queries = _arrays(rows.filter(F.pmod("id", F.lit(every)) == 0).collect())
    exact = _search(rows, queries, learn(queries[1], PIECE), None, k).select("query_id", "vec_id")
    return found.join(exact, ["query_id", "vec_id"]).count() / max(1, exact.count())
