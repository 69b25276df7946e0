"""Stupid-backoff scores of documents against the n-grams of the whole corpus.

The score of a word is the relative frequency of its longest n-gram that the corpus has outside the
document itself, times ALPHA for each step it had to be shortened.

Documents are dealt into buckets of about `BUCKET_BYTES` of text, whatever the input. A bucket counts
its own n-grams, 64-bit hashes of their words, and asks once for each: one row per bucket and range
of hashes, of which there are `RANGES`. Rows of a range meet, their counts are summed, and each bucket
gets the sums back in the order in which it asked, so hashes travel one way only. The bucket takes
each document's own occurrences off and scores it.

However often the corpus has an n-gram, a bucket asks for it once, so no range has one n-gram for
most of its rows, and the rows of every step grow with the text. The n-gram of no words, which comes
once per word, tells how many words there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, functions as F, types as T

ALPHA = 0.4
ORDER = 2
BUCKET_BYTES = 5_000_000
# Ranges of hashes. Their number is fixed, or rows would grow with the square of the input; at 30 GB
# of documents a range has about two million counts, by estimate.
_RANGE_BITS = 12
RANGES = 1 << _RANGE_BITS
UNIT = 1_000_000
# So many words or places at once are Python objects or in one table.
_PLACES = 1 << 16
# Without effect: n-grams are no longer sought by samples, as frequent ones need no way of their own.
HOT = 50_000
HEAVY_SAMPLE = 16


class Grams(NamedTuple):
    """The n-grams of one order in a bucket of texts, numbered."""

    # Which places begin one, and its number there.
    valid: np.ndarray
    number: np.ndarray
    # By number.
    hashes: np.ndarray


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two: multiply, fold, multiply."""
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _numbers(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each value the number of its first occurrence among the distinct ones, and these."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def split(texts: pa.Array, order: int) -> tuple[np.ndarray, list[Grams]]:
    """The text each word is from, and the n-grams of each order from 1."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    # White space at either end leaves empty words.
    full = pc.not_equal(words, "")
    doc = doc[full.to_numpy(zero_copy_only=False)]
    ids, known = _numbers(words.filter(full))
    first = np.empty(len(known), np.uint64)
    for start in range(0, len(known), _PLACES):
        first[start : start + _PLACES] = hash_array(known.slice(start, _PLACES).to_numpy(zero_copy_only=False), categorize=False)
    out, size = [Grams(np.ones(len(ids), bool), ids, first)], max(len(known), 1)
    for k in range(1, order):
        before, places = out[-1], max(len(ids) - k, 0)
        valid = doc[:places] == doc[k:]
        number = np.zeros(places, np.int64)
        number[valid], keys = _numbers(pa.array((before.number[:places] * size + ids[k:])[valid]))
        keys = keys.to_numpy()
        out.append(Grams(valid, number, _mix(before.hashes[keys // size] + np.uint64(k), first[keys % size])))
    return doc, out


def _sorted(grams: list[Grams]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-gram of no words and of all others; their order; where its ranges begin, and its end."""
    hashes = np.concatenate([np.zeros(1, np.uint64), *(g.hashes for g in grams)])
    order = np.argsort(hashes)
    own = hashes[order] >> np.uint64(64 - _RANGE_BITS)
    return hashes, order, np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))


def _short(c: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; nothing if all are one."""
    if (c == 1).all():
        return b""
    top = int(c.max())
    return c.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 256 ** int(t[2]))).tobytes()


def _long(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if data else np.ones(n, np.int64)


def _texts(bucket: pa.Table) -> pa.Array:
    texts = [pa.decompress(z, size, "zstd", asbytes=True) for z, size in zip(bucket["z"].to_pylist(), bucket["size"].to_pylist())]
    return pa.array(texts, pa.large_binary()).view(pa.large_string())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed. Equal rows of a batch become one, with their number, so they cannot fill a bucket."""
    for batch in batches:
        _, first, n = np.unique(batch["same"].to_numpy(), return_index=True, return_counts=True)
        batch = batch.take(pa.array(first))
        z = pa.array([pa.compress(t.as_buffer(), "zstd", asbytes=True) for t in batch["t"]], pa.binary())
        size = pc.binary_length(batch["t"]).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch["bucket"], batch["k"], z, size, pa.array(n, pa.int64())], ["bucket", "k", "z", "size", "n"])


def _answer(asked: pa.Table) -> pa.Table:
    """Sums the counts of a range's n-grams; each bucket gets the sums of those it asked for, in its order."""
    asked = asked.combine_chunks()
    hashes = pa.concat_arrays([c.flatten() for c in asked["h"].chunks]).to_numpy().view(np.uint64)
    sizes = pc.list_value_length(asked["h"]).to_numpy()
    own = np.concatenate([_long(c, n) for c, n in zip(asked["c"].to_pylist(), sizes)])
    order = np.argsort(hashes)
    hashes = hashes[order]
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    sums = np.empty(len(own), np.int64)
    sums[order] = np.repeat(np.add.reduceat(own[order], starts), np.diff(np.append(starts, len(own))))
    c = [_short(part) for part in np.split(sums, np.cumsum(sizes)[:-1])]
    return pa.table({"bucket": asked["bucket"], "range": asked["range"], "c": pa.array(c, pa.binary())})


def _own(doc: np.ndarray, number: np.ndarray, numbers: int) -> np.ndarray:
    """How often the document of each place has the n-gram there; some documents at a time, for small tables."""
    out, cuts = np.empty(len(doc), np.int64), np.unique(np.searchsorted(doc, doc[::_PLACES]))
    for start, end in pairwise([*cuts.tolist(), len(doc)]):
        same, distinct = _numbers(pa.array(doc[start:end].astype(np.int64) * numbers + number[start:end]))
        out[start:end] = np.bincount(same, minlength=len(distinct))[same]
    return out


def bucket_scores(doc: np.ndarray, n_docs: int, grams: list[Grams], counts: list[np.ndarray], total: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words, words that were shortened, sum of the words' log scores in millionths.

    `counts` has the corpus counts of the numbered n-grams; the document's own occurrences are taken
    off. A word the rest of the corpus does not have counts as if it came once.
    """
    n = np.bincount(doc, minlength=n_docs)
    rest = []
    for g, c in zip(grams, counts):
        number = g.number[g.valid]
        left = np.zeros(len(g.valid), np.int64)
        left[g.valid] = c[number] - _own(doc[: len(g.valid)][g.valid], number, len(c))
        rest.append(left)
    value, used = np.log(np.maximum(rest[0], 1) / np.maximum(total - n, 1)[doc]), np.ones(len(doc), np.int64)
    for k in range(2, len(grams) + 1):
        starts = np.flatnonzero(rest[k - 1] > 0)
        value[starts + k - 1] = np.log(rest[k - 1][starts] / rest[k - 2][starts])
        used[starts + k - 1] = k
    begin = np.cumsum(n) - n
    steps = np.minimum(np.arange(len(doc)) - begin[doc] + 1, len(grams)) - used
    micro = np.floor((value + steps * math.log(alpha)) * UNIT + 0.5).astype(np.int64)
    shortened, score_micro = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    if len(doc):
        shortened[n > 0] = np.add.reduceat((steps > 0).astype(np.int64), begin[n > 0])
        score_micro[n > 0] = np.add.reduceat(micro, begin[n > 0])
    return n, shortened, score_micro


def score(docs: DataFrame, key: str, text: str, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """Rows (key, n_tokens, n_shortened, score_micro), one per input row.

    Words are what ASCII white space separates, A-Z in lower case, whole texts; `score_micro` sums
    the natural logarithms of the words' scores, each rounded to millionths, so the sum does not
    depend on any order. Null and empty texts have zeros. Copies of a text count as other documents
    and get equal scores; null keys and repeated rows stay. No rows give no rows.
    """
    rows = docs.select(docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    kind = rows.schema["k"].dataType

    def ask(bucket: pa.Table) -> pa.Table:
        doc, grams = split(_texts(bucket), order)
        copies = bucket["n"].to_numpy()[doc]
        counts = [copies.sum(keepdims=True), *(np.bincount(g.number[g.valid], copies[: len(g.valid)][g.valid], len(g.hashes)).astype(np.int64) for g in grams)]
        hashes, place, cuts = _sorted(grams)
        hashes, counts = hashes[place], np.concatenate(counts)[place]
        columns = {
            "bucket": pa.array(np.full(len(cuts) - 1, bucket["bucket"][0].as_py())),
            "range": pa.array((hashes[cuts[:-1]] >> np.uint64(64 - _RANGE_BITS)).astype(np.int64)),
            "h": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64))),
            "c": pa.array([_short(c) for c in np.split(counts, cuts[1:-1])], pa.binary()),
        }
        return pa.table(columns)

    def finish(bucket: pa.Table, answers: pa.Table) -> pa.Table:
        doc, grams = split(_texts(bucket), order)
        hashes, place, cuts = _sorted(grams)
        answers = answers.sort_by("range")
        counts = np.empty(len(hashes), np.int64)
        counts[place] = np.concatenate([_long(c, n) for c, n in zip(answers["c"].to_pylist(), np.diff(cuts), strict=True)])
        parts = np.split(counts[1:], np.cumsum([len(g.hashes) for g in grams])[:-1])
        scores = bucket_scores(doc, bucket.num_rows, grams, parts, int(counts[0]), alpha)
        out = pa.table({"k": bucket["k"], **dict(zip(("n_tokens", "n_shortened", "score_micro"), map(pa.array, scores)))})
        return out.take(pa.array(np.repeat(np.arange(out.num_rows), bucket["n"].to_numpy())))

    # What a row holds decides on its bucket, so a part that is read again falls into the same ones.
    same = F.xxhash64("k", "t")
    dealt = rows.select(F.pmod(same, F.lit(buckets)).alias("bucket"), "k", "t", same.alias("same"))
    packed = T.StructType().add("bucket", "long").add("k", kind).add("z", "binary").add("size", "long").add("n", "long")
    texts = dealt.mapInArrow(_pack, packed)
    asked = texts.groupBy("bucket").applyInArrow(ask, "bucket long, range long, h array<long>, c binary")
    answers = asked.groupBy("range").applyInArrow(_answer, "bucket long, range long, c binary")
    scored = T.StructType().add("k", kind).add("n_tokens", "long").add("n_shortened", "long").add("score_micro", "long")
    out = texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(finish, scored)
    return out.select(F.col("k").alias(key), "n_tokens", "n_shortened", "score_micro")
