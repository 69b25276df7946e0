"""Cross-tokenizer alignment by lockstep vectorised merging of token ends.

Two tokenizers cut the same bytes differently. Walking both lists of token ends at once, the pointer
whose token ends first moves on, and where both end at the same byte a group of tokens closes (a
cut). One state vector holds the pointers of all documents of a batch and a step moves all of them;
each step emits the groups its cuts close, and documents that are through leave the vector. So that
one long document does not hold up a batch, documents enter as lanes of about `LANE` tokens: a lane
starts where both tokenizers are known to cut.

How many documents hold a pair of token ids linked is counted over the whole corpus. The lookup of
the counts joins the pairs of frequent counts, at most `FREQUENT` of them, by broadcast and the rest
by a shuffle, so that neither a pair that every document holds nor the number of pairs matters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievework.llm import bpe
from sievework.llm.common import slices
from sievework.session import work_path

LANE = 192
# Tokens behind a lane's intended start that are tried for a common end.
TRIED = 32
# Documents that are walked together.
BATCH = 256
# Pairs of token ids that are sent to all executors: about 16 MB.
FREQUENT = 200_000
# Groups with more links than this are reduced to different ids first.
LARGE_GROUP = 1024
# Longer texts without a break are merged by the linear encoder.
LONG_RUN = 2000
_UNBROKEN = regex.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))


class Pair:
    """The two tokenizers, their token bytes and the texts of their ids."""

    def __init__(self, spec: str, model: bytes) -> None:
        self.left = bpe.Vocabulary(spec)
        merged = [self.left.tokens[i] for i in self.left.single]
        ranks = {t: i for i, t in enumerate(self.left.tokens) if self.left.rank[i] >= 0} | {t: i for t, i in zip(merged, self.left.single)}
        # Merging by id is merging by rank only if later merges made larger ids.
        made = sorted((r, i) for i, r in enumerate(self.left.rank) if r >= 0)
        self.fast = None
        if all(a[1] < b[1] for a, b in zip(made, made[1:])) and (not made or max(self.left.single) < made[0][1]):
            self.fast = tiktoken.Encoding("left", pat_str=bpe.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.right = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.right.get_piece_size()
        self.right_tokens = [self._bytes(i) for i in range(size)]
        self.lengths = [np.array([len(t) for t in tokens], np.int64) for tokens in (self.left.tokens, self.right_tokens)]
        n = len(self.left.tokens)
        # Texts of ids with what follows them: left then right, a comma each; left then right, the end of their part.
        self.shown = [f"{i},".encode() for i in range(n)] + [f"{i},".encode() for i in range(size)]
        self.shown += [f"{i}|".encode() for i in range(n)] + [f"{i};".encode() for i in range(size)]

    def _bytes(self, i: int) -> bytes:
        piece = self.right.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.right.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_left(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(t) if self.fast and not _UNBROKEN.search(t) else self._linear(t) for t in texts]

    def _linear(self, text: str) -> list[int]:
        """Ids of a text whose special tokens are plain text."""
        return np.frombuffer(b"".join([r[1] for r in self.left._plain(text)]), np.int32).tolist()


_LOADED: dict[int, Pair] = {}


def _pair(key: int, spec: str, model: bytes) -> Pair:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(spec, model)
    return _LOADED[key]


def _lanes(left: np.ndarray, right: np.ndarray, left_starts: np.ndarray, right_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """First left and right token and last left token of each lane.

    `left` and `right` are the token ends of all documents in one row of bytes, the starts those of
    the documents among them. A document is cut at common ends near every `LANE`-th token.
    """
    sizes = np.diff(left_starts)
    places = [np.arange(s + LANE, e - TRIED, LANE) for s, e in zip(left_starts[:-1][sizes > LANE + TRIED].tolist(), left_starts[1:][sizes > LANE + TRIED].tolist())]
    at = np.concatenate(places) if places else np.empty(0, np.int64)
    tried = at[:, None] + np.arange(TRIED)
    found = np.searchsorted(right, left[tried])
    common = right[np.minimum(found, len(right) - 1)] == left[tried] if len(right) else np.zeros(tried.shape, bool)
    has, first = common.any(axis=1), common.argmax(axis=1)
    rows = np.flatnonzero(has)
    a = np.concatenate([left_starts[:-1], tried[rows, first[rows]] + 1])
    b = np.concatenate([right_starts[:-1], found[rows, first[rows]] + 1])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    return a, b, np.concatenate([a[1:], left_starts[-1:]])


def merge(left: np.ndarray, right: np.ndarray, left_starts: np.ndarray, right_starts: np.ndarray) -> np.ndarray:
    """Rows (left from, left to, right from, right to) of the groups of all documents, in order.

    Documents have at least one token on both sides, and the ends of both sides' last tokens agree.
    """
    a, b, last = _lanes(left, right, left_starts, right_starts)
    state = np.stack([a, b, a, b, last])
    closed: list[np.ndarray] = []
    while state.shape[1]:
        a, b, open_a, open_b, last = state
        left_end, right_end = left[a], right[b]
        moves_a, moves_b = left_end <= right_end, right_end <= left_end
        cut = moves_a & moves_b
        a += moves_a
        b += moves_b
        at = np.flatnonzero(cut)
        if len(at):
            closed.append(np.stack([open_a[at], a[at], open_b[at], b[at]]))
            open_a[at], open_b[at] = a[at], b[at]
            if (a[at] == last[at]).any():
                state = state[:, a < last]
    groups = np.concatenate(closed, axis=1) if closed else np.empty((4, 0), np.int64)
    return groups[:, np.argsort(groups[0], kind="stable")]


def links(groups: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (group, left id << 32 | right id, times): what the groups link; a code may come more than once."""
    left_size, right_size = groups[1] - groups[0], groups[3] - groups[2]
    total = left_size * right_size
    small = np.flatnonzero(total <= LARGE_GROUP)
    n = total[small]
    group = np.repeat(small, n)
    place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    width = right_size[group]
    codes = left_ids[groups[0][group] + place // width] << 32 | right_ids[groups[2][group] + place % width]
    out = [(group, codes, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(total > LARGE_GROUP).tolist():
        a, a_times = np.unique(left_ids[groups[0][g] : groups[1][g]], return_counts=True)
        b, b_times = np.unique(right_ids[groups[2][g] : groups[3][g]], return_counts=True)
        out.append((np.full(len(a) * len(b), g), (a[:, None] << 32 | b).ravel(), (a_times[:, None] * b_times).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out))


def _walk(pair: Pair, texts: list[str | None]) -> Iterator[tuple]:
    """(n_a, n_b, n_groups, n_links, digest, codes, times) of each text."""
    full = [i for i, t in enumerate(texts) if t]
    spaced = [" " + texts[i] for i in full]
    left, right = pair.encode_left(spaced), pair.right.encode([texts[i] for i in full], num_threads=1) if full else []
    usable, left_ids, right_ids, left_n, right_n = [], [], [], [], []
    left_bytes, right_bytes = pair.left.tokens, pair.right_tokens
    for i, t, a, b in zip(full, spaced, left, right):
        data = t.encode()
        if a and b and b"".join([right_bytes[x] for x in b]) == data and b"".join([left_bytes[x] for x in a]) == data:
            usable.append(i)
            left_ids += a
            right_ids += b
            left_n.append(len(a))
            right_n.append(len(b))
    out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
    if usable:
        a_ids, b_ids = np.array(left_ids, np.int64), np.array(right_ids, np.int64)
        a_starts, b_starts = (np.concatenate([[0], np.cumsum(n)]) for n in (left_n, right_n))
        # Ends in one row of all documents' bytes: they rise over the whole batch.
        groups = merge(np.cumsum(pair.lengths[0][a_ids]), np.cumsum(pair.lengths[1][b_ids]), a_starts, b_starts)
        bounds = np.searchsorted(groups[0], a_starts)
        n_links = np.concatenate([[0], np.cumsum((groups[1] - groups[0]) * (groups[3] - groups[2]))])
        shown = _shown(pair, groups, a_ids, b_ids)
        group, codes, times = links(groups, a_ids, b_ids)
        doc = np.searchsorted(bounds, group, "right") - 1
        order = np.lexsort((codes, doc))
        doc, codes, times = doc[order], codes[order], times[order]
        fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (codes[1:] != codes[:-1])]))
        times, codes, doc = np.add.reduceat(times, fresh), codes[fresh], doc[fresh]
        cuts = np.searchsorted(doc, np.arange(len(usable) + 1))
        for d, i in enumerate(usable):
            text = b"".join(shown[a_starts[d] + b_starts[d] : a_starts[d + 1] + b_starts[d + 1]])[:-1]
            s, e = cuts[d], cuts[d + 1]
            counts = int(bounds[d + 1] - bounds[d]), int(n_links[bounds[d + 1]] - n_links[bounds[d]])
            out[i] = (left_n[d], right_n[d], *counts, hashlib.sha256(text).hexdigest(), codes[s:e], times[s:e])
    yield from out


def _shown(pair: Pair, groups: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> list[bytes]:
    """The texts of all ids in the order of the groups, each with the sign that follows it."""
    n, size = len(pair.left.tokens), len(pair.right_tokens)
    group = np.arange(groups.shape[1])
    a_group, b_group = (np.repeat(group, groups[i + 1] - groups[i]) for i in (0, 2))
    # A left token stands behind the right tokens of earlier groups, a right one behind the left ones up to its group.
    at_a, at_b = np.arange(len(a_ids)) + groups[2][a_group], np.arange(len(b_ids)) + groups[1][b_group]
    own_a, own_b = a_ids.copy(), b_ids + n
    own_a[groups[1] - 1] += n + size
    own_b[groups[3] - 1] += n + size
    row = np.empty(len(a_ids) + len(b_ids), np.int64)
    row[at_a], row[at_b] = own_a, own_b
    return list(map(pair.shown.__getitem__, row.tolist()))


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<struct<code:bigint,times:bigint>>"


def aligned(docs: DataFrame, key: str, text: str, byte_file: str, piece_file: str) -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, groups_sha256, pairs), one per document.

    `pairs` has each linked pair of ids once, as left id * 2 ** 32 + right id, with its number of
    links. A text that is null or empty, or that a tokenizer does not give back byte by byte, has no
    tokens: zeros, an empty digest and no pairs.
    """
    with open(piece_file, "rb") as f:
        model = f.read()
    spec = bpe.read_spec(byte_file)
    files, name = docs.sparkSession.sparkContext.broadcast((spec, model)), hash((spec, model))
    schema = T.StructType([T.StructField(key, docs.select(docs[key]).schema[0].dataType), *T.StructType.fromDDL(_COUNTS)])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for part in slices(batches, BATCH):
            if not part.num_rows:
                continue
            pair = pair or _pair(name, *files.value)
            *plain, codes, times = zip(*_walk(pair, part.column(1).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
            held = pa.StructArray.from_arrays([pa.array(np.concatenate([np.asarray(x, np.int64) for x in v])) for v in (codes, times)], ["code", "times"])
            arrays = [part.column(0), *[pa.array(c) for c in plain], pa.ListArray.from_arrays(pa.array(offsets), held)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Rows (code, n, best) of rows (code) that each stand for a document: its count and whether no pair of the same left id has more."""
    counts = pairs.groupBy("code").agg(F.count("*").alias("n")).withColumn("left", F.shiftright("code", 32))
    most = counts.groupBy("left").agg(F.max("n").alias("most"))
    return counts.join(most, "left").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of the largest counts, at most `most` of them, and the others: split at a power of two."""
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect())
    held, least = 0, 64
    for p in sorted(sizes, reverse=True):
        held += sizes[p]
        if held > most:
            break
        least = p
    return counts.filter(F.col("n") >= F.lit(2).cast("bigint") ** least), counts.filter(F.col("n") < F.lit(2).cast("bigint") ** least)


def align(docs: DataFrame, key: str, text: str, byte_file: str, piece_file: str, most: int = FREQUENT) -> DataFrame:
    """Rows (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one per document.

    A pair's count is the number of documents (rows) that hold it linked; `n_best` counts the links
    whose pair has the largest count of its left id, ties included, and `count_sum` adds up the
    counts over all links. Texts without tokens have zeros and an empty digest (see `aligned`).
    Null or repeated keys and repeated rows stay apart; no rows give no rows.
    """
    spark = docs.sparkSession
    path, count_path = work_path(spark, "aligned"), work_path(spark, "pair-counts")
    aligned(docs, key, text, byte_file, piece_file).withColumn("row_", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    own = [rows[c].alias(f"c{i}") for i, c in enumerate(rows.columns[:6])]
    held = rows.select(F.col("row_").alias("row"), F.explode("pairs").alias("p")).select("row", "p.code", "p.times")
    pair_counts(held.select("code")).write.parquet(count_path)
    often, seldom = _frequent(spark.read.parquet(count_path), most)
    known = held.join(F.broadcast(often), "code", "left")
    here = known.filter("n IS NOT NULL").select("row", "times", "n", "best")
    there = known.filter("n IS NULL").select("row", "code", "times").join(seldom, "code").select("row", "times", "n", "best")

    def added(links: DataFrame) -> DataFrame:
        return links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    sums = added(here).unionByName(added(there)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.select(F.col("row_").alias("row"), *own).join(sums, "row", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        F.col("c0").alias(key), F.col("c1").alias("n_a"), F.col("c2").alias("n_b"), F.col("c3").alias("n_groups"), F.col("c4").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), F.col("c5").alias("groups_sha256"),
    )
