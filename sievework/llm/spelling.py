"""Spelling variants by PartEnum signatures over letter multisets.

A word is the set of its (letter, occurrence) elements, a binary vector. Words that differ by one
replaced letter have vectors at Hamming distance two and the same length; words that differ by one
inserted letter have distance one and lengths one apart. The elements are dealt to `PARTS`
partitions. Vectors at distance k differ in at most k partitions, so they agree in all partitions
but some k of them: a word has one signature for each choice of k partitions to leave out, tagged
with the length, and two near words have at least one signature in common. The signatures are
joined by equality, and each pair that meets is verified by its edit distance in the join itself.

Words built of the same syllables share many letters. One edit leaves the first or the last half of
a word as it is, so each signature is taken once with either half: near words still share one, and
anagrams and other words of the same letters no longer meet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import map_rows
from sievework.session import freeze

LETTERS = "a-zÀ-ÿ"
PARTS = 4
# Different words a task counts before it hands the counts on.
HELD = 100_000

_LEFT_OUT = [*combinations(range(PARTS), 2)]
_SAME, _SHORT, _LONG = range(3)
# The side of each signature of a word, in the order in which they are listed.
_SIDES = [s for s in [_SAME] * len(_LEFT_OUT) + [_SHORT] * PARTS + [_LONG] * PARTS for _ in range(2)]


def count_words(docs: DataFrame, key: str, text: str, least_letters: int = 6, least_count: int = 5, slip: int = 0) -> DataFrame:
    """Rows (word, n): how often each run of letters occurs in the whole texts, A-Z lower-cased.

    With `slip`, a run whose crc32 together with the row's key (`<key>:<run>`, a null key counts as
    empty) is divisible by it loses the letter at place crc32 % length. Runs with fewer than
    `least_letters` code points after that, or that come fewer than `least_count` times, do not
    count. Null texts have no runs; repeated rows count each time; no rows give no words.
    """
    pattern = re.compile(f"[{LETTERS}]{{{max(least_letters, 1)},}}")

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        counts: dict[str, int] = {}
        for k, t in tuples:
            if not t:
                continue
            # bytes.lower() changes A-Z only.
            found = Counter(pattern.findall(t.encode().lower().decode()))
            start = zlib.crc32(f"{'' if k is None else k}:".encode())
            for run, n in found.items():
                if slip and (h := zlib.crc32(run.encode(), start)) % slip == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < least_letters:
                        continue
                counts[run] = counts.get(run, 0) + n
            if len(counts) >= HELD:
                yield from counts.items()
                counts.clear()
        yield from counts.items()

    return map_rows(docs, [key, text], "word string, n bigint", rows).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _partitions(words: DataFrame) -> dict[str, int]:
    """The partition of each letter's first occurrence: the most frequent letters go to different ones.

    One row per letter comes to the driver, as many as the alphabet has.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    ranked = letters.orderBy(F.desc("count"), "letter").collect()
    return {row.letter: i % PARTS for i, row in enumerate(ranked)}


def signatures(words: Sequence[str], first: dict[str, int]) -> np.ndarray:
    """The signatures of each word (rows), by `_SIDES` (columns).

    An element (letter, occurrence) belongs to the partition after that of the occurrence before.
    A signature is the sum of the hashes of the partitions kept, of a half, of what is left out and
    of the length; an unlucky equal sum costs a comparison, not a result. A word and one that is a
    letter longer meet under the shorter one's length and halves, counted from either end.
    """
    digest = xxhash.xxh64_intdigest
    hashes, halves, lengths = np.empty((len(words), PARTS), np.uint64), np.empty((len(words), 4), np.uint64), np.empty(len(words), np.uint64)
    for at, word in enumerate(words):
        held: list[list[str]] = [[] for _ in range(PARTS)]
        seen: dict[str, int] = {}
        for letter in sorted(word):
            occurrence = seen[letter] = seen.get(letter, -1) + 1
            held[(first[letter] + occurrence) % PARTS].append(f"{letter}{occurrence}")
        hashes[at] = [digest(" ".join(h), p) for p, h in enumerate(held)]
        lengths[at] = size = len(word)
        own, less = size // 2, (size - 1) // 2
        halves[at] = [digest(word[:own], PARTS), digest(word[own:], PARTS + 1), digest(word[:less], PARTS), digest(word[less + 1 :], PARTS + 1)]
    total = hashes.sum(axis=1, dtype=np.uint64)

    def tagged(left_out: tuple[int, ...], length: np.ndarray, half: int) -> list[np.ndarray]:
        tag = (length * np.uint64(256) + np.uint64(sum(1 << p for p in left_out))) * np.uint64(0x9E3779B97F4A7C15)
        kept = total - hashes[:, left_out].sum(axis=1, dtype=np.uint64) + (tag ^ (tag >> np.uint64(29)))
        return [kept + halves[:, half], kept + halves[:, half + 1]]

    one = np.uint64(1)
    same = [s for out in _LEFT_OUT for s in tagged(out, lengths, 0)]
    short = [s for p in range(PARTS) for s in tagged((p,), lengths, 0)]
    long = [s for p in range(PARTS) for s in tagged((p,), lengths - one, 2)]
    return np.stack([*same, *short, *long], axis=1).view(np.int64)


def _signed(words: DataFrame) -> DataFrame:
    """Rows (sig, side, word, n)."""
    first = _partitions(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = signatures(batch.column(0).to_pylist(), first)
                offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, found.ravel())], ["word", "n", "sigs"])

    listed = words.select("word", "n").mapInArrow(run, "word string, n bigint, sigs array<bigint>")
    side = F.element_at(F.array(*[F.lit(s) for s in _SIDES]), F.col("place") + 1)
    return listed.select("word", "n", F.posexplode("sigs").alias("place", "sig")).select("sig", side.alias("side"), "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """Rows (a, b, a_n, b_n): every pair of words that differ by one inserted, deleted or replaced letter, once.

    `words` has one row (word, n) per word.
    """
    keyed = _signed(words)
    left = keyed.filter(F.col("side") != _LONG).select("sig", "side", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = keyed.filter(F.col("side") != _SHORT).select("sig", F.col("side").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    sides = ((F.col("side") == _SHORT) & (F.col("other") == _LONG)) | ((F.col("side") == _SAME) & (F.col("other") == _SAME) & (F.col("a") < F.col("b")))
    met = left.join(right, (left["sig"] == right["sig"]) & sides & (F.levenshtein("a", "b", 1) == 1))
    return met.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of the rows (word, form): the last word reached, in doubled steps.

    A form is `ratio` times as frequent as its word, so chains are short and have no cycles.
    """
    reached = freeze(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = freeze(reached.join(beyond, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            return reached


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one per row (word, n).

    `form` is the near word of largest n (ties: the smaller word) if that n is at least `ratio`
    times the word's, else null, with `form_n` its n; `root` is the word at the end of the chain of
    forms, the word itself if it has none; `n_near` counts the near words. `ratio` above 1.
    """
    words = freeze(words.select("word", "n"))
    pairs = near_words(words)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    near = pairs.select(F.explode(ways).alias("e")).select("e.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    formed = freeze(known.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")))
    roots = _roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
