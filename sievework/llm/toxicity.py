"""Toxicity by a factorization machine over hashed terms.

Besides a weight, each term has a short vector; the product of two vectors is the weight of the two
terms together, so an insult next to the mention of a group can count for more than both alone.
Terms are words and the beginnings of words, which inflected and compound forms have in common.

Training reads a bounded sample of labelled rows (`SAMPLE`), drawn by a hash of the key, and keeps
the `TERMS` hash values that tell the label 1 best, of those that do so by more than `GAIN`. Terms
that tell nothing alone enter by pairs: of the `FREQUENT` most frequent terms, those in a pair whose
four cases (both, one, the other, none) tell the labels apart by `PAIR_GAIN` more than its two terms
do. All are parameters, so model and training have a bounded size whatever the input. Every whole
text is then scored in place, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sievework.llm.common import map_rows, put_bounded, slices

SAMPLE = 20_000
TERMS = 2048
BITS = 24
FACTORS = 8
THRESHOLD = 0.3
# Least log-likelihood ratio of a term; chance alone seldom gives more.
GAIN = 3.5
# Terms whose pairs are looked at, and the least that a pair adds to its terms; among all their pairs
# chance hardly ever gives more.
FREQUENT = 512
PAIR_GAIN = 16.0
_STEPS = 2500
_BATCH = 128
_RATE = 0.02
_DECAY = 2e-5
_BEGINNINGS = (4, 5)
_WORD_CACHE = 500_000
_TERM = re.compile(r"[^\W_]+")


def terms_of(word: str, bits: int = BITS) -> list[int]:
    """Hash values of a word and of its beginnings."""
    parts = [word, *(f"{word[:n]}*" for n in _BEGINNINGS if len(word) >= n)]
    return [xxhash.xxh64_intdigest(p.encode()) >> (64 - bits) for p in parts]


def words(text: str | None) -> set[str]:
    """The distinct words of a whole text, in lower case."""
    return set(_TERM.findall((text or "").lower()))


@dataclass
class Model:
    """Weights by place; `places` finds the place of a hash value that the model knows."""

    places: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    bits: int = BITS

    def score(self, found: list[int]) -> float:
        """Probability of the label 1 for a text with the terms at these places."""
        v = self.factors[found]
        z = self.bias + self.weights[found].sum() + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35.0, 35.0))))


class Scorer:
    """Scores texts in one worker; where each word leads is kept in a bounded cache."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def __call__(self, text: str | None) -> float:
        known, places, bits, found = self.known, self.model.places, self.model.bits, []
        for word in words(text):
            own = known.get(word)
            if own is None:
                own = [places[h] for h in terms_of(word, bits) if h in places]
                put_bounded(known, word, own, _WORD_CACHE)
            if own:
                found += own
        return self.model.score(sorted(set(found)))


def fit(rows: list[tuple[list[int], int]], places: dict[int, int], factors: int = FACTORS, bits: int = BITS) -> Model:
    """Trains on (places, label) rows by Adam with a fixed seed: the same rows give the same model."""
    n, rng = len(places), np.random.default_rng(7)
    positive = sum(y for _, y in rows)
    prior = (positive + 0.5) / (len(rows) + 1) if rows else 0.0
    bias = float(np.log(prior / (1 - prior))) if rows else -35.0
    if not 0 < positive < len(rows):
        # One label only, or none: nothing to learn but how often it comes.
        return Model({}, bias, np.zeros(0), np.zeros((0, factors)), bits)
    theta = [np.array([bias]), np.zeros(n), rng.normal(0, 0.05, (n, factors))]
    first, second, step = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0
    batches, rare = -(-len(rows) // _BATCH), float(np.sqrt(max(1.0, (len(rows) - positive) / positive)))
    for _ in range(-(-_STEPS // batches)):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), _BATCH):
            batch = [rows[i] for i in order[start : start + _BATCH]]
            x = np.zeros((len(batch), n))
            for r, (found, _) in enumerate(batch):
                x[r, found] = 1
            y = np.array([label for _, label in batch], float)
            b, w, v = theta
            xv = x @ v
            z = b[0] + x @ w + 0.5 * ((xv**2).sum(axis=1) - (x @ v**2).sum(axis=1))
            # The rarer label counts for more, so that a single telling term is enough.
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * np.where(y == 1, rare, 1.0) / len(batch)
            gw = x.T @ g
            grads = [np.array([g.sum()]), gw + _DECAY * w, x.T @ (g[:, None] * xv) - v * gw[:, None] + _DECAY * v]
            step += 1
            for p, d, m1, m2, rate in zip(theta, grads, first, second, (_RATE, _RATE, _RATE / 5)):
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Model(places, float(theta[0][0]), theta[1], theta[2], bits)


def _told(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """What a case tells: sum of x ln(x / expected) over both labels, for rows in it per label."""
    both = ones + zeros
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log(x * (n0 + n1) / (both * max(n, 1))), 0.0) for x, n in ((ones, n1), (zeros, n0))]
    return parts[0] + parts[1]


def telling_pairs(held: np.ndarray, labels: np.ndarray, gain: float = PAIR_GAIN) -> np.ndarray:
    """Terms (columns of `held`) in a pair that tells the labels (0 or 1, by row) apart by `gain` more than its two terms do."""
    n = {y: int((labels == y).sum()) for y in (0, 1)}
    joint = {}
    for y in (0, 1):
        own, joint[y] = held[labels == y], np.zeros((held.shape[1], held.shape[1]))
        for start in range(0, len(own), 2048):
            x = own[start : start + 2048].astype(np.float32)
            joint[y] += x.T @ x
    alone = {y: joint[y].diagonal() for y in (0, 1)}
    cells = {y: [joint[y], alone[y][:, None] - joint[y], alone[y][None, :] - joint[y], n[y] - alone[y][:, None] - alone[y][None, :] + joint[y]] for y in (0, 1)}
    pair = sum(_told(a, b, n[1], n[0]) for a, b in zip(cells[1], cells[0]))
    single = _told(alone[1], alone[0], n[1], n[0]) + _told(n[1] - alone[1], n[0] - alone[0], n[1], n[0])
    more = pair - single[:, None] - single[None, :]
    np.fill_diagonal(more, 0)
    return np.flatnonzero((more >= gain).any(axis=1))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned."""
    return F.crc32(key.cast("string")) % 4 == 2


def train(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
    sample: int = SAMPLE, terms: int = TERMS, bits: int = BITS, frequent: int = FREQUENT,
) -> Model:
    """A model from the labelled rows that are not held out, at most about `sample` of them.

    A key with several labels has the largest; null labels and keys are no labels. Both tables are
    thinned by the same hash before they meet, so only sampled texts are shuffled. Terms
    that come more often with the label 1 are ranked by the likelihood ratio of their counts; of the
    `frequent` most frequent terms those join them that tell in a pair.
    """
    known = labels.filter(labels[key].isNotNull() & labels[label].isNotNull() & ~held_out(labels[key]))
    count = known.agg(F.count("*")).first()[0]
    if not count:
        return fit([], {}, bits=bits)
    parts = 1 << 20
    chosen = max(1, min(parts, sample * parts // count))

    def thin(df: DataFrame) -> DataFrame:
        return df.filter(F.pmod(F.xxhash64(df[key]), F.lit(parts)) < chosen)

    once = thin(known).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    picked = thin(docs).select(docs[key].alias("k"), docs[text].alias("t")).join(once, "k")

    def listed(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for t, y in tuples:
            yield sorted({h for w in words(t) for h in terms_of(w, bits)}), y

    hashed = map_rows(picked, ["t", "y"], "terms array<int>, y int", listed, 512)
    hashed = hashed.persist()
    size = {r["y"]: r["n"] for r in hashed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    per = hashed.select(F.explode("terms").alias("h"), "y").groupBy("h").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))

    def ratio(x: Column, of: int) -> Column:
        """x ln(x / expected) for one label."""
        return F.when(x > 0, x * F.log(x * (n0 + n1) / ((F.col("a") + F.col("b")) * max(of, 1)))).otherwise(0.0)

    best = per.filter(F.col("a") * max(n0, 1) > F.col("b") * max(n1, 1)).withColumn("gain", ratio(F.col("a"), n1) + ratio(F.col("b"), n0)).filter(F.col("gain") >= GAIN).orderBy(F.desc("gain"), "h").limit(terms)
    telling = [r["h"] for r in best.select("h").collect()]
    often = [r["h"] for r in per.orderBy(F.desc(F.col("a") + F.col("b")), "h").limit(frequent).collect()]
    told, slot = set(telling), {h: i for i, h in enumerate(often)}

    def marked(tuples: Iterator[tuple]) -> Iterator[tuple]:
        for found, y in tuples:
            flags = np.zeros(len(often), bool)
            flags[[slot[h] for h in found if h in slot]] = True
            yield [h for h in found if h in told], y, np.packbits(flags).tobytes()

    # A row is its telling terms and a bit for each frequent one.
    drawn = map_rows(hashed, ["terms", "y"], "terms array<int>, y int, bits binary", marked, 512).orderBy("terms", "y", "bits")
    rows = [(list(r["terms"]), r["y"], bytes(r["bits"])) for r in drawn.toLocalIterator()]
    hashed.unpersist()
    packed = np.frombuffer(b"".join(bits for _, _, bits in rows), np.uint8).reshape(len(rows), -(-len(often) // 8))
    held = np.unpackbits(packed, axis=1, count=len(often)).astype(bool)
    added = [i for i in telling_pairs(held, np.array([y for _, y, _ in rows], int)).tolist() if often[i] not in told]
    places = {h: i for i, h in enumerate([*telling, *(often[i] for i in added)])}
    found = sorted((sorted([*terms, *(often[i] for i in added if own[i])]), y) for (terms, y, _), own in zip(rows, held))
    return fit([([places[h] for h in terms], y) for terms, y in found], places, bits=bits)


def score(docs: DataFrame, key: str, text: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, held_out, score, predicted), one per input row.

    Null and empty texts have no terms and get the score of the bias. Null keys are not held out.
    Repeated rows get equal scores; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        scorer = Scorer(sent.value)
        for k, t in tuples:
            s = scorer(t)
            yield k, s, int(s >= threshold)

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    out = map_rows(docs, [key, text], f"k {kind}, score double, predicted int", rows)
    return out.select(F.col("k").alias(key), F.coalesce(held_out(F.col("k")), F.lit(False)).alias("held_out"), "score", "predicted")


def accept(docs: DataFrame, text: str, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns as they are."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for part in slices(batches):
            yield part.filter(pa.array([scorer(t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
