"""BPE, word pieces, backoff, toxicity, fingerprints and mix against brute force, and on odd tables."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import backoff, bpe, curriculum, simhash, toxicity, wordpiece
from sievework.llm.queries import ORACLES, QUERIES
from tests.llm import odd
from tests.oracle import compare, connect

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    problem, rows = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name])
    assert problem is None, problem
    assert rows > 0


# BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def ours():
    return bpe.Vocabulary(bpe.read_spec(BPE))


def test_bpe_query_equals_library(spark, sf_dir, texts, library):
    def digest(s):
        return hashlib.sha256(s.encode()).hexdigest()

    got = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        row = got[doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), digest(",".join(map(str, ids))))
        assert row.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\taeth's01<|>")), max_size=60))
def test_bpe_equals_library_on_any_text(library, ours, text):
    text = text.replace("#", "<|endoftext|>")
    ids, listed = ours.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert listed == ",".join(map(str, ids.tolist()))
    assert ours.decode_text(ids) == text


def test_bpe_on_long_runs(library, ours):
    for text in ("a" * 4000, "ab" * 2000, "=" * 999, " " * 300 + "x", "<|endoftext|>" * 3):
        assert ours.encode(text)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.read_spec(PIECES))


def test_bpe_odd_rows(spark, ours):
    df = odd.documents(spark)
    got = bpe.encode(df, "doc_id", "text", BPE).collect()
    assert odd.by((r.doc_id, r.decoded) for r in got) == odd.by((r.doc_id, r.text or "") for r in df.collect())
    assert bpe.encode_digests(odd.empty(df), "doc_id", "text", BPE).count() == 0


# Word pieces


def greedy(vocabulary, word):
    rest, n = word + wordpiece.END, 0
    while rest:
        size = next((k for k in range(min(len(rest), 40), 0, -1) if rest[:k] in vocabulary), 0)
        if not size:
            return 0
        rest, n = rest[size:], n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=4), max_size=12), st.sets(st.text("abc", max_size=3), max_size=5), st.text("abc", max_size=12))
def test_automaton_equals_greedy(inner, last, word):
    vocabulary = {p.encode() for p in inner} | {p.encode() + wordpiece.END for p in last}
    assert wordpiece.Automaton(vocabulary).length(word.encode()) == greedy(vocabulary, word.encode())


def test_token_counts_query(spark, sf_dir, texts):
    vocabulary = set(wordpiece.pieces(bpe.read_spec(PIECES)))
    known = {}
    for r in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        words = WORD.findall(low(texts[r.doc_id]))
        for w in words:
            if w not in known:
                known[w] = greedy(vocabulary, w.encode())
        assert tuple(r)[1:] == (len(words), sum(known[w] or 1 for w in words), sum(not known[w] for w in words))


def test_token_counts_odd_rows(spark):
    df = odd.documents(spark)
    got = wordpiece.lengths(df, "doc_id", "text", PIECES).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((r.doc_id, len((r.text or "").encode().split())) for r in df.collect())
    assert wordpiece.lengths(odd.empty(df), "doc_id", "text", PIECES).count() == 0


# Stupid backoff


def brute_score(texts, order):
    """Per text the score of each word from counts of n-gram tuples over all other texts."""
    split = [WORD.findall(low(t)) for t in texts]
    grams = [[Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for w in split]
    every = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    total = sum(map(len, split))
    out = []
    for words, own in zip(split, grams):
        micro = short = 0
        for i in range(len(words)):
            top = min(i + 1, order)
            for k in range(top, 0, -1):
                gram = tuple(words[i - k + 1 : i + 1])
                c = every[k - 1][gram] - own[k - 1][gram]
                if k == 1:
                    value = math.log(max(c, 1) / max(total - len(words), 1))
                elif c > 0:
                    value = math.log(c / (every[k - 2][gram[:-1]] - own[k - 2][gram[:-1]]))
                else:
                    continue
                short += k < top
                micro += math.floor((value + (top - k) * math.log(backoff.ALPHA)) * backoff.UNIT + 0.5)
                break
        out.append((len(words), short, micro))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_odd_rows(spark, order, monkeypatch):
    df = odd.documents(spark)
    rows = df.select("doc_id", "text").collect()
    want = [(r.doc_id, *s) for r, s in zip(rows, brute_score([r.text for r in rows], order))]
    # Hot n-grams only, and buckets of a few bytes: both ways of answering give the same.
    for hot, size in ((2, 20_000), (50, 36_000_000), (10_000, 50_000)):
        monkeypatch.setattr(backoff, "HOT", hot)
        monkeypatch.setattr(backoff, "BUCKET_BYTES", size)
        monkeypatch.setattr(backoff, "HEAVY_SAMPLE", 1 if hot < 100 else 16)
        got = odd.by(backoff.score(df, "doc_id", "text", order).collect())
        assert [g[:3] for g in got] == [w[:3] for w in odd.by(want)]
        assert all(abs(g[3] - w[3]) <= g[1] for g, w in zip(got, odd.by(want)))
    assert backoff.score(odd.empty(df), "doc_id", "text", order).count() == 0


MEMORY = """
import pyarrow as pa
from pyspark.sql import functions as F
from sievework.llm import backoff
from sievework.session import build_session

spark = build_session("memory", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"})
word = lambda i: F.hex(F.pmod(F.xxhash64("id", i), F.lit(1 << 20)))
docs = spark.range(0, 15000, 1, 2).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), word), " ").alias("text"))
assert backoff.score(docs, "doc_id", "text").agg(F.sum("n_tokens")).first()[0] == 7_500_000

def peak(batches):
    kb = int(open("/proc/self/status").read().split("VmHWM:")[1].split()[0])
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"id": [kb] * batch.num_rows})

print("peak", max(r.id for r in spark.range(0, 8, 1, 2).mapInArrow(peak, "id long").collect()) // 1000)
"""


def test_backoff_holds_little_in_a_worker(tmp_path):
    """7.5 million words, nearly all n-grams distinct; a worker that is used again tells its peak."""
    run = subprocess.run([sys.executable, "-c", MEMORY], env={**os.environ, "PYTHONPATH": os.pathsep.join(sys.path), "TMPDIR": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert int(run.stdout.split("peak")[1]) < 600


@pytest.mark.parametrize("times", [1, 5])
def test_backoff_equal_rows_and_buckets_without_words(spark, times, monkeypatch):
    """Equal rows travel as one, in whatever batch they come; a bucket may hold no word at all."""
    monkeypatch.setattr(backoff, "BUCKET_BYTES", 10)
    texts = ["a b a b", "b a c", "", " ", None, "\x1f\u00a0 A"]
    df = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)] * times, "doc_id long, text string").repartition(3)
    rows = df.collect()
    want = odd.by([(r.doc_id, *s) for r, s in zip(rows, brute_score([r.text for r in rows], 3))])
    got = odd.by(backoff.score(df, "doc_id", "text", 3).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= g[1] for g, w in zip(got, want))


# Toxicity


def test_toxicity_query(spark, sf_dir, texts):
    import zlib

    got = QUERIES["op4_toxicity"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    again = {r.doc_id: r.score for r in QUERIES["op4_toxicity"](spark, sf_dir).collect()}
    assert all(again[r.doc_id] == r.score for r in got)


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_toxicity"](spark, d).collect() if r.held_out and r.doc_id in labels]
    hit = Counter((r.predicted, labels[r.doc_id]) for r in rows)
    assert hit[1, 1] / (hit[1, 1] + hit[0, 1]) > 0.8
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.9


def test_pairs_of_terms_are_learned():
    """Neither of two words alone, only both together: no additive weights can say so."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(2000):
        a, b = int(rng.random() < 0.5), int(rng.random() < 0.5)
        rows.append(([i for i, x in enumerate((a, b, int(rng.random() < 0.5))) if x], int(a != b)))
    model = toxicity.fit(rows, {0: 0, 1: 1, 2: 2})
    assert [model.score(s) > 0.5 for s in ([], [0], [1], [0, 1])] == [False, True, True, False]


@pytest.mark.parametrize("told", ["one of two", "both"])
def test_labels_that_only_a_pair_tells_are_learned(spark, told):
    """Each of the two words alone says nothing (or little); the rest is noise."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"noise{rng.randrange(300)}" for _ in range(12)] + ["river"] * a + ["candle"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a != b if told == "one of two" else a and b)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known, "doc_id", "text", "toxic")
    scored = [r for r in toxicity.score(docs, "doc_id", "text", model, 0.5).collect() if r.held_out]
    right = sum(r.predicted == labels[r.doc_id][1] for r in scored) / len(scored)
    assert len(scored) > 500 and right > 0.9, right


def test_pairs_that_tell_nothing_stay_out():
    rng = np.random.default_rng(3)
    held, labels = rng.random((4000, 60)) < 0.2, rng.integers(0, 2, 4000)
    assert toxicity.telling_pairs(held, labels).tolist() == []
    # Terms that come together and tell the same are no pair that tells more; two that tell together are.
    same = np.stack([labels == 1, labels == 1, labels == 0], axis=1)
    assert toxicity.telling_pairs(same, labels).tolist() == []
    assert toxicity.telling_pairs(held, (held[:, 4] ^ held[:, 9]).astype(int)).tolist() == [4, 9]
    for rows, terms in ((0, 3), (5, 1), (5, 0)):
        assert toxicity.telling_pairs(np.zeros((rows, terms), bool), np.zeros(rows, int)).tolist() == []


def test_toxicity_scores_are_those_of_all_pairs(spark, sf_dir):
    """The score of whole texts by a plain sum over terms and pairs of terms."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in toxicity.score(docs, "doc_id", "text", model).collect():
        found = sorted({model.places[h] for w in set(re.findall(r"[^\W_]+", (texts[row.doc_id] or "").lower())) for h in toxicity.terms_of(w) if h in model.places})
        z = model.bias + sum(model.weights[i] for i in found)
        z += sum(float(model.factors[i] @ model.factors[j]) for n, i in enumerate(found) for j in found[n + 1 :])
        assert row.score == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))), abs=1e-9)


def test_toxicity_odd_rows(spark):
    df = odd.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (4, 0), (7, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.train(df, known, "doc_id", "text", "toxic")
        got = toxicity.score(df, "doc_id", "text", model).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect())
        kept = toxicity.accept(df, "text", model)
        assert kept.schema == df.schema and kept.count() == sum(1 - r.predicted for r in got)
    assert toxicity.score(odd.empty(df), "doc_id", "text", model).count() == 0
    # Labels without documents, and documents without a term.
    assert toxicity.train(odd.empty(df), labels, "doc_id", "text", "toxic").places == {}
    assert toxicity.train(df.filter("text IS NULL OR doc_id = 4"), labels, "doc_id", "text", "toxic").places == {}


# SimHash


def brute_fingerprint(text, size=3):
    words = WORD.findall(low(text))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    ones = [sum(h >> b & 1 for h in map(lambda s: xxhash.xxh64_intdigest(s.encode(), 42), shingles)) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(keyed):
    """Smallest key reachable by steps of at most three bits."""
    prints = sorted({f for _, f in keyed})
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, f in keyed:
        if k is not None:
            least[find(f)] = min(least.get(find(f), k), k)
    return {f: least.get(find(f)) for f in prints}


def test_simhash_query(spark, sf_dir, texts):
    keyed = [(k, brute_fingerprint(t)) for k, t in texts.items()]
    component, prints = brute_components(keyed), dict(keyed)
    got = QUERIES["op5_simhash"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", component[prints[r.doc_id]])


def test_simhash_odd_rows(spark):
    df = odd.documents(spark)
    keyed = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    component = brute_components(keyed)
    want = odd.by((k, f"{f:016x}", component[f]) for k, f in keyed)
    assert odd.by(simhash.near_duplicates(df, "doc_id", "text").collect()) == want
    kept = simhash.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns and set(kept.collect()) <= set(df.collect())
    # One row of each group: of its smallest key, or of none where no row of the group has one.
    groups = Counter({component[f] for _, f in keyed if component[f] is not None})
    groups[None] = len({f for k, f in keyed if component[f] is None})
    assert Counter(r.doc_id for r in kept.collect()) == groups
    assert simhash.near_duplicates(odd.empty(df), "doc_id", "text").count() == 0
    assert simhash.keep_one(odd.empty(df), "doc_id", "text").count() == 0


@pytest.mark.parametrize("block", [2, 8, 4000])
def test_near_links_join_what_brute_force_joins(spark, block, monkeypatch):
    """Groups whose lists are long: near copies that agree in most bytes, chains, and random ones."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    prints = set(rng.integers(0, 2**64, 200, dtype=np.uint64).tolist())
    centre = int(rng.integers(0, 2**63))
    for _ in range(150):
        prints.add(centre ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 5), replace=False)))
    chain = int(rng.integers(0, 2**63))
    for _ in range(40):
        chain ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        prints.add(chain)
    keyed = [(i, p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for _, p in keyed], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(df, block).collect()]
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    want = brute_components(keyed)
    assert len({find(p) for p in prints}) == len(set(want.values()))
    assert all(want[a] == want[b] for a, b in edges)


def test_long_lists_by_flipping_bits():
    rng = np.random.default_rng(3)
    base = np.uint64(0x1234567890000000)
    fps = np.unique(base | rng.integers(0, 1 << 14, 3000, dtype=np.uint64))
    linked = simhash._flip(fps)
    both = simhash._compare(fps)

    def groups(links):
        label = list(range(len(fps)))
        for i, j in links:
            a, b = label[i], label[j]
            if a != b:
                label = [b if x == a else x for x in label]
        return len(set(label))

    assert groups(linked) == groups(both)


# Mix


def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    rest, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total >= 2 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            rest -= out[s]
            open_.remove(s)


def check_mix(rows, sources):
    sizes, taken = {}, Counter()
    for r in rows:
        sizes[sources[r.doc_id]] = sizes.get(sources[r.doc_id], 0) + r.size
        taken[sources[r.doc_id]] += r.taken
    want = brute_targets(sizes)
    for r in rows:
        s = sources[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken == r.pass_1 + r.pass_2 <= 2 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_curriculum_query(spark, sf_dir, docs, texts):
    sources = {r.doc_id: r.source for r in docs.collect()}
    rows = QUERIES["op8_curriculum"](spark, sf_dir).collect()
    assert {r.doc_id: r.size for r in rows} == {k: len(WORD.findall(t or "")) for k, t in texts.items()}
    check_mix(rows, sources)
    assert odd.by(rows) == odd.by(QUERIES["op8_curriculum"](spark, sf_dir).collect())
    # Times invert the integral of the schedule: by time x the words before have been asked for.
    first = sorted(sources.values())[0]
    target = next(r.target for r in rows if sources[r.doc_id] == first)
    events = sorted((t, n) for r in rows if sources[r.doc_id] == first for t, n in ((r.time_1, r.pass_1), (r.time_2, r.pass_2)) if t is not None)
    asked = 0
    for t, n in events:
        assert abs(target * (4 * t - t * t) / 3 - asked) < 1e-6 * target + 1e-6
        asked += n


def test_curriculum_odd_rows(spark):
    df = odd.documents(spark)
    rows = curriculum.mix(df, "doc_id", "text", "source").collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.collect())
    check_mix([r for r in rows if True], {1: "s1", 2: "s1", 3: "s2", 4: "s2", 5: None, 6: "s2", 7: "s3", None: None, 8: "s3", 9: "s3", 10: "s1"})
    placed = curriculum.in_order(df, "doc_id", "text", "source")
    assert placed.columns == df.columns
    assert set(placed.collect()) <= set(df.collect())
    assert curriculum.mix(odd.empty(df), "doc_id", "text", "source").count() == 0
    blank = df.filter("trim(coalesce(text, '')) = ''")
    assert {r.taken for r in curriculum.mix(blank, "doc_id", "text", "source").collect()} == {0}


@pytest.mark.parametrize("keys", ["distinct", "half null", "few", "all null"])
def test_every_row_has_a_plan_of_its_own(spark, keys):
    rng = random.Random(6)
    key_of = {"distinct": lambda i: i, "half null": lambda i: None if i % 2 else i, "few": lambda i: i % 3, "all null": lambda i: None}[keys]
    # Equal rows among them.
    rows = [(key_of(i), "w " * rng.choice([0, 1, 5, 9, 9, 20]), f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("n", "k", "t", "s", "key_", "row_")})
    placed = curriculum.in_order(df.repartition(4), "doc_id", "text", "source")
    assert placed.columns == df.columns
    taken, words = Counter(), Counter()
    for r in placed.collect():
        taken[r.source] += len(r.text.split())
        words[(r.doc_id, r.text, r.source)] += 1
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    asked = 1.5 * sum(sizes.values())
    targets, open_ = {}, dict(zip(sorted(sizes), (3, 1, 2)))
    while open_:
        shares = {s: asked * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if shares[s] > 2 * sizes[s]]
        for s in over or list(open_):
            targets[s] = 2 * sizes[s] if over else shares[s]
            open_.pop(s)
        asked -= sum(targets[s] for s in over)
    assert all(abs(taken[s] - targets[s]) <= 20 for s in sizes), (taken, targets)
    copies = Counter(rows)
    assert all(n <= 2 * copies[row] for row, n in words.items())


def test_schedules_must_have_an_area():
    for bad in (((0, 1), (0.5, 1)), ((0, 0), (1, 0)), ((0, 1), (1, -1))):
        with pytest.raises(ValueError):
            curriculum.check([bad])


def test_curriculum_query_sorts_by_training_position(spark, sf_dir, docs):
    rows = QUERIES["op8_curriculum"](spark, sf_dir).collect()
    turns = sorted((p, t) for r in rows for p, t in ((r.place_1, r.time_1), (r.place_2, r.time_2)) if t is not None)
    assert turns and [p for p, _ in turns] == list(range(len(turns)))
    assert [t for _, t in turns] == sorted(t for _, t in turns)
    assert all((r.place_1 is None) == (r.time_1 is None) and (r.place_2 is None) == (r.time_2 is None) for r in rows)


def test_curriculum_places_of_odd_rows(spark):
    df = odd.documents(spark)
    placed = curriculum.placed(curriculum.mix(df, "doc_id", "text", "source"), "doc_id")
    rows = placed.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.collect())
    places = sorted(p for r in rows for p in (r.place_1, r.place_2) if p is not None)
    assert places == list(range(sum(1 for r in rows for t in (r.time_1, r.time_2) if t is not None)))
    assert curriculum.placed(curriculum.mix(odd.empty(df), "doc_id", "text", "source"), "doc_id").count() == 0
