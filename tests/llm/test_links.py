"""Spelling variants, decontamination and alignment against brute force, and their odd inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sievework.llm import alignment, decontaminate, spelling
from sievework.llm.queries import QUERIES
from tests.llm.odd import by, documents, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_counts(docs, slip, letters=6, least=5):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def brute_variants(counts, ratio=5):
    """Near words by their deletions: words one edit apart share one, or one is a deletion of the other."""
    meet = defaultdict(set)
    for w in counts:
        meet[w].add(w)
        for i in range(len(w)):
            meet[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    forms = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * n:
                forms[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), counts[forms[w]] if w in forms else None))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_match_brute_force(spark, sf_dir):
    docs = rows_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    got = QUERIES["op11_spelling_variants"](spark, sf_dir)
    assert got.columns == COLUMNS
    assert sorted(rows_of(got, *COLUMNS), key=lambda r: r[0]) == brute_variants(brute_counts(docs, 199))


def test_slips_are_many_when_asked(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = spelling.count_words(docs, "doc_id", "text", slip=3)
    assert dict(rows_of(words, "word", "n")) == brute_counts(rows_of(docs, "doc_id", "text"), 3)


def test_variants_of_anagrams_short_words_and_chains(spark):
    counts = {"a": 9, "b": 50, "ab": 300, "ba": 2, "abcdef": 1000, "abcdeg": 100, "abcdeh": 20, "abcdehi": 4, "fedcba": 7, "bacdef": 5, "aaaaaa": 3, "aaaaaaa": 15, "ßàéîöü": 6, "ßàéîöüÿ": 60, "x" * 50_000: 1, "x" * 50_001: 5}
    counts |= {"".join(p): 5 for p in [("abcde"[i:] + "abcde"[:i]) for i in range(5)]}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint").withColumn("sig", F.lit(1))
    assert sorted(rows_of(spelling.group_variants(words), *COLUMNS), key=lambda r: r[0]) == brute_variants(counts)


def test_variants_of_odd_rows(spark):
    docs = documents(spark)
    words = spelling.count_words(docs, "doc_id", "text", least_letters=3, least_count=1)
    assert dict(rows_of(words, "word", "n")) == brute_counts(rows_of(docs, "doc_id", "text"), 0, 3, 1)
    assert sorted(rows_of(spelling.group_variants(words), *COLUMNS), key=lambda r: r[0]) == brute_variants(brute_counts(rows_of(docs, "doc_id", "text"), 0, 3, 1))
    assert spelling.group_variants(spelling.count_words(empty(docs), "doc_id", "text")).count() == 0


# --- decontamination


def brute_leaks(docs, items, window=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for item, text in items:
        words = pattern.findall((text or "").translate(LOWER))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[i : i + size])].add(item)
    out = []
    for key, text in docs:
        words = pattern.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                names = windows.get(tuple(words[i : i + size]))
                if names is not None:
                    hit |= set(range(i, i + size))
                    found |= {str(n) for n in names if n is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(found), digest, bool(hit)))
    return by(out)


LEAKS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("bits", [decontaminate.MOST_BITS, 15])
def test_leaks_match_brute_force(spark, sf_dir, bits):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.decontaminate(docs, "doc_id", "text", items, "item_id", "text", most=bits)
    want = brute_leaks(rows_of(docs, "doc_id", "text"), rows_of(items, "item_id", "text"))
    assert by(rows_of(got, *LEAKS)) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_leaks_of_odd_rows(spark):
    long = " ".join(f"w{i % 7}" for i in range(5000))
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = [
        (1, passage), (1, passage), (2, "Zero " + passage.upper() + " 13"), (3, None), (4, ""), (5, " ,;. "), (6, long), (7, f"{passage} x {passage}"),
        (8, "two three four five six seven eight nine ten"), (9, "naïve  Ünïcode—text"), (10, "x" * 300_000 + " one two"), (None, "short item here"), (None, None), (11, "one " * 30),
    ]
    items = [(1, passage), (1, passage), (2, "short item"), (3, "item"), (4, None), (5, ""), (6, long[:200]), (7, "one one one one one one one one one one one"), (None, "naïve"), (8, passage + " x"), (10, "x" * 300_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row_", "hash", "words", "item", "n", "found", "t")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("doc_id", "words", "size")})
    assert by(rows_of(decontaminate.decontaminate(d, "doc_id", "text", i, "item_id", "text"), *LEAKS)) == brute_leaks(docs, items)
    clean = decontaminate.decontaminate(d, "doc_id", "text", empty(i), "item_id", "text")
    assert by(rows_of(clean, *LEAKS)) == brute_leaks(docs, [])
    assert decontaminate.decontaminate(empty(d), "doc_id", "text", i, "item_id", "text").count() == 0


# --- alignment


def plain_alignment(left_ends, right_ends):
    """Groups as (left indices, right indices), by the ends both have."""
    common = sorted(set(left_ends) & set(right_ends))
    out, a, b = [], 0, 0
    for end in common:
        left, right = [], []
        while a < len(left_ends) and left_ends[a] <= end:
            left.append(a)
            a += 1
        while b < len(right_ends) and right_ends[b] <= end:
            right.append(b)
            b += 1
        out.append((left, right))
    return out


def brute_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.bpe.byte_letters()
    held, counts = [], Counter()
    for key, text in docs:
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text, num_threads=1) if text else []
        a_bytes = [bytes(letters[c] for c in left.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            held.append((key, [], [], []))
            continue
        groups = plain_alignment(np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist())
        held.append((key, a, b, groups))
        counts.update({(a[x], b[y]) for left_side, right_side in groups for x in left_side for y in right_side})
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for key, a, b, groups in held:
        pairs = [(a[x], b[y]) for left_side, right_side in groups for x in left_side for y in right_side]
        shown = ";".join(f"{','.join(str(a[x]) for x in ls)}|{','.join(str(b[y]) for y in rs)}" for ls, rs in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        out.append((key, len(a), len(b), len(groups), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return by(out)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
FILES = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")]


def test_alignment_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_alignment(rows_of(docs, "doc_id", "text"))
    assert by(rows_of(QUERIES["op13_alignment"](spark, sf_dir), *ALIGNED)) == want
    # With few frequent pairs most counts come by the shuffled join.
    assert by(rows_of(alignment.align(docs, "doc_id", "text", *FILES, most=20), *ALIGNED)) == want


def test_alignment_of_odd_rows(spark):
    texts = [
        "<|endoftext|> <s> <0x0A> plain", "tab\tand\nline\r\n", "  two spaces  ", "▁ low line", "日本語のテキストと絵文字 👩‍👩‍👧 mixed", "Ünïcödé é ﬁ ½ ①", "a" * 3000,
        " " * 2500 + "end", "word " * 3000, "日本" * 1500, "\x00nul", "one", " ", "\n", "don't can't I'll 12345 3.14",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, "a row without a key"), (None, None), (20, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row_", "k", "code", "n", "pairs", "c0")})
    assert by(rows_of(alignment.align(docs, "doc_id", "text", *FILES), *ALIGNED)) == brute_alignment(rows)
    odd = documents(spark)
    assert by(rows_of(alignment.align(odd, "doc_id", "text", *FILES), *ALIGNED)) == brute_alignment(rows_of(odd, "doc_id", "text"))
    assert alignment.align(empty(docs), "doc_id", "text", *FILES).count() == 0


def test_merge_in_lanes_matches_plain_merge():
    rng = np.random.default_rng(5)
    for share in (0.02, 0.3, 0.9):
        left, right, a_starts, b_starts, want, base = [], [], [0], [0], [], 0
        for size in [1, 2, 5, 700, 3000, 1, 250]:
            ends = [np.unique(np.append(np.flatnonzero(rng.random(size) < share) + 1, size)) for _ in range(2)]
            for groups_left, groups_right in plain_alignment(ends[0].tolist(), ends[1].tolist()):
                want.append((a_starts[-1] + groups_left[0], a_starts[-1] + groups_left[-1] + 1, b_starts[-1] + groups_right[0], b_starts[-1] + groups_right[-1] + 1))
            left.append(ends[0] + base)
            right.append(ends[1] + base)
            a_starts.append(a_starts[-1] + len(ends[0]))
            b_starts.append(b_starts[-1] + len(ends[1]))
            base += size
        got = alignment.merge(np.concatenate(left), np.concatenate(right), np.array(a_starts), np.array(b_starts))
        assert [tuple(g) for g in got.T.tolist()] == want


def test_links_of_large_groups_match_plain_links():
    rng = np.random.default_rng(6)
    groups = np.array([[0, 3, 60], [3, 60, 61], [0, 1, 50], [1, 50, 130]])
    a, b = rng.integers(0, 9, 61), rng.integers(0, 9, 130)
    got, want = Counter(), Counter()
    for g, code, times in zip(*(x.tolist() for x in alignment.links(groups, a, b))):
        got[g, code] += times
    for g, (s, e, t, f) in enumerate(groups.T.tolist()):
        want.update((g, int(x) << 32 | int(y)) for x in a[s:e] for y in b[t:f])
    assert got == want
