"""Tables kept in files with catalogues: pages, search, run caps."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import ids, index as ix, pages, search
from sievework.sources import clustered


def records(spark, n, seed=1):
    rng = random.Random(seed)
    # Many records share a time, among them one of every tenth; some have none.
    rows = [(f"n{i:05d}", rng.choice([None, 50.0, *[float(rng.randrange(400)) for _ in range(12)]]), rng.choice("ab"), f"Subject {rng.randrange(60)}") for i in range(n)]
    return spark.createDataFrame(rows, "name string, mtime double, cat string, subj string")


def kept(spark, tmp_path, n=3000):
    rows = records(spark, n)
    folder = str(tmp_path / "index")
    late = F.substring("name", -1, 1) == "7"
    pages.add_to_index(rows.filter(~late), folder, rows_per_file=100)
    pages.add_to_index(rows.filter(late), folder, rows_per_file=100)
    return rows.cache(), folder


def same(a, b):
    return [tuple(r) for r in a.collect()] == [tuple(r) for r in b.select(*a.columns).collect()]


def test_pages_equal_those_of_the_whole_index(spark, tmp_path):
    rows, folder = kept(spark, tmp_path)
    total = len(clustered.catalogue(spark, folder).collect())
    for before, limit, name in [(0, 200, None), (50, 20, None), (50, 20, "n01000"), ("200", 1, None), (1, 50, None), (0.0, 5000, None), (-3, 7, None), ("x", 3, None), (399.5, 10, ""), (0.5, 10, None)]:
        page = pages.open_page(spark, folder, before, limit, name)
        want = ix.keyset_page(rows, before, limit, name)
        assert same(want.select("name", "mtime"), page), (before, limit, name)
    assert len(pages.open_page(spark, folder, 200, 20).inputFiles()) <= 6 < total
    assert len(pages.open_page(spark, folder).inputFiles()) <= 10
    since = pages.open_since(spark, folder, 390)
    assert len(since.inputFiles()) <= 4
    assert sorted(r["name"] for r in since.collect()) == sorted(r["name"] for r in ix.since_filter(rows, 390).collect())
    assert tuple(pages.index_size(spark, folder).first()) == (3000, 0.0, 399.0)


def test_a_whole_walk_meets_every_record_once(spark, tmp_path):
    rows, folder = kept(spark, tmp_path, 700)
    seen, before, name = [], 0, None
    while True:
        page = pages.open_page(spark, folder, before, 90, name).collect()
        page = [r for r in page if r["mtime"] is not None]
        if not page:
            break
        seen += [r["name"] for r in page]
        before, name = page[-1]["mtime"], page[-1]["name"]
        if before <= 0:
            break
    want = [r["name"] for r in rows.filter("mtime > 0").orderBy(F.desc("mtime"), "name").collect()]
    assert seen[: len(want)] == want


def test_late_rows_show_at_once_and_compaction_changes_nothing(spark, tmp_path):
    rows, folder = kept(spark, tmp_path, 900)
    opened = pages.open_page(spark, folder, 300, 30)
    before = [tuple(r) for r in opened.collect()]
    extra = spark.createDataFrame([("late", 299.5, "a", "S"), ("late2", None, "a", "S")], rows.schema)
    pages.add_to_index(extra, folder, rows_per_file=100)
    assert pages.open_page(spark, folder, 300, 30).first()["name"] == "late"
    whole = rows.unionByName(extra)
    pages.compact_index(spark, folder, rows_per_file=100)
    assert same(ix.keyset_page(whole, 300, 30).select("name", "mtime"), pages.open_page(spark, folder, 300, 30))
    assert pages.index_size(spark, folder).first()["total"] == 902
    # Who had opened a page before still reads what it had.
    assert [tuple(r) for r in opened.collect()] == before
    # A run without its commit does not show.
    extra.write.parquet(f"{folder}/dead/rows")
    assert pages.index_size(spark, folder).first()["total"] == 902


def test_empty_index_and_empty_additions(spark, tmp_path):
    rows = records(spark, 20)
    folder = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        pages.open_page(spark, folder)
    pages.add_to_index(rows.limit(0), folder)
    with pytest.raises(FileNotFoundError):
        pages.index_size(spark, folder)
    pages.add_to_index(rows, folder)
    pages.add_to_index(rows.limit(0), folder)
    assert pages.open_page(spark, folder, 0, 1000).count() == 20


SUBJECTS = ["Red Fox", "red foxes", "A fox, red", "İstanbul fox", "fo", "x", "", None, "Fox" * 300, "%_fox\\", "straße", "日本の狐", "aaaa", "aaa bbb aaa"]


def test_search_equals_the_filter_for_all_needles(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2], s) for i, s in enumerate(SUBJECTS * 3)], "i long, cat string, subj string")
    folder = str(tmp_path / "search")
    # In two additions; texts of the second are there already.
    search.add_to_search(rows.filter("i < 20"), folder, rows_per_file=10)
    search.add_to_search(rows.filter("i >= 20"), folder, rows_per_file=10)
    needles = ["fox", "red fox", "FOX", "fo", "x", "o", "xfo", "aaa", "aaaa", "aaaaa", "b a", "ß", "狐", "の狐", "%_f", "\\\\", "zzz", "foxz", " ", "", "a fox, red", "istanbul"]
    for cat in ("", "a"):
        for needle in needles:
            want = sorted(r["i"] for r in ix.search_filter(rows.filter("subj IS NOT NULL"), cat, needle).collect())
            assert sorted(r["i"] for r in search.search_index(spark, folder, cat, needle).collect()) == want, (cat, needle)


def test_search_verifies_few_records(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    # Every subject begins alike, so some grams are in all of them.
    rows = spark.createDataFrame([(i, "c", f"subject {w}") for i, w in enumerate(words)], "i long, cat string, subj string")
    folder = str(tmp_path / "search")
    search.add_to_search(rows, folder, rows_per_file=200)
    needle = f"t {words[5][:4]}"
    verified = search.candidate_records(spark, folder, needle)
    assert 1 <= verified.count() <= 30 and len(verified.inputFiles()) <= 15
    assert sorted(r["i"] for r in search.search_index(spark, folder, "", needle).collect()) == sorted(i for i, w in enumerate(words) if w.startswith(needle[2:]))
    # More ids than are chosen one by one: the same by a join.
    limit, search.CHOSEN = search.CHOSEN, 10
    try:
        assert search.search_index(spark, folder, "", "subject").count() == 3000
        assert search.search_index(spark, folder, "", "ab").count() == sum("ab" in w for w in words)
    finally:
        search.CHOSEN = limit


def capped(rows, max_rows, max_bytes):
    out, n, total = [], 0, 0
    for key, size in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        n, total = n + 1, total + (size or 0)
        if (max_rows is not None and n > max_rows) or (max_bytes is not None and total > max_bytes):
            break
        out.append((key, total))
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_run_cap_finds_the_cap_without_sorting_all(spark, kind):
    rng = random.Random(8)
    keys = rng.sample(range(10**6), 5000)
    rows = [(k if kind == "bigint" else f"k{k:07d}", rng.choice([0, 5, 5, 1000, None])) for k in keys] + [(None, 3)]
    df = spark.createDataFrame(rows, f"k {kind}, size bigint").repartition(4)
    whole = sum(s or 0 for _, s in rows)
    enough, ids.ENOUGH = ids.ENOUGH, 50
    try:
        for max_rows, max_bytes in [(700, None), (None, 30_000), (900, 100_000), (1, None), (0, None), (None, 2), (None, whole), (10**6, None), (5001, whole - 1)]:
            got = ids.run_cap(df, "k", "size", max_rows, max_bytes).select("k", "running_bytes").collect()
            assert sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0])) == capped(rows, max_rows, max_bytes), (max_rows, max_bytes)
        # What is sorted and written is about what is kept.
        assert df.filter(ids.cap_bound(df, "k", None, 700, None)).count() <= 700 + 700 // 8 + 50
        assert df.filter(ids.cap_bound(df, "k", "size", None, 30_000)).count() <= 2 * len(capped(rows, None, 30_000)) + 50
    finally:
        ids.ENOUGH = enough
    assert ids.run_cap(df.limit(0), "k", "size", 5, 5).count() == 0
    # All rows in one key but a few.
    same_key = spark.createDataFrame([(7, 1)] * 50 + [(8, 1)], "k bigint, size bigint")
    assert same_key.filter(ids.cap_bound(same_key, "k", "size", 10, None)).count() in (50, 51)
