"""Front matter, records, sections and line multisets."""

import dataclasses
import json
import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sievework.functions.frontmatter import front_matter_write, parse, with_front_matter
from sievework.operators import lines as ln, records as rc, verify
from sievework.schema import RECORD_FIELDS
from sievework.sources import readers, writers

RULES = rc.RecordRules(
    sections=(("doing", "In work"), ("held", "On hold"), ("dated", "By day"), ("red", "Failing")),
    areas=("north", "south", "east"),
    owners=("anna", "bots"),
    done="done", dated="dated", failing="red", waiting="held", main_owner="anna", root="cards",
    layout=rc.ReportLayout(("title", "due", "if(status = 'red', test, NULL)", "concat('at ', path)"), " / ", "[%s]", "-", "%d open and %d closed"),
)
BODY = "Some body.\n"


def record(**changes):
    base = {
        "title": "A card", "status": "doing", "area": "north", "due": None, "updated": "2031-03-09",
        "owner": "bots", "brief": "in one line", "refs": [], "test": None,
    }
    return {**base, **changes}


def written(data):
    """The model writer: one line per field, JSON for what may hold anything."""
    out = []
    for key, value in data.items():
        if isinstance(value, list):
            out += [f"{key}:", *(f"  - {json.dumps(v)}" for v in value)] if value else [f"{key}: []"]
        else:
            out.append(f"{key}: {json.dumps(value) if key in ('title', 'brief', 'test') else value or 'null'}")
    return "\n".join(["---", *out, "---", ""])


def parsed(spark, *cells):
    """cells: (path, text) pairs."""
    rows = [(p, os.path.basename(p)[: -len(".md")], t) for p, t in cells]
    return rc.parse_records(spark.createDataFrame(rows, "path string, slug string, text string"))


# A model of the grammar: a value is drawn together with a way to write it.

words = st.text(alphabet="abc xyz,:#é-", max_size=12)
keys = st.from_regex(r"[A-Za-z_][A-Za-z0-9_-]{0,6}", fullmatch=True)


def bare(v):
    ok = v == v.strip() and v not in ("", "null", "~") and v[0] not in "\"'["
    return v if ok else json.dumps(v)


def single(v):
    return "'" + v.replace("'", "''") + "'"


ways = st.sampled_from([bare, single, json.dumps])
scalars = st.one_of(
    st.tuples(st.none(), st.sampled_from(["", "~", "null", "  null "])).map(lambda x: (x[0], x[1])),
    st.builds(lambda v, way: (v, way(v)), words, ways),
)
items = st.builds(lambda v, way: (v, way(v)), words, st.sampled_from([single, json.dumps]))


@st.composite
def fields(draw):
    """(key, value, header lines) of one field."""
    key, form = draw(keys), draw(st.sampled_from(["scalar", "inline", "block"]))
    if form == "scalar":
        value, text = draw(scalars)
        return key, value, [f"{key}: {text}"]
    drawn = draw(st.lists(items, min_size=1, max_size=4))
    values = [v for v, _ in drawn]
    if form == "inline":
        gap = draw(st.sampled_from([",", ", ", " , "]))
        return key, values, [f"{key}: [{gap.join(t for _, t in drawn)}{draw(st.sampled_from(['', ' ', ', ']))}]"]
    return key, values, [f"{key}:", *(f"{draw(st.sampled_from(['  ', ' ']))}- {t}" for _, t in drawn)]


@settings(max_examples=300, deadline=None)
@given(st.lists(fields(), max_size=6, unique_by=lambda f: f[0]), st.sampled_from(["", "\n", "text\n---\nmore"]), st.booleans())
def test_parser_reads_what_the_model_writes(drawn, body, spaced):
    lines = [line for _, _, own in drawn for line in [*own, *([""] if spaced else [])]]
    got = parse("\n".join(["---", *lines, "---", body]))
    assert got.has_block and got.errors == [] and got.body == body and got.keys == [k for k, _, _ in drawn]
    assert {**got.scalars, **got.lists} == {k: v for k, v, _ in drawn}
    assert all(isinstance(v, list) for v in got.lists.values())


FAULTS = {
    "unreadable": "?? {key}", "bad-string": '{key}: "x', "open-quote": "{key}: 'x", "open-list": "{key}: [x", "repeated-key": "first: again",
}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([None, *FAULTS]), max_size=8))
def test_each_fault_is_told_with_its_line(kinds):
    lines = ["first: 1"] + [f"k{i}: {i}" if kind is None else FAULTS[kind].format(key=f"k{i}") for i, kind in enumerate(kinds)]
    got = parse("\n".join(["---", *lines, "---"]))
    assert [e.split(" ")[:2] for e in got.errors] == [[f"{i + 3}:", kind] for i, kind in enumerate(kinds) if kind]
    assert {k for k in got.keys if k != "first"} == {f"k{i}" for i, kind in enumerate(kinds) if kind is None}
    assert got.scalars["first"] == ("again" if "repeated-key" in kinds else "1")


def test_blocks_must_open_and_close():
    for text in (None, "", "x", "--- \na: b\n---\n", " ---\n---\n", "---\r\na: b\r\n---\r\n"):
        assert parse(text)[:1] + parse(text)[4:] == (False, text, ["no-header"])
    for text in ("---", "---\n", "---\na: b\n--- \n", "---\na: b\n ---"):
        assert parse(text)[:1] + parse(text)[4:] == (False, text, ["open-header"])
    for text in ("---\n---", "---\n---\n", "---\n\n \n---"):
        assert parse(text)[:5] == (True, [], {}, {}, "") and not parse(text).errors


def test_items_belong_to_the_empty_value_above():
    got = parse("---\n - lone\na: 1\n - x\nb:\n - y\n - 'z\nc: [p, \"q]\n---\n")
    assert got.errors == ["2:" + " unreadable  - lone", "4: unreadable  - x", "7: open-quote 'z", '8: bad-string "q']
    assert got.scalars == {"a": "1"} and got.lists == {"b": ["y"]} and got.keys == ["a", "b"]


def test_many_repeats_are_read_in_one_pass():
    got = parse("\n".join(["---", *(f"k: {i}" for i in range(50_000)), "---"]))
    assert got.scalars == {"k": "49999"} and len(got.errors) == 49_999


def test_round_trip(spark):
    data = record(title="tab\tand \\ and \"quotes\" – dash", refs=["a b", "c,d", 'e"f'], test="x <= 'y'")
    schema = ", ".join(f"{k} {'array<string>' if k == 'refs' else 'string'}" for k in RECORD_FIELDS)
    df = spark.createDataFrame([tuple(data[k] for k in RECORD_FIELDS), (None,) * len(RECORD_FIELDS)], schema)
    text = df.select(front_matter_write({k: F.col(k) for k in RECORD_FIELDS}).alias("text"))
    first, empty = with_front_matter(text).collect()
    assert first["errors"] == [] and first["body"] == "" and first["keys"] == RECORD_FIELDS
    assert {**first["scalars"], **first["lists"]} == data
    assert empty["lists"] == {"refs": []} and set(empty["scalars"].values()) == {None}


def broken():
    """(field, code, changed record) for every rule."""
    for key in ("title", "brief"):
        for value in ("", " \t"):
            yield key, "blank", written(record(**{key: value}))
    for key, value in (("status", "doin"), ("area", "North"), ("owner", "carl")):
        yield key, "not-allowed", written(record(**{key: value}))
        yield key, "absent", written({k: v for k, v in record().items() if k != key})
    for day in ("2031-3-09", "2031-02-29", "09.03.2031", "2031-03-09 "):
        yield "due", "not-a-day", written(record()).replace("due: null", f'due: "{day}"')
        yield "updated", "not-a-day", written(record()).replace("updated: 2031-03-09", f'updated: "{day}"')
    yield "brief", "several-lines", written(record(brief="one\ntwo"))
    yield "due", "needed-for", written(record(status="dated"))
    yield "test", "needed-for", written(record(status="red"))
    yield "test", "list", written(record(test="x")).replace('test: "x"', "test: [x]")
    yield "refs", "no-list", written(record()).replace("refs: []", "refs: one")
    yield "weight", "unknown", written({**record(), "weight": "3"})


def test_each_rule_fires_alone(spark):
    cells = [(f"cards/north/c{i}.md", text + BODY) for i, (_, _, text) in enumerate(broken())]
    cells += [("cards/north/Not_Kebab.md", written(record()) + BODY), ("cards/north/bare.md", written(record()) + "\n"), ("cards/north/ok.md", written(record()) + BODY)]
    found = {}
    for r in rc.validate_records(parsed(spark, *cells), RULES).collect():
        found.setdefault(os.path.basename(r["path"]), []).append(r["violation"])
    for i, (key, code, _) in enumerate(broken()):
        own = found.pop(f"c{i}.md")
        assert any(v.startswith(f"{key}: {code}") for v in own) and all(v.startswith(f"{key}: ") for v in own), own
    assert found == {"Not_Kebab.md": ["slug: form Not_Kebab"], "bare.md": ["body: blank"]}


def test_a_fault_stops_a_write(spark):
    good, bad = ("cards/north/ok.md", written(record()) + BODY), ("cards/north/b.md", written(record(area="west")) + BODY)
    assert rc.require_valid(parsed(spark, good), RULES).count() == 1
    with pytest.raises(Exception, match="area: not-allowed west"):
        rc.require_valid(parsed(spark, good, bad), RULES).collect()


def test_rules_can_be_added(spark):
    rules = dataclasses.replace(RULES, extra_rules=[(F.contains("body", F.lit("secret")), F.lit("body: secret"))])
    cells = [("cards/north/a.md", written(record()) + "a secret\n"), ("cards/north/b.md", written(record()) + BODY)]
    assert [tuple(r)[0::2] for r in rc.validate_records(parsed(spark, *cells), rules).select("path", "rank", "violation").collect()] == [("cards/north/a.md", "body: secret")]


CARDS = [
    ("north/a", record(title="Fifth", status="red", test="Case Nine")),
    ("south/b", record(title="First", status="dated", area="south", due="2031-04-01")),
    ("south/c", record(title="Third", status="dated", area="south", due="2031-05-01")),
    ("east/d", record(title="Second", status="held", area="east", owner="anna", due="2031-04-20")),
    ("east/e", record(title="Sixth", area="east")),
    ("done/north/f", record(title="Zero", status="done")),
]


def corpus(spark):
    """Each card's body names its file."""
    return parsed(spark, *[(f"cards/{p}.md", written(d) + f"Body of {p.upper()}\n") for p, d in CARDS])


def test_record_query(spark):
    found = rc.record_fields(corpus(spark))

    def search(keep, **kw):
        """The cards a search should find, in the order of due day and path."""
        got = [r["path"] for r in rc.record_query(found, **kw).collect()]
        want = sorted((d["due"] or "9999", f"cards/{p}.md") for p, d in CARDS if keep(p, d))
        assert got == [p for _, p in want] and got
        return got

    def open_(d):
        return d["status"] != "done"

    search(lambda p, d: open_(d))
    search(lambda p, d: True, show_all=True)
    for status in ("dated", "held", "done"):
        search(lambda p, d: d["status"] == status, status=status)
    search(lambda p, d: d["status"] in ("dated", "red"), status=" dated,red, ")
    search(lambda p, d: open_(d) and d["area"] in ("south", "east"), area="south, east")
    search(lambda p, d: d["owner"] == "anna", owner="anna")
    for day in ("2031-04-01", "2031-04-30"):
        search(lambda p, d: d["due"] and d["due"] <= day, due_before=day)
    search(lambda p, d: d["test"], test="NINE")
    search(lambda p, d: p == "east/e", grep="of EAST/e")
    for bad in ("April", "2031-04-31"):
        with pytest.raises(ValueError):
            rc.record_query(found, due_before=bad)


def test_grouped_report(spark):
    rows = rc.grouped_report(rc.record_fields(corpus(spark)), RULES).orderBy("section_rank", "line_rank").collect()
    text = [r["line"] for r in rows]
    assert text[0] == "5 open and 1 closed"
    for rank, (status, heading) in enumerate(RULES.sections, 1):
        own = [r["line"] for r in rows if r["section_rank"] == rank]
        cards = sorted((d["due"] or "9999", d["title"]) for _, d in CARDS if d["status"] == status)
        assert own[0] == f"[{heading}]" and len(own) == 1 + max(1, len(cards))
        assert all(title in line for (_, title), line in zip(cards, own[1:]))
    lines = {d["title"]: next(t for t in text if d["title"] in t) for _, d in CARDS if d["status"] != "done"}
    assert "Case Nine" in lines["Fifth"] and "2031-04-01" in lines["First"] and lines["First"].endswith(" / at cards/south/b.md")
    assert not any("Zero" in t for t in text) and not any("anna" in t for t in text)


def test_filing_and_drift(spark):
    """Every card filed in each of some places: it is misfiled in all but its own."""
    places = ["north", "south", "done/north", "done/south"]
    cells, want = [], set()
    for i, (status, area) in enumerate([("doing", "north"), ("done", "north"), ("doing", "south"), ("done", "south"), ("doing", "west")]):
        own = ("done/" if status == "done" else "") + area
        for j, place in enumerate(places):
            path = f"cards/{place}/card-{i}-{j}.md"
            cells.append((path, written(record(status=status, area=area)) + BODY))
            if place != own and area != "west":
                want.add((path, f"cards/{own}/card-{i}-{j}.md"))
    records = parsed(spark, *cells)
    assert {tuple(r) for r in rc.misfiled_records(records, RULES).collect()} == want
    assert rc.duplicate_keys(records).count() == 0
    again = records.unionByName(records.limit(1).withColumn("path", F.concat(F.lit("z/"), "path")))
    assert [(r["path"], r["prior"]) for r in rc.duplicate_keys(again).collect()] == [("z/" + cells[0][0], cells[0][0])]
    manifest = rc.record_manifest(rc.record_fields(records))
    assert [r["path"] for r in manifest.collect()] == sorted(p for p, _ in cells)
    assert verify.drift_check(manifest, manifest, ["path"]).count() == 0


def test_locale_order(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("A",)], "title string").withColumns(
        {"due": F.lit(None).cast("string"), "path": F.col("title")}
    )
    ranked = rc.order_due_title(df, locale=True).orderBy("rank")
    assert [r["title"] for r in ranked.collect()] == ["a", "A", "b", "B"]


def test_text_tree(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("top.md", "a/x.md", "a/b/y +1.md", "a/z.txt", "tree/w.md"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text of " + name)
    got = {r["path"]: (r["slug"], r["text"]) for r in readers.scan_text_tree(spark, str(root)).collect()}
    assert got == {
        "a/x.md": ("x", "text of a/x.md"),
        "a/b/y +1.md": ("y +1", "text of a/b/y +1.md"),
        "tree/w.md": ("w", "text of tree/w.md"),
    }


def sections(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    return ln.split_sections(df, ["doc"])


def test_sections_keep_every_line(spark):
    texts = ["# Top\n\n## Part\nkept line\n", "", "\n", "no heading", "## a\n## b\n\n\n", "x\n\n"]
    cut = ln.section_digest(sections(spark, *texts)).orderBy("doc", "idx").collect()
    whole = {}
    for r in cut:
        whole[r["doc"]] = whole.get(r["doc"], "") + r["text"]
    for i, text in enumerate(texts):
        assert whole.get(i, "") == (text if text.endswith("\n") or not text else text + "\n")
    first = [r for r in cut if r["doc"] == 0]
    assert [(r["section_id"], r["heading"], r["start_line"], r["line_count"], r["bytes"]) for r in first] == [
        ("S000", None, 1, 2, 7), ("S001", "## Part", 3, 2, 18)
    ]


def test_a_text_is_not_missing_from_its_own_sections(spark):
    text = "# T\n\n same \n## A\nsame\n## B\nsame\n"
    df = spark.createDataFrame([(0, text)], "doc int, text string")
    old = ln.line_multiset(ln.trimmed_lines(df, ["doc"]))
    new = ln.line_multiset(ln.trimmed_lines(ln.section_digest(ln.split_sections(df, ["doc"])), ["doc", "idx"]))
    assert ln.multiset_missing(old, new).count() == 0
    assert {tuple(r) for r in old.collect()} == {("# T", 1), ("same", 3), ("## A", 1), ("## B", 1)}


def test_missing_lines_count_repeats(spark):
    def bag(*lines):
        return ln.line_multiset(spark.createDataFrame([(x,) for x in lines], "line string"))

    missing = ln.multiset_missing(bag("aa", "aa", "bb"), bag("aa", "cc"))
    assert {tuple(r) for r in missing.collect()} == {("aa", 2, 1), ("bb", 1, 0)}


META = "doc int, heading string, disposition string, merge_into string, slug string, area string, status string, is_part boolean, first int, last int"


def test_routes(spark):
    cut = sections(spark, "# Top\n\n## Part\nfirst\nsecond\n## Same\nx\n## Odd\n## Lost\n## Bad\n")
    metas = spark.createDataFrame(
        [
            (0, None, "archive", None, None, None, None, False, None, None),
            (0, "## Part", "split", None, None, None, None, False, None, None),
            (0, "## Part", None, None, "one", "models", "next", True, 1, 2),
            (0, "## Part", None, None, "two", "models", "done", True, 3, 3),
            (0, "## Same", "file", None, "same", "ci", "next", False, None, None),
            (0, "## Odd", "merge", "## Same", None, None, None, False, None, None),
            (0, "## Bad", "merge", "## Part", None, None, None, False, None, None),
        ],
        META,
    )
    routes, errors = ln.route_sections(cut, metas, ["doc"])
    assert {(r["section_id"], r["first_line"], r["last_line"], r["target"], r["kind"], r["chunk_rank"]) for r in routes.collect()} == {
        ("S000", 1, 2, "archive", "archive", 0),
        ("S001", 3, 4, "models/one.md", "split", 0),
        ("S001", 5, 5, "done/models/two.md", "split", 0),
        ("S002", 6, 7, "ci/same.md", "file", 0),
        ("S003", 8, 8, "ci/same.md", "merge", 1),
    }
    assert {(r["heading"], r["error"]) for r in errors.collect()} == {
        ("## Lost", "no-route"), ("## Bad", "no-merge-file"),
    }
    twice = metas.unionByName(metas.filter("heading = '## Same'"))
    assert "repeated-heading" in {r["error"] for r in ln.route_sections(cut, twice, ["doc"])[1].collect()}


def test_uncovered_lines(spark):
    cut = sections(spark, "## Part\nfirst\nsecond\n\n")
    ranges = spark.createDataFrame([(0, 0, 1, 2)], "doc int, idx int, first int, last int")
    assert [r["n"] for r in ln.range_coverage(cut, ranges, ["doc", "idx"]).collect()] == [3]
    wide = spark.createDataFrame([(0, 0, 2, 2_000_000_000)], "doc int, idx int, first int, last int")
    assert ln.range_coverage(cut, wide, ["doc", "idx"]).count() == 0


def test_cut_ranges(spark):
    cut = sections(spark, "# Top\n\nnote\n\n## Part\n\nold\nnew\n")
    ranges = spark.createDataFrame([(0, 1, 3, 3)], "doc int, idx int, first bigint, last bigint")
    parts, errors = ln.cut_ranges(cut, ranges, ["doc", "idx"])
    got = {(r["idx"], r["kind"], r["abs_first"], r["abs_last"]) for r in parts.collect()}
    assert got == {(0, "keep", 1, 4), (1, "keep", 5, 6), (1, "cut", 7, 7), (1, "keep", 8, 8)}
    assert errors.count() == 0
    for bad in ([(2, 3), (3, 4)], [(3, 2)], [(0, 1)], [(2, 9)]):
        ranges = spark.createDataFrame([(0, 1, a, b) for a, b in bad], "doc int, idx int, first bigint, last bigint")
        parts, errors = ln.cut_ranges(cut, ranges, ["doc", "idx"])
        assert errors.count() >= 1 and parts.filter("idx = 1").count() == 0


def test_write_sections(spark, tmp_path):
    folder = str(tmp_path / "out")
    texts = ["a\n## b\nc\n", "## x\n\n\n## y", "lead\n"]
    writers.write_sections(ln.section_digest(sections(spark, *texts)), folder, ["doc"])
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/text").collect())
    assert [r[:3] for r in rows] == [(0, 0, "S000"), (0, 1, "S001"), (1, 0, "S000"), (1, 1, "S001"), (2, 0, "S000")]
    for doc, text in enumerate(texts):
        assert "".join(r[3] for r in rows if r[0] == doc) == (text if text.endswith("\n") else text + "\n")
    assert spark.read.json(f"{folder}/manifest").count() == len(rows)


def test_text_tree_below_a_folder_of_the_same_name(spark, tmp_path, monkeypatch):
    """Relative roots, and a root whose name comes earlier in the path."""
    root = tmp_path / "tree" / "x" / "tree"
    (root / "a").mkdir(parents=True)
    (root / "a" / "r.md").write_text("r")
    (root / "top.md").write_text("top")
    for given in (str(root), f"file:{root}", f"file://{root}/"):
        assert [r["path"] for r in readers.scan_text_tree(spark, given).collect()] == ["a/r.md"]
