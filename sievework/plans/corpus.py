"""Lines, sections and records: corpora made of documents, orders and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework.functions.frontmatter import front_matter_write
from sievework.operators import lines as ln, records as rc, verify
from sievework.plans.registry import query, table
from sievework.plans.views import (
    DOC,
    LINES,
    RULES,
    SEC,
    TASK,
    TRIMMED,
    doc_manual,
    docs,
    section_texts,
    task_texts,
    tasks,
)
from sievework.session import freeze, work_path
from sievework.sources import files, readers, writers

# --- Text trees and lines --------------------------------------------------------------------------


@query(
    "scan_text_tree",
    """SELECT 'd' || page_id % 7 || '/page ' || page_id || '.md' AS path, 'page ' || page_id AS slug,
    md5(html) AS digest FROM pages WHERE url NOT LIKE '%#%'""",
)
def scan_text_tree(spark, sf):
    root = work_path(spark, "tree")
    page = F.concat(F.lit("page "), F.col("page_id"), F.lit(".md"))
    # Pages whose address has a fragment lie directly in the root and are not part of the tree.
    name = F.when(F.contains("url", F.lit("#")), page).otherwise(
        F.concat(F.lit("d"), F.col("page_id") % 7, F.lit("/"), page)
    )
    written = table(spark, sf, "pages").select(name.alias("name"), "html")
    files.write_files(written, root, "name", "html").write.format("noop").mode("overwrite").save()
    return readers.scan_text_tree(spark, root).select("path", "slug", F.md5("text").alias("digest"))


@query("explode_lines", f"WITH {LINES} SELECT doc_id, n, line FROM lines")
def explode_lines(spark, sf):
    rows = ln.explode_lines(table(spark, sf, "documents"), ["doc_id"])
    return rows.withColumn("n", F.col("n").cast("bigint"))


def _lines(spark, sf, which: str) -> DataFrame:
    """Trimmed lines of the older (source up to src14 in text order) or the newer documents."""
    older = F.col("source") < "src15"
    part = table(spark, sf, "documents").filter(older if which == "old" else ~older)
    return ln.trimmed_lines(part, ["doc_id"])


_TWO = TRIMMED + """,
old AS (SELECT line, count(*) AS n FROM trimmed WHERE source < 'src15' GROUP BY line),
new AS (SELECT line, count(*) AS n FROM trimmed WHERE source >= 'src15' GROUP BY line),
missing AS (
  SELECT old.line, old.n AS need, coalesce(new.n, 0) AS have FROM old LEFT JOIN new ON old.line = new.line
  WHERE coalesce(new.n, 0) < old.n
)"""


@query("line_multiset", f"WITH {TRIMMED} SELECT line, count(*) AS n FROM trimmed GROUP BY line")
def line_multiset(spark, sf):
    return ln.line_multiset(ln.trimmed_lines(table(spark, sf, "documents"), ["doc_id"]))


@query("multiset_missing", f"WITH {_TWO} SELECT line, need, have FROM missing")
def multiset_missing(spark, sf):
    old, new = (ln.line_multiset(_lines(spark, sf, w)) for w in ("old", "new"))
    return ln.multiset_missing(old, new)


@query(
    "missing_totals",
    f"""WITH {_TWO} SELECT CAST(sum(n) AS BIGINT) AS total_lines, count(*) AS distinct_lines,
    (SELECT count(*) FROM missing) AS missing_lines FROM old""",
)
def missing_totals(spark, sf):
    old, new = (ln.line_multiset(_lines(spark, sf, w)) for w in ("old", "new"))
    return ln.missing_totals(old, ln.multiset_missing(old, new))


@query(
    "multiset_gain",
    f"""WITH {_TWO}, r AS (SELECT doc_id, n, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS rn
      FROM trimmed WHERE source >= 'src15')
    SELECT doc_id, r.n, r.line FROM r LEFT JOIN old ON r.line = old.line WHERE rn > coalesce(old.n, 0)""",
)
def multiset_gain(spark, sf):
    base = ln.line_multiset(_lines(spark, sf, "old"))
    gained = ln.multiset_gain(_lines(spark, sf, "new"), base, ["doc_id", "n"])
    return gained.withColumn("n", F.col("n").cast("bigint"))


@query(
    "multiset_difference",
    f"""WITH {TRIMMED} SELECT line FROM trimmed WHERE source >= 'src15'
    EXCEPT ALL SELECT line FROM trimmed WHERE source < 'src15'""",
)
def multiset_difference(spark, sf):
    return ln.multiset_difference(_lines(spark, sf, "new"), _lines(spark, sf, "old"))


@query("multiset_union", f"WITH {TRIMMED} SELECT line, count(*) AS n FROM trimmed GROUP BY line")
def multiset_union(spark, sf):
    return ln.multiset_union(*[ln.line_multiset(_lines(spark, sf, w)) for w in ("old", "new")])


# --- Sections --------------------------------------------------------------------------------------


def _sections(spark, sf) -> DataFrame:
    return ln.split_sections(section_texts(spark, sf), ["doc_id"])


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("bigint").alias(n) if t == "int" else F.col(n) for n, t in df.dtypes])


@query(
    "split_sections",
    f"WITH {SEC} SELECT doc_id, idx, section_id, heading, start_line, line_count, joined AS text FROM sec",
)
def split_sections(spark, sf):
    rows = _longs(_sections(spark, sf))
    return rows.withColumn("text", F.array_join("lines", "\n")).drop("lines")


@query(
    "section_digest",
    f"""WITH {SEC} SELECT doc_id, section_id, heading, start_line, line_count,
    CAST(strlen(joined) + 1 AS BIGINT) AS bytes, sha1(joined) AS sha1 FROM sec""",
)
def section_digest(spark, sf):
    return _longs(ln.section_digest(_sections(spark, sf)).drop("text", "idx"))


@query(
    "write_sections",
    f"""WITH {SEC} SELECT doc_id, count(*) AS sections, CAST(sum(line_count) AS BIGINT) AS n_lines,
    CAST(sum(strlen(joined) + 1) AS BIGINT) AS n_bytes, sha1(string_agg(joined || chr(10), '' ORDER BY idx)) AS sha1
    FROM sec GROUP BY doc_id""",
)
def write_sections(spark, sf):
    """Written, read back and put together again: the digest is that of each whole document."""
    folder = work_path(spark, "sections")
    writers.write_sections(ln.section_digest(_sections(spark, sf)), folder, ["doc_id"])
    texts = spark.read.parquet(f"{folder}/text")
    # A document's sections are its own cell cut in pieces, so together they are one cell again.
    pieces = F.array_sort(F.collect_list(F.struct("idx", "text")))
    whole = texts.groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))
    manifest = spark.read.schema("doc_id bigint, section_id string, line_count int, bytes int").json(f"{folder}/manifest")
    counts = manifest.groupBy("doc_id").agg(
        F.count("*").alias("sections"), F.sum("line_count").alias("n_lines"), F.sum("bytes").alias("n_bytes")
    )
    return counts.join(whole.select("doc_id", F.sha1("text").alias("sha1")), "doc_id")


# Routing metadata by (doc_id, heading): the heading's length picks the disposition. Some headings
# have none, and the parts of a split section are lines 1-2 and the rest.
_METAS = SEC + """,
keyed AS (
  SELECT doc_id, heading, coalesce(length(heading), 0) AS h, min(heading) OVER (PARTITION BY doc_id) AS lead
  FROM (SELECT DISTINCT doc_id, heading FROM sec)
),
main AS (
  SELECT doc_id, heading, CASE WHEN heading IS NULL OR h % 7 = 0 THEN 'archive' WHEN h % 7 = 1 THEN 'split'
      WHEN h % 7 = 2 THEN 'merge' WHEN h % 7 = 3 THEN 'other' ELSE 'file' END AS disposition,
    CASE WHEN h % 7 = 2 THEN lead END AS merge_into, 'doc-' || doc_id || '-' || h AS slug, 'a' || h % 3 AS area,
    CASE WHEN h % 2 = 0 THEN 'done' ELSE 'next' END AS status, h
  FROM keyed WHERE heading IS NULL OR h % 11 <> 0
),
doubled AS (SELECT * FROM main WHERE h = 23),
j AS (
  SELECT sec.doc_id, sec.section_id, sec.heading, sec.start_line, sec.line_count, m.disposition, m.slug, m.area, m.status,
    t.disposition AS t_disposition, CASE WHEN t.status = 'done' THEN 'done/' ELSE '' END || t.area || '/' || t.slug || '.md' AS t_path,
    CASE WHEN m.status = 'done' THEN 'done/' ELSE '' END || m.area || '/' || m.slug || '.md' AS m_path, m.doc_id IS NOT NULL AS has
  FROM sec LEFT JOIN main m ON sec.doc_id = m.doc_id AND sec.heading IS NOT DISTINCT FROM m.heading
  LEFT JOIN main t ON m.doc_id = t.doc_id AND m.merge_into = t.heading
),
e AS (
  SELECT *, CASE WHEN NOT has THEN 'no-route'
    WHEN disposition = 'merge' AND coalesce(t_disposition, '') <> 'file' THEN 'no-merge-file'
    WHEN disposition = 'other' THEN 'no-such-disposition' END AS error FROM j
),
parts(first, last, suffix) AS (VALUES (1, 2, '-top'), (3, 1000000, '-rest'))"""


def _metas(spark, sf) -> DataFrame:
    h = F.coalesce(F.length("heading"), F.lit(0))
    headed = _sections(spark, sf).select("doc_id", "heading").distinct()
    lead = headed.groupBy("doc_id").agg(F.min("heading").alias("lead"))
    keyed = headed.join(lead, "doc_id").withColumn("h", h)
    kind = (
        F.when(F.col("heading").isNull() | (F.col("h") % 7 == 0), "archive")
        .when(F.col("h") % 7 == 1, "split").when(F.col("h") % 7 == 2, "merge")
        .when(F.col("h") % 7 == 3, "other").otherwise("file")
    )
    main = keyed.filter(F.col("heading").isNull() | (F.col("h") % 11 != 0)).select(
        "doc_id", "heading", kind.alias("disposition"),
        F.when(F.col("h") % 7 == 2, F.col("lead")).alias("merge_into"),
        F.concat_ws("-", F.lit("doc"), F.col("doc_id").cast("string"), F.col("h").cast("string")).alias("slug"),
        F.concat(F.lit("a"), F.col("h") % 3).alias("area"),
        F.when(F.col("h") % 2 == 0, "done").otherwise("next").alias("status"),
        F.lit(False).alias("is_part"), F.lit(0).alias("first"), F.lit(0).alias("last"), "h",
    )
    cuts = F.explode(
        F.array(
            F.struct(F.lit(1).alias("first"), F.lit(2).alias("last"), F.lit("-top").alias("suffix")),
            F.struct(F.lit(3).alias("first"), F.lit(1000000).alias("last"), F.lit("-rest").alias("suffix")),
        )
    )
    parts = main.filter("disposition = 'split'").drop("first", "last").withColumn("cut", cuts).select(
        "doc_id", "heading", "disposition", "merge_into", F.concat("slug", "cut.suffix").alias("slug"), "area", "status",
        F.lit(True).alias("is_part"), "cut.first", "cut.last", "h",
    )
    return main.unionByName(parts).unionByName(main.filter("h = 23")).drop("h")


@query(
    "route_sections",
    f"""WITH {_METAS}
    SELECT doc_id, section_id, start_line AS first_line, start_line + line_count - 1 AS last_line,
      CASE disposition WHEN 'file' THEN m_path WHEN 'merge' THEN t_path ELSE 'archive' END AS target, disposition AS kind,
      CAST(CASE WHEN disposition = 'merge' THEN 1 ELSE 0 END AS BIGINT) AS chunk_rank
    FROM e WHERE error IS NULL AND disposition <> 'split'
    UNION ALL
    SELECT doc_id, section_id, start_line + first - 1, start_line + greatest(least(last, line_count), first - 1) - 1,
      CASE WHEN status = 'done' THEN 'done/' ELSE '' END || area || '/' || slug || suffix || '.md', 'split', 0
    FROM e, parts WHERE error IS NULL AND disposition = 'split'""",
)
def route_sections(spark, sf):
    return _longs(ln.route_sections(_sections(spark, sf), _metas(spark, sf), ["doc_id"])[0])


_ROUTED = f"""WITH {_METAS},
r AS (
    SELECT doc_id, section_id, heading, start_line, line_count, start_line AS first_line, start_line + line_count - 1 AS last_line,
      CASE disposition WHEN 'file' THEN m_path WHEN 'merge' THEN t_path ELSE 'archive' END AS target, disposition AS kind
    FROM e WHERE error IS NULL AND disposition <> 'split'
    UNION ALL
    SELECT doc_id, section_id, heading, start_line, line_count, start_line + first - 1, start_line + greatest(least(last, line_count), first - 1) - 1,
      CASE WHEN status = 'done' THEN 'done/' ELSE '' END || area || '/' || slug || suffix || '.md', 'split'
    FROM e, parts WHERE error IS NULL AND disposition = 'split'
), n AS (
    SELECT *, 1 AS n_targets, line_count >= 6 AND first_line <= start_line + line_count - 1 AND last_line >= start_line + 4 AS cut FROM r
    UNION ALL
    SELECT doc_id, section_id, any_value(heading), start_line, line_count, start_line, start_line + line_count - 1, NULL, 'whole', count(DISTINCT target), FALSE
    FROM r WHERE kind = 'split' GROUP BY doc_id, section_id, start_line, line_count
)
SELECT doc_id, section_id, first_line, last_line, heading, target, CAST(n_targets AS BIGINT) AS n_targets,
    concat_ws(', ', CASE kind WHEN 'merge' THEN 'merged' WHEN 'archive' THEN 'retired' WHEN 'whole' THEN 'split' END, CASE WHEN cut THEN 'cut' END) AS note
FROM n"""


@query("route_map", _ROUTED)
def route_map(spark, sf):
    """Where each section has gone; from the fifth line on, long sections had history that was cut."""
    sections = _sections(spark, sf)
    routes, _ = ln.route_sections(sections, _metas(spark, sf), ["doc_id"])
    archived = sections.filter("line_count >= 6").select(
        "doc_id", "section_id", (F.col("start_line") + 4).alias("first_line"), (F.col("start_line") + F.col("line_count") - 1).alias("last_line")
    )
    return _longs(ln.route_map(sections, routes, ["doc_id"], archived))


@query(
    "route_errors",
    f"""WITH {_METAS} SELECT doc_id, section_id, heading, error FROM e WHERE error IS NOT NULL
    UNION ALL SELECT doc_id, NULL, heading, 'repeated-heading' FROM doubled""",
)
def route_errors(spark, sf):
    return ln.route_sections(_sections(spark, sf), _metas(spark, sf), ["doc_id"])[1]


_RANGES = SEC + """,
cover AS (
  SELECT doc_id, idx, 1 AS first, 2 AS last FROM sec
  UNION ALL SELECT doc_id, idx, 5, line_count + 10 FROM sec WHERE line_count >= 6
),
cuts AS (
  SELECT doc_id, idx, 2 AS first, 3 AS last, line_count, start_line FROM sec WHERE line_count >= 4
  UNION ALL SELECT doc_id, idx, 6, line_count - 1, line_count, start_line FROM sec WHERE line_count >= 7
  UNION ALL SELECT doc_id, idx, 2, 5, line_count, start_line FROM sec WHERE line_count = 3
  UNION ALL SELECT doc_id, idx, 3, 4, line_count, start_line FROM sec WHERE line_count = 5
),
checked AS (
  SELECT *, coalesce(lag(last) OVER w, 0) + 1 AS next, lead(first) OVER w AS after FROM cuts
  WINDOW w AS (PARTITION BY doc_id, idx ORDER BY first, last)
),
judged AS (
  SELECT *, first < next OR last < first OR last > line_count AS bad,
    bool_or(first < next OR last < first OR last > line_count) OVER (PARTITION BY doc_id, idx) AS any_bad FROM checked
)"""


def _range(first, last):
    return F.struct(F.lit(first).alias("first") if isinstance(first, int) else first.alias("first"),
                    F.lit(last).alias("last") if isinstance(last, int) else last.alias("last"))


def _ranges(sections: DataFrame, *choices) -> DataFrame:
    listed = F.array(*[F.when(when, _range(first, last)) for when, first, last in choices])
    return sections.select("doc_id", "idx", F.inline(F.filter(listed, lambda r: r.isNotNull())))


@query(
    "range_coverage",
    f"""WITH {_RANGES}, w AS (SELECT d.doc_id, d.idx, d.n - sec.start_line + 1 AS n, line, regexp_replace(line, '^[\\s\\x0B\\p{{Z}}\\x{{FEFF}}]+|[\\s\\x0B\\p{{Z}}\\x{{FEFF}}]+$', '', 'g') AS t
      FROM numbered d JOIN sec ON d.doc_id = sec.doc_id AND d.idx = sec.idx)
    SELECT doc_id, idx, n, line FROM w WHERE n <> 1 AND t <> '' AND NOT EXISTS (
      SELECT 1 FROM cover c WHERE c.doc_id = w.doc_id AND c.idx = w.idx AND w.n BETWEEN c.first AND c.last)""",
)
def range_coverage(spark, sf):
    sections = _sections(spark, sf)
    count = F.col("line_count")
    ranges = _ranges(sections, (F.lit(True), 1, 2), (count >= 6, 5, count + 10))
    return _longs(ln.range_coverage(sections, ranges, ["doc_id", "idx"]))


def _cut(spark, sf):
    sections = _sections(spark, sf)
    count = F.col("line_count")
    ranges = _ranges(
        sections, (count >= 4, 2, 3), (count >= 7, 6, count - 1), (count == 3, 2, 5), (count == 5, 3, 4)
    )
    return ln.cut_ranges(sections, ranges, ["doc_id", "idx"])


@query(
    "cut_ranges",
    f"""WITH {_RANGES}, p AS (
      SELECT doc_id, idx, start_line, 'keep' AS kind, next AS first, first - 1 AS last FROM judged WHERE NOT any_bad AND next <= first - 1
      UNION ALL SELECT doc_id, idx, start_line, 'cut', first, last FROM judged WHERE NOT any_bad
      UNION ALL SELECT doc_id, idx, start_line, 'keep', last + 1, line_count FROM judged WHERE NOT any_bad AND after IS NULL AND last + 1 <= line_count
      UNION ALL SELECT doc_id, idx, start_line, 'keep', 1, line_count FROM sec
        WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.doc_id = sec.doc_id AND c.idx = sec.idx))
    SELECT doc_id, idx, kind, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last,
      CAST(start_line + first - 1 AS BIGINT) AS abs_first, CAST(start_line + last - 1 AS BIGINT) AS abs_last,
      CASE WHEN kind = 'cut' THEN '[archive: lines ' || (start_line + first - 1) || '..' || (start_line + last - 1) || ']' END AS pointer
    FROM p""",
)
def cut_ranges(spark, sf):
    return _longs(_cut(spark, sf)[0])


@query(
    "cut_errors",
    f"""WITH {_RANGES} SELECT doc_id, idx, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last,
    line_count FROM judged WHERE bad""",
)
def cut_errors(spark, sf):
    return _longs(_cut(spark, sf)[1])


# --- Records ---------------------------------------------------------------------------------------


def _records(spark, sf) -> DataFrame:
    return rc.parse_records(task_texts(spark, sf))


def _fields(spark, sf) -> DataFrame:
    return rc.record_fields(_records(spark, sf))


def _parsed_once(spark, sf) -> DataFrame:
    """The record fields, parsed and written once for queries that read them several times."""
    return freeze(_fields(spark, sf))


@query(
    "front_matter",
    f"""WITH {TASK} SELECT path, slug, title, status, area, due, updated, owner, brief, refs_text, test, body,
    CAST(0 AS BIGINT) AS n_errors FROM task""",
)
def front_matter(spark, sf):
    parsed = _records(spark, sf)
    refs = F.array_join(F.try_element_at("lists", F.lit("refs")), ";")
    scalars = [
        F.try_element_at("scalars", F.lit(c)).alias(c)
        for c in ("title", "status", "area", "due", "updated", "owner", "brief", "test")
    ]
    return parsed.select(
        "path", "slug", *scalars, F.nullif(refs, F.lit("")).alias("refs_text"), "body",
        F.size("parse_errors").cast("bigint").alias("n_errors"),
    )


@query(
    "front_matter_write",
    f"""WITH {TASK} SELECT path, '---' || chr(10) || 'title: ' || to_json(title) || chr(10) || 'status: ' || status || chr(10)
      || 'area: ' || area || chr(10) || 'due: ' || coalesce(due, 'null') || chr(10) || 'updated: ' || updated || chr(10)
      || 'owner: ' || owner || chr(10) || 'brief: ' || to_json(brief) || chr(10)
      || CASE WHEN refs_text IS NULL THEN 'refs: []' ELSE 'refs:' || chr(10) || '  - "' || split_part(refs_text, ';', 1) || '"' || chr(10)
           || '  - "' || split_part(refs_text, ';', 2) || '"' END || chr(10)
      || 'test: ' || coalesce(to_json(test)::VARCHAR, 'null') || chr(10) || '---' || chr(10) AS text FROM task""",
)
def write_front_matter(spark, sf):
    fields = ("title", "status", "area", "due", "updated", "owner", "brief", "refs", "test")
    text = front_matter_write({k: F.col(k) for k in fields})
    return tasks(spark, sf).select("path", text.alias("text"))


_VIOLATIONS = TASK + f""",
v AS (
  SELECT path, 1 AS rule, 'status: not-allowed ' || status AS violation FROM task WHERE status = 'pending'
  UNION ALL SELECT path, 2, 'area: not-allowed ' || area FROM task WHERE area = 'not specified'
  UNION ALL SELECT path, 3, 'due: not-a-day ' || due FROM task WHERE due = '2026-02-30'
  UNION ALL SELECT path, 4, 'due: needed-for scheduled' FROM task WHERE status = 'scheduled' AND due IS NULL
  UNION ALL SELECT path, 5, 'test: needed-for known-failure' FROM task WHERE status = 'known-failure' AND test IS NULL
  UNION ALL SELECT path, 6, 'slug: form ' || slug FROM task WHERE NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$')
  UNION ALL SELECT path, 7, 'body: blank' FROM task WHERE body = ''
)"""


@query(
    "validate_records",
    f"WITH {_VIOLATIONS} SELECT path, row_number() OVER (PARTITION BY path ORDER BY rule) - 1 AS rank, violation FROM v",
)
def validate_records(spark, sf):
    return _longs(rc.validate_records(_records(spark, sf), RULES))


@query(
    "misfiled_records",
    f"""WITH {_VIOLATIONS}, x AS (SELECT path, 'records/' || CASE WHEN status = 'done' THEN 'done/' ELSE '' END || area || '/' || slug || '.md' AS path_to
      FROM task WHERE path NOT IN (SELECT path FROM v))
    SELECT path AS path_from, path_to FROM x WHERE path <> path_to""",
)
def misfiled_records(spark, sf):
    return rc.misfiled_records(_records(spark, sf), RULES)


@query(
    "duplicate_keys",
    f"""WITH {TASK} SELECT path, slug, prior FROM (
      SELECT path, slug, lag(path) OVER (PARTITION BY slug ORDER BY path) AS prior FROM task) WHERE prior IS NOT NULL""",
)
def duplicate_keys(spark, sf):
    return rc.duplicate_keys(tasks(spark, sf))


@query(
    "record_query",
    f"""WITH {TASK}
    SELECT 'open, filtered' AS search, path, title, status, due FROM task WHERE status <> 'done' AND area IN ('data', 'docs')
      AND owner = 'agent' AND due <= '1998-06-30' AND (contains(lower(title), 'cust-1') OR contains(lower(brief), 'cust-1')
      OR contains(coalesce(lower(test), ''), 'cust-1') OR contains(coalesce(lower(refs_text), ''), 'cust-1') OR contains(lower(body), 'cust-1'))
    UNION ALL SELECT 'by test', path, title, status, due FROM task WHERE status = 'known-failure' AND contains(lower(test), 'case 1')
    UNION ALL SELECT 'all', path, title, status, due FROM task WHERE contains(lower(body), 'order 1') OR contains(lower(title), 'order 1')
      OR contains(lower(brief), 'order 1') OR contains(coalesce(lower(test), ''), 'order 1') OR contains(coalesce(lower(refs_text), ''), 'order 1')""",
)
def record_query(spark, sf):
    fields = _parsed_once(spark, sf)
    searches = {
        "open, filtered": rc.record_query(
            fields, area="data, docs,", owner="agent", due_before="1998-06-30", grep="CUST-1"
        ),
        "by test": rc.record_query(fields, status="known-failure", test="CASE 1"),
        "all": rc.record_query(fields, show_all=True, grep="order 1"),
    }
    out = None
    for name, found in searches.items():
        part = found.select(F.lit(name).alias("search"), "path", "title", "status", "due")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "order_due_title",
    f"WITH {TASK} SELECT path, row_number() OVER (ORDER BY due NULLS LAST, title, path) AS rank FROM task",
)
def order_due_title(spark, sf):
    return rc.order_due_title(tasks(spark, sf).select("path", "due", "title")).select("path", "rank")


@query(
    "status_counts",
    f"""WITH {TASK} SELECT count(*) FILTER (status <> 'done' OR area = 'cli') AS open_records,
    count(*) FILTER (status = 'done' AND area <> 'cli') AS done_records FROM task""",
)
def status_counts(spark, sf):
    """One area's records have lost their status."""
    return rc.status_counts(tasks(spark, sf).withColumn("status", F.when(F.col("area") != "cli", F.col("status"))))


@query(
    "grouped_report",
    f"""WITH {TASK}, s(section_rank, status, heading) AS (VALUES {', '.join(f"({i + 1}, '{a}', '{b}')" for i, (a, b) in enumerate(RULES.sections))}),
    body AS (SELECT section_rank, row_number() OVER (PARTITION BY section_rank ORDER BY
        CASE WHEN task.status = 'scheduled' THEN '' ELSE area END, due NULLS LAST, title, path) AS line_rank,
      concat_ws(' | ', '* ' || path || ': ' || title, brief, 'by ' || due, 'in ' || area,
        CASE WHEN task.status = 'known-failure' THEN 'see test ' || test END,
        CASE WHEN owner = 'owner' AND task.status <> 'waiting' THEN 'for the owner' END) AS line
      FROM task JOIN s ON task.status = s.status)
    SELECT CAST(section_rank AS BIGINT) AS section_rank, line_rank, line FROM body
    UNION ALL SELECT section_rank, 0, heading || ':' FROM s
    UNION ALL SELECT section_rank, 1, '* nothing' FROM s WHERE section_rank NOT IN (SELECT section_rank FROM body)
    UNION ALL SELECT 0, 0, count(*) FILTER (status <> 'done') || ' to do, ' || count(*) FILTER (status = 'done') || ' finished' FROM task""",
)
def grouped_report(spark, sf):
    return _longs(rc.grouped_report(_parsed_once(spark, sf).drop("body"), RULES))


@query(
    "record_manifest",
    f"""WITH {TASK} SELECT path, slug, title, status, area, due, updated, owner, brief, coalesce(refs_text, '') AS refs_text, test
    FROM task""",
)
def record_manifest(spark, sf):
    rows = rc.record_manifest(_parsed_once(spark, sf))
    return rows.withColumn("refs_text", F.array_join("refs", ";")).drop("refs")


_DRIFT = f"""WITH {TASK} SELECT path, CASE WHEN status = 'done' AND area = 'cli' THEN 'missing' WHEN status = 'waiting' THEN 'changed' END AS state
    FROM task WHERE (status = 'done' AND area = 'cli') OR status = 'waiting'
    UNION ALL SELECT 'old/' || path, 'extra' FROM task WHERE status = 'pending'"""


def _drifted(spark, sf) -> tuple:
    fresh = rc.record_manifest(tasks(spark, sf))
    kept = fresh.filter(~((F.col("status") == "done") & (F.col("area") == "cli")))
    edited = kept.withColumn(
        "title", F.when(F.col("status") == "waiting", F.concat("title", F.lit("!"))).otherwise(F.col("title"))
    )
    gone = fresh.filter("status = 'pending'").withColumn("path", F.concat(F.lit("old/"), "path"))
    return edited.unionByName(gone), fresh


@query("drift_check", _DRIFT)
def drift_check(spark, sf):
    return verify.drift_check(*_drifted(spark, sf), ["path"])


@query("drift_ranges", _DRIFT)
def drift_ranges(spark, sf):
    """The same rows through digests of key ranges."""
    return verify.drift_ranges(*_drifted(spark, sf), ["path"])


# --- Verification ----------------------------------------------------------------------------------


_FINDINGS = f"""WITH {DOC}, d AS (SELECT doc_id, source, lang, n_chars, doc_id IN (SELECT id FROM doc WHERE is_manual) AS ex,
      source = 'src3' AND lang = 'en' AS gone FROM documents)
    SELECT doc_id::VARCHAR AS id, 'missing' AS finding, NULL AS column_name, NULL AS source_value, NULL AS copy_value FROM d WHERE gone
    UNION ALL SELECT 'page-' || page_id, 'unexpected', NULL, NULL, NULL FROM pages
    UNION ALL SELECT doc_id::VARCHAR, 'excluded', NULL, NULL, NULL FROM d WHERE ex
    UNION ALL SELECT doc_id::VARCHAR, 'duplicate', NULL, NULL, NULL FROM d WHERE (source = 'src5' AND lang = 'en') OR (source = 'src7' AND lang = 'de')
    UNION ALL SELECT doc_id::VARCHAR, 'source_duplicate', NULL, NULL, NULL FROM d WHERE source = 'src6' AND lang = 'de'
    UNION ALL SELECT doc_id::VARCHAR, 'mismatch', 'n_chars', n_chars::VARCHAR, (n_chars + 5)::VARCHAR FROM d WHERE source = 'src7' AND lang = 'de'
    UNION ALL SELECT doc_id::VARCHAR, 'mismatch', 'n_chars', n_chars::VARCHAR, (n_chars + 1)::VARCHAR FROM d WHERE lang = 'es'
    UNION ALL SELECT doc_id::VARCHAR, 'mismatch', 'lang', lang, NULL FROM d WHERE source = 'src9' AND lang = 'fr'"""


def _compared(spark, sf) -> tuple:
    """A source, its copy with findings of all kinds, and the excluded ids."""
    source = docs(spark, sf).select(F.col("id").cast("string").alias("id"), "source", "lang", "n_chars")
    copy = source.filter(~((F.col("source") == "src3") & (F.col("lang") == "en"))).withColumns(
        {
            "n_chars": F.when(F.col("lang") == "es", F.col("n_chars") + 1).otherwise(F.col("n_chars")),
            "lang": F.when(~((F.col("source") == "src9") & (F.col("lang") == "fr")), F.col("lang")),
        }
    )
    again = copy.filter((F.col("source") == "src5") & (F.col("lang") == "en"))
    # A second copy that differs, and source rows that come twice.
    other = copy.filter((F.col("source") == "src7") & (F.col("lang") == "de")).withColumn("n_chars", F.col("n_chars") + 5)
    twice = source.filter((F.col("source") == "src6") & (F.col("lang") == "de"))
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id")).alias("id"), F.lit("p").alias("source"),
        F.lit("xx").alias("lang"), F.length("html").cast("bigint").alias("n_chars"),
    )
    excluded = doc_manual(spark, sf).select(F.col("id").cast("string").alias("id"))
    return source.unionByName(twice), copy.unionByName(again).unionByName(other).unionByName(pages), excluded


@query("verify_copy", _FINDINGS)
def verify_copy(spark, sf):
    source, copy, excluded = _compared(spark, sf)
    return verify.verify_copy(source, copy, "id", ["source", "lang", "n_chars"], excluded)


@query("verify_ranges", _FINDINGS)
def verify_ranges(spark, sf):
    """The same findings through digests of key ranges."""
    source, copy, excluded = _compared(spark, sf)
    return verify.verify_ranges(source, copy, "id", ["source", "lang", "n_chars"], excluded)
