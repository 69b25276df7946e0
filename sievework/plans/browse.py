"""The browsing index over artifacts made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievework.operators import index as ix, pages, search
from sievework.plans.registry import query
from sievework.plans.views import IDX, IMG, img, index, sidecar_raw
from sievework.session import work_path

# 2024-01-15 12:00:00 UTC, a time inside the given events.
MIDDLE = 1705320000.0


@query(
    "index_projection",
    f"""WITH {IMG} SELECT id || '.png' AS name, '/output/' || id || '.png' AS url,
    CASE WHEN k < 30 THEN '?' ELSE category END AS cat, CASE WHEN k < 30 THEN id ELSE prompt_subject END AS subj,
    CAST(CASE WHEN k < 30 THEN 0 ELSE width END AS BIGINT) AS w, CAST(CASE WHEN k < 30 THEN 0 ELSE height END AS BIGINT) AS h,
    mtime_us FROM img""",
)
def index_projection(spark, sf):
    raw = (
        F.when(F.col("k") < 20, F.concat(F.lit("{"), sidecar_raw()))
        .when(F.col("k") < 30, '{"category": "", "prompt_subject": null, "width": "x", "height": 7}')
        .otherwise(sidecar_raw())
    )
    rows = img(spark, sf).withColumn("stem", F.col("id"))
    payloads = rows.select("stem", F.concat("id", F.lit(".png")).alias("name"), F.col("mtime_us").alias("mtime"))
    out = ix.index_projection(payloads, rows.filter("k >= 10").select("stem", raw.alias("raw")))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("w", "h")}).withColumnRenamed("mtime", "mtime_us")


@query(
    "newest_first_rank",
    f"WITH {IDX} SELECT name, mtime_us, row_number() OVER (ORDER BY mtime DESC, name) AS rank FROM idx",
)
def newest_first_rank(spark, sf):
    return ix.newest_first_rank(index(spark, sf).select("name", "mtime", "mtime_us")).drop("mtime")


@query("initial_page", f"WITH {IDX} SELECT name, mtime_us FROM idx ORDER BY mtime DESC, name LIMIT 200")
def initial_page(spark, sf):
    return ix.initial_page(index(spark, sf)).select("name", "mtime_us")


@query(
    "keyset_page",
    f"""WITH {IDX},
    edge AS (SELECT name, mtime FROM idx WHERE mtime < {MIDDLE} ORDER BY mtime DESC, name LIMIT 1)
    (SELECT 'time' AS cursor, name, mtime_us FROM idx WHERE mtime < {MIDDLE} ORDER BY mtime DESC, name LIMIT 1000)
    UNION ALL
    (SELECT 'first' AS cursor, name, mtime_us FROM idx ORDER BY mtime DESC, name LIMIT 1)
    UNION ALL
    (SELECT 'time and name' AS cursor, name, mtime_us FROM idx WHERE mtime < {MIDDLE} OR (mtime = {MIDDLE} AND name > 'm')
     ORDER BY mtime DESC, name LIMIT 200)""",
)
def keyset_page(spark, sf):
    rows = index(spark, sf)

    def page(label: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(label).alias("cursor"), "name", "mtime_us")

    return (
        page("time", ix.keyset_page(rows, before=str(MIDDLE), limit=5000))
        .unionByName(page("first", ix.keyset_page(rows, before="none", limit=-3)))
        .unionByName(page("time and name", ix.keyset_page(rows, before=MIDDLE, limit="x", before_name="m")))
    )


def _kept_index(spark, sf) -> str:
    """The index in files of 500 records, the last tenth of the names added later."""
    folder, rows = work_path(spark, "index"), index(spark, sf)
    later = F.col("mtime_us") % 10 == 3
    for part in (rows.filter(~later), rows.filter(later)):
        pages.add_to_index(part, folder, rows_per_file=500)
    return folder


@query(
    "clustered_pages",
    f"""WITH {IDX}
    (SELECT 'time' AS cursor, name, mtime_us FROM idx WHERE mtime < {MIDDLE} ORDER BY mtime DESC, name LIMIT 1000)
    UNION ALL
    (SELECT 'first' AS cursor, name, mtime_us FROM idx ORDER BY mtime DESC, name LIMIT 200)
    UNION ALL
    (SELECT 'time and name' AS cursor, name, mtime_us FROM idx WHERE mtime < {MIDDLE} OR (mtime = {MIDDLE} AND name > 'm')
     ORDER BY mtime DESC, name LIMIT 200)
    UNION ALL SELECT 'since', name, mtime_us FROM idx WHERE mtime > {MIDDLE}
    UNION ALL SELECT 'size', NULL, count(*) FROM idx""",
)
def clustered_pages(spark, sf):
    """Pages, the feed and the count of an index that is kept clustered by time, after late additions."""
    folder = _kept_index(spark, sf)

    def shown(label: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(label).alias("cursor"), "name", "mtime_us")

    size = pages.index_size(spark, folder).select(F.lit("size").alias("cursor"), F.lit(None).cast("string").alias("name"), F.col("total").alias("mtime_us"))
    return (
        shown("time", pages.open_page(spark, folder, before=str(MIDDLE), limit=5000))
        .unionByName(shown("first", pages.open_page(spark, folder)))
        .unionByName(shown("time and name", pages.open_page(spark, folder, before=MIDDLE, limit="x", before_name="m")))
        .unionByName(shown("since", pages.open_since(spark, folder, MIDDLE)))
        .unionByName(size)
    )


@query("since_filter", f"WITH {IDX} SELECT name, mtime_us FROM idx WHERE mtime > {MIDDLE}")
def since_filter(spark, sf):
    return ix.since_filter(index(spark, sf), MIDDLE).select("name", "mtime_us")


@query(
    "search_filter",
    f"WITH {IDX} SELECT name, subj FROM idx WHERE cat = 'click' AND contains(lower(subj), 'subject #1')",
)
def search_filter(spark, sf):
    return ix.search_filter(index(spark, sf), "click", "  SUBJECT #1 ").select("name", "subj")


_NEEDLES = [("click", "  SUBJECT #1 "), ("", "t #14"), ("", "#9"), ("view", "7"), ("", "no such"), ("", "subject")]


@query(
    "search_index",
    f"WITH {IDX}, n(cat, needle) AS (VALUES {', '.join(f"('{c}', '{t.strip().lower()}')" for c, t in _NEEDLES)})"
    " SELECT needle, name, subj FROM idx JOIN n ON (n.cat = '' OR idx.cat = n.cat) AND contains(lower(subj), needle)",
)
def search_index(spark, sf):
    """Needles of all lengths, rare, common and absent, through the trigram postings."""
    folder = work_path(spark, "search")
    search.add_to_search(index(spark, sf), folder, rows_per_file=500)
    found = [
        search.search_index(spark, folder, cat, text).select(F.lit(text.strip().lower()).alias("needle"), "name", "subj")
        for cat, text in _NEEDLES
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


@query(
    "visible_counts",
    f"""WITH {IDX} SELECT count(*) FILTER (mtime > {MIDDLE} AND cat = 'view' AND contains(lower(subj), '2')) AS visible,
    count(*) FILTER (mtime > {MIDDLE}) AS loaded, count(*) AS total FROM idx""",
)
def visible_counts(spark, sf):
    return ix.visible_counts(index(spark, sf), F.col("mtime") > MIDDLE, ix.search_predicate("view", "2"))


@query(
    "totals",
    f"""WITH {IDX} SELECT name, (SELECT count(*) FROM idx) AS total FROM
    (SELECT name FROM idx ORDER BY mtime DESC, name LIMIT 200)""",
)
def totals(spark, sf):
    rows = index(spark, sf)
    return ix.totals(rows, ix.initial_page(rows)).select("name", "total")


@query(
    "feed_cursors",
    f"""WITH {IDX} SELECT max(mtime_us) AS newest, min(mtime_us) AS oldest FROM
    (SELECT mtime_us FROM idx ORDER BY mtime DESC, name LIMIT 200)""",
)
def feed_cursors(spark, sf):
    cursors = ix.feed_cursors(ix.initial_page(index(spark, sf)))
    return cursors.select(
        *[F.round(F.col(c) * 1000000).cast("bigint").alias(c) for c in ("newest", "oldest")]
    )


@query(
    "feed_payload",
    f"""WITH {IDX}, page AS (SELECT * FROM idx ORDER BY mtime DESC, name LIMIT 200)
    SELECT CAST((SELECT count(*) FROM idx) AS BIGINT) AS total, count(*) AS n,
    arg_max(name, mtime) AS first_name, arg_min(name, mtime) AS last_name, arg_max(subj, mtime) AS first_subj FROM page""",
)
def feed_payload(spark, sf):
    rows = index(spark, sf)
    payload = ix.feed_payload(ix.initial_page(rows), rows).select(
        F.from_json("payload", "images array<struct<name:string,subj:string>>, total bigint").alias("p")
    )
    return payload.select(
        "p.total",
        F.size("p.images").cast("bigint").alias("n"),
        F.element_at("p.images", 1)["name"].alias("first_name"),
        F.element_at("p.images", -1)["name"].alias("last_name"),
        F.element_at("p.images", 1)["subj"].alias("first_subj"),
    )
