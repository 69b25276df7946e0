"""The browsing index: projection, order, facets, search, pages and feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievework.operators.ordering import ordered_positions
from sievework.schema import MAX_PAGE_SIZE, PAGE_SIZE

NEWEST_FIRST = ("mtime", "name")


def _newest() -> list[Column]:
    return [F.col("mtime").desc(), F.col("name")]


def index_projection(payloads: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Index record per payload; a field that cannot be read keeps its default.

    Reading stops at the first bad field, so a bad width also leaves the height at 0.
    """
    rows = payloads.join(sidecars.select("stem", "raw"), "stem", "left")
    rows = rows.withColumn("__raw", F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")))

    def field(name: str) -> Column:
        return F.nullif(F.get_json_object("__raw", f"$.{name}"), F.lit(""))

    width, height = (field(n).try_cast("double").try_cast("int") for n in ("width", "height"))
    width_ok = field("width").isNull() | width.isNotNull()
    return rows.select(
        "name",
        F.concat(F.lit("/output/"), F.col("name")).alias("url"),
        F.coalesce(field("category"), F.lit("?")).alias("cat"),
        F.coalesce(field("prompt_subject"), F.col("stem")).alias("subj"),
        F.coalesce(width, F.lit(0)).alias("w"),
        F.when(width_ok, F.coalesce(height, F.lit(0))).otherwise(0).alias("h"),
        "mtime",
    )


def newest_first_rank(index: DataFrame) -> DataFrame:
    """Adds `rank`, 1 for the newest; equal times are ordered by name."""
    return ordered_positions(index, _newest(), "rank").withColumn("rank", F.col("rank") + 1)


def facets(index: DataFrame, category: str = "cat") -> DataFrame:
    return index.select(category).distinct().orderBy(category)


def totals(index: DataFrame, page: DataFrame) -> DataFrame:
    """The page with the full count beside every row."""
    return page.withColumn("total", index.agg(F.count("*").alias("n")).scalar())


def search_predicate(category: str, text: str) -> Column:
    """Category equality (empty takes all) and literal, case-blind substring of the subject."""
    needle = text.strip().lower()
    out = F.lit(True)
    if category:
        out = out & (F.col("cat") == category)
    if needle:
        out = out & F.contains(F.lower("subj"), F.lit(needle))
    return out


def search_filter(index: DataFrame, category: str = "", text: str = "") -> DataFrame:
    return index.filter(search_predicate(category, text))


def visible_counts(index: DataFrame, loaded: Column, visible: Column) -> DataFrame:
    return index.agg(
        F.count_if(loaded & visible).alias("visible"),
        F.count_if(loaded).alias("loaded"),
        F.count("*").alias("total"),
    )


def as_time(value: object) -> float:
    """Cursor argument as a number; anything unreadable is 0."""
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def since_filter(index: DataFrame, since: object = 0) -> DataFrame:
    return index.filter(F.col("mtime") > F.lit(as_time(since)))


def page_limit(limit: object = PAGE_SIZE) -> int:
    try:
        wanted = int(limit)
    except (TypeError, ValueError):
        wanted = PAGE_SIZE
    return max(1, min(wanted, MAX_PAGE_SIZE))


def initial_page(index: DataFrame) -> DataFrame:
    return index.orderBy(*_newest()).limit(PAGE_SIZE)


def keyset_page(
    index: DataFrame, before: object = 0, limit: object = PAGE_SIZE, before_name: str | None = None
) -> DataFrame:
    """The next page older than the cursor.

    The plain cursor is strict on time and loses rows that share the boundary time. With
    `before_name` the cursor is (time, name) and loses none.
    """
    at = as_time(before)
    rows = index
    if at > 0:
        older = F.col("mtime") < at
        if before_name is not None:
            older = older | ((F.col("mtime") == at) & (F.col("name") > before_name))
        rows = index.filter(older)
    return rows.orderBy(*_newest()).limit(page_limit(limit))


def feed_cursors(page: DataFrame) -> DataFrame:
    return page.agg(F.max("mtime").alias("newest"), F.min("mtime").alias("oldest"))


def feed_payload(page: DataFrame, index: DataFrame) -> DataFrame:
    """One JSON object for a page: its records and the full count.

    A page has at most `MAX_PAGE_SIZE` records; more fail the job before they are gathered. What a
    feed has to tell without bound goes out as `feed_lines`.
    """
    bounded = page.limit(MAX_PAGE_SIZE + 1)
    key = F.struct((-F.col("mtime")).alias("k"), F.col("name").alias("n"), F.struct(*page.columns).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["r"])
    images = F.when(F.count("*") <= MAX_PAGE_SIZE, ordered).otherwise(F.raise_error(F.lit(f"a page has at most {MAX_PAGE_SIZE} records")))
    total = index.agg(F.count("*").alias("n")).scalar()
    return bounded.agg(images.alias("images")).select(
        F.to_json(F.struct("images", total.alias("total")), {"ignoreNullFields": "false"}).alias("payload")
    )


def feed_lines(rows: DataFrame) -> DataFrame:
    """(mtime, name, line): each record as a JSON object of its own, for feeds of any length."""
    return rows.select("mtime", "name", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
