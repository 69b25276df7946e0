"""Pages, feeds and counts from an index that is kept clustered by time (`sources.clustered`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievework.operators.index import as_time, keyset_page, page_limit, since_filter
from sievework.schema import PAGE_SIZE
from sievework.sources import clustered


def _order():
    return [F.col("mtime"), F.col("name")]


def add_to_index(rows: DataFrame, folder: str, rows_per_file: int = 100_000) -> None:
    """Adds records to the index; a refresh writes what is new and reads nothing of what is there."""
    clustered.append(rows, folder, "mtime", _order(), rows_per_file)


def compact_index(spark: SparkSession, folder: str, rows_per_file: int = 100_000) -> None:
    clustered.compact(spark, folder, "mtime", _order(), rows_per_file)


def _page_files(before: object, limit: object, named: bool):
    """Which files a page needs.

    A file that lies wholly before the cursor counts for all its rows. Going back from the cursor
    file by file, as soon as such files hold a page, nothing older than the oldest of them can be in
    it. Each file has a row at least, so as many files as the page has rows are enough to look at.
    """
    at, wanted = as_time(before), page_limit(limit)

    def choose(catalogue: DataFrame) -> DataFrame:
        opened = catalogue
        sure = catalogue.filter("nulls = 0")
        if at > 0:
            opened = catalogue.filter(F.col("low") <= at if named else F.col("low") < at)
            sure = sure.filter(F.col("high") < at)
        held, oldest = 0, None
        for low, rows in sure.orderBy(F.desc("low"), "file").select("low", "rows").limit(wanted).collect():
            held, oldest = held + rows, low
            if held >= wanted:
                break
        return opened.filter(F.col("high") >= oldest) if held >= wanted else opened

    return choose


def open_page(
    spark: SparkSession, folder: str, before: object = 0, limit: object = PAGE_SIZE, before_name: str | None = None
) -> DataFrame:
    """The same page as `keyset_page` of the whole index, read from the files that can hold its rows.

    Without cursor it is the first page. Records without a time come last, as in the whole index.
    """
    rows = clustered.rows_of(spark, folder, _page_files(before, limit, before_name is not None))
    return keyset_page(rows, before, limit, before_name)


def open_since(spark: SparkSession, folder: str, since: object = 0) -> DataFrame:
    """What `since_filter` gives, from the files that reach beyond the time."""
    return since_filter(clustered.rows_of(spark, folder, lambda c: c.filter(F.col("high") > as_time(since))), since)


def index_size(spark: SparkSession, folder: str) -> DataFrame:
    """One row (total, oldest, newest), from the catalogue alone."""
    return clustered.catalogue(spark, folder).agg(F.sum("rows").alias("total"), F.min("low").alias("oldest"), F.max("high").alias("newest"))
