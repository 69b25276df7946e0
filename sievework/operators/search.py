"""Substring search of subjects through postings of their trigrams, with exact verification.

A text that contains a needle contains each of its trigrams. Postings (gram, id) are kept clustered
by gram, and the records clustered by the id of their lower-cased text, so a search opens the
posting files of its rarest grams, and the record files of the ids that have all of them. What
those hold is compared with the needle itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievework.operators.index import search_predicate
from sievework.session import freeze
from sievework.sources import clustered

# Letters of a gram; a shorter text is a gram of its own.
GRAM = 3
# Grams of a needle that are looked up: the rarest.
LOOKED_UP = 3
# Ids or grams up to which files are chosen one by one; beyond, all files are opened.
CHOSEN = 5_000


def grams_of(text: Column) -> Column:
    """The different grams of a text: all its trigrams, or the text itself if it has fewer letters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.filter(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))), lambda g: g != "")


def add_to_search(rows: DataFrame, folder: str, text: str = "subj", rows_per_file: int = 100_000) -> None:
    """Adds records, postings and gram counts below `folder`; rows of a null text are never found.

    Each different text of the rows is indexed once, however many records have it. A gram of very
    many texts is spread over files by the ids.
    """
    keyed = rows.filter(F.col(text).isNotNull()).withColumn("text_id", F.xxhash64(F.lower(text)))
    tie = F.xxhash64(*[c for c, kind in rows.dtypes if kind != "variant" and "map<" not in kind])
    texts = keyed.select("text_id", F.lower(text).alias("t")).distinct()
    postings = freeze(texts.select(F.explode(grams_of(F.col("t"))).alias("gram"), "text_id").distinct())
    clustered.append(postings, f"{folder}/postings", "gram", [F.col("gram"), F.col("text_id")], rows_per_file)
    counts = postings.groupBy("gram").agg(F.count("*").alias("n"))
    clustered.append(counts, f"{folder}/grams", "gram", [F.col("gram")], rows_per_file)
    # Records last: a search finds a record only when its text is indexed.
    clustered.append(keyed, f"{folder}/records", "text_id", [F.col("text_id"), tie], rows_per_file)


def _spanning(values: list):
    """Files whose span holds one of the values."""

    def choose(catalogue: DataFrame) -> DataFrame:
        listed = F.array(*[F.lit(v) for v in values])
        return catalogue.filter(F.exists(listed, lambda v: (v >= F.col("low")) & (v <= F.col("high"))))

    return choose


def candidates(spark: SparkSession, folder: str, needle: str) -> DataFrame:
    """Ids (text_id) of the texts that can hold the lower-cased needle: all that do, and few others."""
    if len(needle) < GRAM:
        # Every text that holds it has a gram that does.
        holding = clustered.rows_of(spark, f"{folder}/grams").filter(F.contains("gram", F.lit(needle))).select("gram")
        few = [r.gram for r in holding.limit(CHOSEN + 1).collect()]
        postings = clustered.rows_of(spark, f"{folder}/postings", _spanning(few) if len(few) <= CHOSEN else None)
        found = postings.filter(F.col("gram").isin(few)) if len(few) <= CHOSEN else postings.join(holding, "gram", "left_semi")
        return found.select("text_id").distinct()
    wanted = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})[:CHOSEN]
    counts = clustered.rows_of(spark, f"{folder}/grams", _spanning(wanted)).filter(F.col("gram").isin(wanted))
    # At most CHOSEN rows; a gram that no text has settles the search.
    found = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()
    rarest = [r.gram for r in found[:LOOKED_UP]] if len(found) == len(wanted) else []
    postings = clustered.rows_of(spark, f"{folder}/postings", _spanning(rarest)).filter(F.col("gram").isin(rarest))
    return postings.groupBy("text_id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rarest)).select("text_id")


def candidate_records(spark: SparkSession, folder: str, needle: str) -> DataFrame:
    """The records of the candidate texts, which the search verifies."""
    ids = candidates(spark, folder, needle)
    few = [r.text_id for r in ids.limit(CHOSEN + 1).collect()]
    if len(few) > CHOSEN:
        return clustered.rows_of(spark, f"{folder}/records").join(ids, "text_id", "left_semi")
    return clustered.rows_of(spark, f"{folder}/records", _spanning(few)).filter(F.col("text_id").isin(few))


def search_index(spark: SparkSession, folder: str, category: str = "", text: str = "") -> DataFrame:
    """The records that `search_filter` gives for category and text, with all their columns.

    An empty text takes every record with one.
    """
    needle = text.strip().lower()
    rows = candidate_records(spark, folder, needle) if needle else clustered.rows_of(spark, f"{folder}/records")
    return rows.filter(search_predicate(category, text)).drop("text_id")
