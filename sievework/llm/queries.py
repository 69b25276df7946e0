"""The registered queries of this subpackage and, where SQL can say it, the same result in SQL.

Each reads its whole table. Queries without SQL are tested against brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievework.llm import alignment, backoff, bpe, curriculum, decontaminate, hash_index, nn_descent, simhash, spelling, toxicity, url_filter, warc, wordpiece

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_digests(table(spark, sf_dir, "documents"), "doc_id", "text", path)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op8_curriculum")
def op8_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.placed(curriculum.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source"), "doc_id")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, "doc_id", "text", toxicity.train(docs, labels, "doc_id", "text", "toxic"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)

URL_SQL = rf"""
WITH cut AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
fits AS (
    SELECT cut.*, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS place
    FROM cut LEFT JOIN rules
    ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""


@query("op1_url_filter", URL_SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


WARC_SQL = f"""
WITH rows AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {warc.LEAST} AND page_id <> keeper THEN keeper END AS refers_to
FROM kept
"""


@query("op9_warc", WARC_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op2_nn_descent")
def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_hash_index")
def op3_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_index.search(table(spark, sf_dir, "embeddings"))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return wordpiece.lengths(table(spark, sf_dir, "documents"), "doc_id", "text", path)


_TOKENS = r"regexp_extract_all(lower_ascii, '[^\x20\x09-\x0D]+')"

BACKOFF_SQL = f"""
WITH low AS (
    SELECT doc_id, translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS lower_ascii FROM documents
), split AS (SELECT doc_id, {_TOKENS} AS words FROM low),
tokens AS (
    SELECT doc_id, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v
    FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM split)
), counted AS (
    SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
        count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
        count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest
    FROM tokens
), context AS (
    SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS cv FROM counted
), scored AS (
    SELECT doc_id, v IS NOT NULL AND c2 = 0 AS shortened,
        CASE WHEN v IS NOT NULL AND c2 > 0 THEN ln(c2 / cv)
            ELSE ln(greatest(c1, 1) / greatest(rest, 1)) + CASE WHEN v IS NOT NULL THEN ln({backoff.ALPHA}) ELSE 0 END END AS value
    FROM context
), summed AS (
    SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (shortened) AS n_shortened,
        sum(floor(value * {backoff.UNIT} + 0.5)::BIGINT)::BIGINT AS score_micro
    FROM scored GROUP BY doc_id
)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_shortened, 0) AS n_shortened, coalesce(score_micro, 0) AS score_micro
FROM documents LEFT JOIN summed USING (doc_id)
"""


@query("op7_backoff", BACKOFF_SQL)
def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), "doc_id", "text", slip=199)
    return spelling.group_variants(words)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '{}')".format(url_filter.UPPER, url_filter.LOWER, decontaminate.WORD)

LEAKS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
cut AS (
    SELECT item_id, words, least(len(words), {decontaminate.WINDOW}) AS size, unnest(range(1, len(words) - least(len(words), {decontaminate.WINDOW}) + 2)) AS i
    FROM items WHERE len(words) > 0
), windows AS (SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS w FROM cut),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM docs, sizes WHERE len(words) >= size),
hits AS (
    SELECT r, i, places.size, item_id FROM places JOIN windows
    ON windows.size = places.size AND array_to_string(words[i : i + places.size - 1], ' ') = w
), covered AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


@query("op12_decontamination", LEAKS_SQL)
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(docs, "doc_id", "text", items, "item_id", "text")


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_file, piece_file = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), "doc_id", "text", byte_file, piece_file)
