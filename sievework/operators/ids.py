"""Dense ids, shard positions, shard fingerprints, run caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework import schema as S
from sievework.operators.ordering import ordered_positions, positions_within, running_sums


# Ranks up to which Spark filters before the shuffle: the default of
# spark.sql.optimizer.windowGroupLimitThreshold.
RANKED_FILTER = 1000


def dense_prompt_id(rows: DataFrame, subject: str = "prompt_subject") -> DataFrame:
    """(subject, prompt_id): 0-based id of the sorted distinct subjects.

    Only the distinct subjects are ordered. A null subject is an error.
    """
    checked = F.when(F.assert_true(F.col(subject).isNotNull()).isNull(), F.col(subject))
    subjects = rows.select(checked.alias(subject)).distinct()
    placed = ordered_positions(subjects, [subject], "prompt_id")
    return placed.withColumn("prompt_id", F.col("prompt_id").cast("int"))


def prompt_id_join(rows: DataFrame, prompt_ids: DataFrame, subject: str = "prompt_subject") -> DataFrame:
    return rows.join(prompt_ids, subject)


def shard_assign(rows: DataFrame, key: str = "id", rows_per_shard: int = S.ROWS_PER_SHARD) -> DataFrame:
    """(key, pos, shard, row): place in id order, shard number, row in the shard.

    Give it the id column alone, so that only ids are range partitioned.
    """
    placed = ordered_positions(rows, [key], "pos")
    return placed.withColumns(
        {
            "shard": F.floor(F.col("pos") / rows_per_shard).cast("int"),
            "row": (F.col("pos") % rows_per_shard).cast("int"),
        }
    )


def shard_totals(rows: DataFrame, size: str = "bytes", rows_per_shard: int = S.ROWS_PER_SHARD) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("shard_bytes")).select(
        "rows",
        F.ceil(F.col("rows") / rows_per_shard).cast("bigint").alias("shards"),
        "shard_bytes",
        (F.col("shard_bytes") / F.lit(2.0**30)).alias("shard_gib"),
    )


def row_hash(columns: Sequence[str]) -> Column:
    """Digest of the values that make a row what it is; null differs from empty.

    Each value is preceded by its length, so no two rows are written alike.
    """
    texts = [F.col(c).cast("string") for c in columns]
    shown = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit("="), t), F.lit("-")) for t in texts]
    return F.md5(F.concat(*shown))


def shard_fingerprints(placed: DataFrame, columns: Sequence[str], key: str = "id", build: str = "") -> DataFrame:
    """(shard, rows, fingerprint) over the ordered ids, the row values and the build inputs."""
    rows = placed.select(
        "shard", "pos", F.concat_ws(":", F.col(key), row_hash(columns)).alias("__item")
    )
    items = F.expr("listagg(__item, ',') WITHIN GROUP (ORDER BY pos)")
    return rows.groupBy("shard").agg(
        F.count("*").alias("rows"),
        F.sha2(F.concat(F.lit(build + "\n"), items), 256).alias("fingerprint"),
    )


def shard_reuse(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(shard, action): `reuse` the same content, `rebuild` it, or `drop` a shard no longer wanted."""
    old = stored.select("shard", F.col("fingerprint").alias("__old"))
    action = (
        F.when(F.col("fingerprint").isNull(), "drop")
        .when(F.col("fingerprint") == F.col("__old"), "reuse")
        .otherwise("rebuild")
    )
    return wanted.join(old, "shard", "full_outer").select("shard", action.alias("action"))


# Parts of the order key that a step of the threshold search tells apart, and rows of the part with
# the cap that end the search.
PARTS, ENOUGH = 32, 20_000


def cap_bound(rows: DataFrame, order: str, size: str | None, max_rows: int | None, max_bytes: int | None) -> Column:
    """A condition on the order key that holds for all rows up to a cap, and for few rows beyond it.

    A weighted threshold search: the part of the keys that holds the cap is cut at `PARTS` of its
    own keys, sums and counts of the pieces tell which of them the cap lies in, and so on until that
    piece is small. Each step reads the keys and sizes of the part and shuffles its sums only.
    """
    low, high, before = None, None, [0, 0]
    while True:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col(order) >= F.lit(low))
        if high is not None:
            inside = inside & (F.coalesce(F.col(order) < F.lit(high), F.lit(low is None)))
        part = rows.filter(inside).select(F.col(order).alias("key"), (F.col(size) if size else F.lit(0)).cast("bigint").alias("size"))
        # Keys by their hash: a sample of the part, the same each time.
        drawn = part.filter("key IS NOT NULL").orderBy(F.xxhash64("key"), "key").limit(16 * PARTS).collect()
        keys = sorted({r.key for r in drawn})
        cuts = sorted({keys[i * len(keys) // PARTS] for i in range(1, PARTS)} - {low}) if keys else []
        piece = sum((F.coalesce(F.col("key") >= F.lit(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
        sums = {r.piece: (r.n, r.size or 0) for r in part.groupBy(piece.alias("piece")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
        bounds, found = [low, *cuts, high], None
        for i in range(len(cuts) + 1):
            n, total = sums.get(i, (0, 0))
            over_rows = max_rows is not None and before[0] + n > max_rows
            over_bytes = max_bytes is not None and before[1] + total > max_bytes
            if over_rows or over_bytes:
                found = i, n
                break
            before = [before[0] + n, before[1] + total]
        if found is None:
            # The caps lie beyond this part.
            return F.lit(True) if high is None else F.coalesce(F.col(order) < F.lit(high), F.lit(True))
        i, n = found
        shrunk = (bounds[i], bounds[i + 1]) != (low, high)
        low, high = bounds[i], bounds[i + 1]
        if n <= max(ENOUGH, before[0] // 8) or not shrunk:
            return F.lit(True) if high is None else F.coalesce(F.col(order) < F.lit(high), F.lit(True))


def run_cap(
    rows: DataFrame,
    order: str,
    size: str,
    max_rows: int | None = None,
    max_bytes: int | None = None,
    subject: str | None = None,
    per_subject: int | None = None,
) -> DataFrame:
    """Rows of a run in `order` up to a row count and a byte count; first K rows per subject.

    The run stops at the first row that would pass a cap. Spark applies a ranked filter of few rows
    in every task before the shuffle; beyond `RANKED_FILTER` it does not, and the rank comes from
    range-sorted positions, so a large subject is spread over many tasks in both cases. Only rows up
    to about the cap are sorted and written (`cap_bound`). Sizes are not negative.
    """
    if subject is not None and per_subject is not None:
        if per_subject <= RANKED_FILTER:
            rank = F.row_number().over(Window.partitionBy(subject).orderBy(order))
            rows = rows.withColumn("__rank", rank).filter(F.col("__rank") <= per_subject).drop("__rank")
        else:
            placed = positions_within(rows, [subject], [order], "__rank")
            rows = placed.filter(F.col("__rank") < per_subject).drop("__rank")
    if max_rows is None and max_bytes is None:
        return rows
    rows = rows.filter(cap_bound(rows, order, size if max_bytes is not None else None, max_rows, max_bytes))
    summed = running_sums(
        rows, [order], {"running_rows": F.lit(1).cast("bigint"), "running_bytes": F.coalesce(F.col(size).cast("bigint"), F.lit(0))}
    )
    if max_rows is not None:
        summed = summed.filter(F.col("running_rows") <= max_rows)
    return summed.filter(F.col("running_bytes") <= max_bytes) if max_bytes is not None else summed
