"""Comparing a copy with its source, and a stored output with a fresh one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def verify_copy(
    source: DataFrame, copy: DataFrame, key: str, columns: Sequence[str], excluded: DataFrame | None = None,
    payload: str | None = None,
) -> DataFrame:
    """One row per finding: (id, finding, column_name, source_value, copy_value).

    Findings: missing, unexpected, excluded, duplicate (in the copy), source_duplicate, and one
    mismatch per differing column. Where an id has several rows, the smallest and the largest value
    of a column stand for them: if all equal the source's, both do, so no differing row is hidden,
    and the one that differs is shown. With `payload`, content is compared too, by length and
    SHA-256: findings length and digest.
    """

    def shown(df: DataFrame) -> DataFrame:
        values = {c: F.col(c).cast("string") for c in columns}
        if payload is not None:
            values |= {"length": F.octet_length(payload).cast("string"), "digest": F.sha2(F.col(payload).cast("binary"), 256)}
        return df.select(F.col(key).alias("id"), *[v.alias(f"__v_{c}") for c, v in values.items()])

    names = [*columns, *(["length", "digest"] if payload is not None else [])]

    def per_id(df: DataFrame, side: str) -> DataFrame:
        spans = []
        for c in names:
            # A null is a value of its own, below all others.
            marked = F.struct(F.col(f"__v_{c}").isNotNull().alias("known"), F.col(f"__v_{c}").alias("v"))
            spans += [F.min(marked)["v"].alias(f"__{side}_low_{c}"), F.max(marked)["v"].alias(f"__{side}_high_{c}")]
        return shown(df).groupBy("id").agg(F.count("*").alias(f"__{side}_n"), *spans)

    rows = per_id(source, "s").join(per_id(copy, "c"), "id", "full_outer")
    if excluded is not None:
        listed = excluded.select(F.col(key).alias("id")).distinct().withColumn("__ex", F.lit(True))
        rows = rows.join(listed, "id", "left")
    else:
        rows = rows.withColumn("__ex", F.lit(None).cast("boolean"))
    none = F.lit(None).cast("string")

    def finding(name: str, column=none, a=none, b=none):
        return F.struct(
            F.lit(name).alias("finding"), column.alias("column_name"),
            a.alias("source_value"), b.alias("copy_value"),
        )

    has_s, has_c, ex = F.col("__s_n").isNotNull(), F.col("__c_n").isNotNull(), F.col("__ex").isNotNull()
    checks = [
        F.when(has_s & ~has_c & ~ex, finding("missing")),
        F.when(~has_s & has_c, finding("unexpected")),
        F.when(ex & has_c, finding("excluded")),
        F.when(F.col("__c_n") > 1, finding("duplicate")),
        F.when(F.col("__s_n") > 1, finding("source_duplicate")),
    ]
    for c in names:
        s, t, low, high = (F.col(f"__{p}_{c}") for p in ("s_low", "s_high", "c_low", "c_high"))
        other = F.when(s.eqNullSafe(low), high).otherwise(low)
        name = c if c not in columns else "mismatch"
        checks.append(
            F.when(
                has_s & has_c & ~(s.eqNullSafe(low) & t.eqNullSafe(high)),
                finding(name, F.lit(c) if c in columns else none, s, other),
            )
        )
    return rows.select("id", F.inline(F.filter(F.array(*checks), lambda x: x.isNotNull())))


def drift_check(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, state): rows of the stored output that are `changed`, `missing` or `extra`."""
    values = [c for c in fresh.columns if c not in keys]

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.sha2(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}), 256).alias(name))

    both = digest(stored, "__old").join(digest(fresh, "__new"), list(keys), "full_outer")
    state = (
        F.when(F.col("__old").isNull(), "missing")
        .when(F.col("__new").isNull(), "extra")
        .when(F.col("__old") != F.col("__new"), "changed")
    )
    return both.withColumn("state", state).filter(F.col("state").isNotNull()).select(*keys, "state")


# Nodes that a step of the comparison tells apart, as a power of two; rows of a range that are
# compared one by one rather than told apart further.
NODE_BITS, RANGE_ROWS = 12, 50_000
# Nodes in all that one step may have.
MOST_NODES = 1 << 16


def _digests(df: DataFrame, keys: Sequence[str], values: Sequence[str], bits: int, within: Column) -> DataFrame:
    """(node, n, low, high) per range of key hashes: count and sums of the rows' hashes, whatever the order of rows."""
    row = F.xxhash64(F.to_json(F.struct(*keys, *values), {"ignoreNullFields": "false"}))
    hashed = df.filter(within).select(_node(keys, bits).alias("node"), row.alias("h"))
    return hashed.groupBy("node").agg(
        F.count("*").alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high")
    )


def _node(keys: Sequence[str], bits: int) -> Column:
    """The range of a row: the leading bits of its key's hash."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c).cast("string") for c in keys]), 64 - bits)


def differing_ranges(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> Column:
    """A condition that holds for all rows of the ranges of keys in which the tables differ, and for no others.

    The ranges form a tree over the hashes of the keys. A step compares the digests of the nodes
    below those that differ, so tables that are equal are told by one step, and what is shuffled is
    a digest per task and node. It ends when the ranges are small, or when most of them differ. Two
    different ranges have equal digests with a chance of about 2 ** -64.
    """
    bits, within, rows_before = NODE_BITS, F.lit(True), None
    while True:
        a, b = (_digests(df, keys, values, bits, within) for df in (left, right))
        both = a.alias("a").join(b.alias("b"), "node", "full_outer")
        same = F.lit(True)
        for c in ("n", "low", "high"):
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        # At most MOST_NODES rows.
        found = both.filter(~same).select("node", F.greatest(F.coalesce("a.n", F.lit(0)), F.coalesce("b.n", F.lit(0))).alias("n")).collect()
        if not found:
            return F.lit(False)
        within = _node(keys, bits).isin([r.node for r in found])
        rows = sum(r.n for r in found)
        room = (MOST_NODES // len(found)).bit_length() - 1
        if rows <= RANGE_ROWS or room < 2 or bits + room > 63 or (rows_before is not None and rows > rows_before // 2):
            return within
        bits, rows_before = bits + min(room, NODE_BITS), rows


def verify_ranges(
    source: DataFrame, copy: DataFrame, key: str, columns: Sequence[str], excluded: DataFrame | None = None, payload: str | None = None,
    repeats: bool = True,
) -> DataFrame:
    """The findings of `verify_copy`, comparing row by row only where digests of key ranges differ.

    Rows of excluded ids are compared too. `repeats` looks for ids that come more than once on both
    sides in equal rows, which no digest tells; it shuffles the ids. Without it the source's ids must
    be unique, and equal tables cost a scan of either side.
    """
    values = [*columns, *([payload] if payload is not None else [])]
    apart = differing_ranges(source, copy, [key], values)
    listed = None if excluded is None else excluded.select(F.col(key)).distinct()
    asked = listed
    if repeats:
        twice = source.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
        asked = twice if listed is None else listed.unionByName(twice).distinct()
    found = verify_copy(source.filter(apart), copy.filter(apart), key, columns, excluded, payload)
    if asked is None:
        return found
    rest = [df.filter(~apart).join(asked, key, "left_semi") for df in (source, copy)]
    return found.unionByName(verify_copy(*rest, key, columns, excluded, payload))


def drift_ranges(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of `drift_check`, comparing row by row only where digests of key ranges differ; keys are unique."""
    values = [c for c in fresh.columns if c not in keys]
    apart = differing_ranges(stored, fresh, keys, values)
    return drift_check(stored.filter(apart), fresh.filter(apart), keys)
