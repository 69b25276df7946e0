"""Mixing sources to target weights that change over the training run.

Each source has a weight schedule: points (time, weight) from time 0 to 1, linear in between. Its
integral is the source's share. Shares become targets in words; a target stops at `cap` times the
source's size, and the excess goes to the others by weight. Documents are taken in a hashed order,
pass after pass, until the target is met. The integrated schedule says how many words of a source
have been asked for at each time; its inverse gives each document the time at which its turn comes,
and documents are range-sorted by that position.

All sums over documents follow a range-partitioned order (`ordering.running_sums`), so a source with
a third of all rows is spread over many tasks. Only (key, source, size) rows are sorted, no texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievework.llm.common import WORD, unused
from sievework.operators.ordering import attach, ordered_positions, running_sums
from sievework.session import freeze

Schedule = Sequence[tuple[float, float]]

# Schedules given to the sources in turn: their integrals are 3, 1 and 2.
FALLING: Schedule = ((0.0, 4.0), (1.0, 2.0))
LEVEL: Schedule = ((0.0, 1.0), (1.0, 1.0))
RISING: Schedule = ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0))
SCHEDULES: Sequence[Schedule] = (FALLING, LEVEL, RISING)
SHARE = 1.5
CAP = 2


def integral(schedule: Schedule) -> float:
    """Area below a schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def check(schedules: Sequence[Schedule]) -> None:
    for points in schedules:
        times = [t for t, _ in points]
        if times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in points) < 0 or integral(points) <= 0:
            raise ValueError(f"a schedule runs from 0 to 1, is never negative and has an area: {points}")


def time_of(fraction: Column, schedule: Schedule) -> Column:
    """The time by which a source has been asked for `fraction` of its target: the inverse of the integral."""
    area, out = fraction * F.lit(integral(schedule)), F.lit(1.0)
    before = integral(schedule)
    for (t0, w0), (t1, w1) in reversed(list(zip(schedule, schedule[1:]))):
        before -= (t1 - t0) * (w0 + w1) / 2
        slope, rest = (w1 - w0) / (t1 - t0), F.greatest(area - F.lit(before), F.lit(0.0))
        # rest = w0 x + slope x^2 / 2, written so that a level piece divides by no zero.
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        step = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (F.lit(w0) + root))
        out = F.when(area >= F.lit(before), F.least(F.lit(t0) + step, F.lit(t1))).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Rows (source, source_size, place, target) from rows (source, source_size), one per source.

    Sources by code point, null last, take the schedules in turn. The targets sum to `share` times
    all sizes, or to what the caps allow. Filled in the order in which sources meet their cap, so
    running sums settle who stops there; nothing is iterated and no source list is collected.
    """
    check(schedules)
    areas = F.array(*[F.lit(float(integral(s))) for s in schedules])
    placed = ordered_positions(sizes, [F.col("source").asc_nulls_last()], "place")
    weighed = placed.select(
        "source", "source_size", "place",
        F.element_at(areas, (F.col("place") % len(schedules) + 1).cast("int")).alias("w"),
        (F.col("source_size") * cap).alias("full"),
    )
    summed = freeze(running_sums(weighed, [F.col("full") / F.col("w"), F.col("place")], {"fulls": F.col("full"), "ws": F.col("w")}))
    whole = summed.agg(F.sum("w").alias("w"), F.sum("source_size").alias("size")).first()
    asked = float(share) * (whole["size"] or 0)
    stops = (asked - (F.col("fulls") - F.col("full"))) * F.col("w") >= F.col("full") * (F.lit(whole["w"]) - (F.col("ws") - F.col("w")))
    marked = summed.withColumn("stops", stops)
    open_ = marked.filter(~F.col("stops")).agg(F.sum("w").alias("w")).first()["w"] or 1.0
    full = marked.filter("stops").agg(F.sum("full").alias("full")).first()["full"] or 0
    target = F.when(F.col("stops"), F.col("full").cast("double")).otherwise(F.lit(asked - full) * F.col("w") / F.lit(open_))
    return marked.select("source", "source_size", "place", target.alias("target"))


def mix(
    docs: DataFrame, key: str, text: str, source: str,
    schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """Rows (key, size, source_size, target, taken, pass_1, pass_2, ..., time_1, time_2, ...), one per input row.

    `size` counts words (null and empty text: 0), `taken` the words the mix takes in all passes;
    pass_n is the part of the document taken in pass n, time_n the time in [0, 1] at which it comes
    (null if nothing is taken). The words taken of a source sum to its rounded target; the document
    at the end of the last pass may be taken in part. Null sources form one source, null keys are
    keys, ties of key and size share what falls on them. No rows give no rows.
    """
    # Written before it is range-sorted: the sort reads its input twice, and words are counted once.
    sized = freeze(docs.select(docs[key].alias("k"), docs[source].alias("source"), word_count(docs[text]).alias("size")))
    order = [F.col("source").asc_nulls_last(), F.xxhash64("k"), F.col("k"), F.col("size")]
    rows = freeze(running_sums(sized, order, {"run": F.col("size")}))
    spans = freeze(rows.groupBy("source").agg(F.min(F.col("run") - F.col("size")).alias("start"), F.sum("size").alias("source_size")))
    aims = attach(targets(spans.select("source", "source_size"), schedules, share, cap), spans.select("source", "start"), ["source"])
    joined = attach(rows, freeze(aims), ["source"])
    begins, asked = F.col("run") - F.col("size") - F.col("start"), F.round("target").cast("long")
    passes, times = [], []
    for n in range(cap):
        at = begins + n * F.col("source_size")
        part = F.least(F.greatest(asked - at, F.lit(0)), F.col("size"))
        fraction = at / F.col("target")
        when = F.lit(None).cast("double")
        for i, schedule in enumerate(schedules):
            when = F.when(F.col("place") % len(schedules) == i, time_of(fraction, schedule)).otherwise(when)
        passes.append(part.alias(f"pass_{n + 1}"))
        times.append(F.when(part > 0, when).alias(f"time_{n + 1}"))
    taken = sum((F.least(F.greatest(asked - (begins + n * F.col("source_size")), F.lit(0)), F.col("size")) for n in range(1, cap)), F.least(F.greatest(asked - begins, F.lit(0)), F.col("size")))
    return joined.select(F.col("k").alias(key), "size", "source_size", "target", taken.alias("taken"), *passes, *times)


def placed(mixed: DataFrame, key: str, cap: int = CAP) -> DataFrame:
    """Adds place_1, place_2, ... to the rows of `mix`: where in training each pass of a document comes, from 0.

    The passes of all sources are range-sorted by their times, which merges the sources as their
    schedules ask for them; equal times follow a hash of the key. Null where a pass takes nothing.
    """
    row, turn, place = unused(mixed, "row_", "turn_", "at_")
    passes = F.array(*[F.struct(F.col(f"time_{n}").alias("time"), F.lit(n).alias("n")) for n in range(1, cap + 1)])
    turns = mixed.withColumn(row, F.monotonically_increasing_id()).withColumn(turn, F.explode_outer(F.filter(passes, lambda p: p["time"].isNotNull())))
    # Rows without a turn come last, so they move no place.
    order = [F.col(f"{turn}.time").asc_nulls_last(), F.xxhash64(key), *[F.col(c) for c in (key, "size", "source_size", "target", f"{turn}.n", row)]]
    sorted_ = ordered_positions(turns, order, place)
    return sorted_.groupBy(row).agg(
        *[F.any_value(c).alias(c) for c in mixed.columns],
        *[F.max(F.when(F.col(f"{turn}.n") == n, F.col(place))).alias(f"place_{n}") for n in range(1, cap + 1)],
    ).drop(row)


def in_order(
    docs: DataFrame, key: str, text: str, source: str,
    schedules: Sequence[Schedule] = SCHEDULES, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """The documents as the mix takes them, with all their columns, range-sorted by training position.

    A document comes once for each pass that takes at least half of its words, whole each time.
    Documents without words are taken by no pass. Every row has a plan of its own: rows whose key is
    null or repeated are written once with a number that tells them apart.
    """
    own, row, number, time = unused(docs, "key_", "row_", "number_", "time_")
    repeated = freeze(docs.groupBy(docs[key].alias(own)).agg(F.count("*").alias("n")).filter("n > 1").select(own))
    same = docs[key].eqNullSafe(repeated[own])
    unknown = F.lit(None).cast("long").alias(row)
    parts = [docs.select("*", unknown)]
    if not repeated.isEmpty():
        several = docs.join(repeated, same, "left_semi").withColumn(row, F.monotonically_increasing_id())
        parts = [docs.join(repeated, same, "left_anti").select("*", unknown), freeze(several)]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # The number is null for all others, so it leaves their order by the key's hash as it is.
    mixed = mix(rows.select(F.struct(key, row).alias("k"), F.col(text).alias("t"), F.col(source).alias("s")), "k", "t", "s", schedules, share, cap)
    times = F.filter(
        F.array(*[F.when((F.col("size") > 0) & (2 * F.col(f"pass_{n}") >= F.col("size")), F.col(f"time_{n}")) for n in range(1, cap + 1)]),
        lambda t: t.isNotNull(),
    )
    plan = mixed.select(F.col("k").getField(key).alias(own), F.col("k").getField(row).alias(number), F.explode(times).alias(time))
    order = [F.col(time), F.xxhash64(own, number), F.col(own), F.col(number)]
    chosen = [parts[0].join(plan.filter(F.col(number).isNull()), parts[0][key].eqNullSafe(plan[own]))]
    for part in parts[1:]:
        chosen.append(part.join(plan.filter(F.col(number).isNotNull()), part[row] == plan[number]))
    out = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
