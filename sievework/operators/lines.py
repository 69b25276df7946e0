"""Lines, line multisets and sections of a text corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievework.functions.text import heading_of, lines_of, sections_of, trim_line
from sievework.operators.ordering import attach, positions_within, same_keys


def explode_lines(df: DataFrame, keys: Sequence[str], text: str = "text", drop_last_empty: bool = False) -> DataFrame:
    """(keys, n, line) with 1-based line numbers."""
    lines = df.select(*keys, F.posexplode(lines_of(F.col(text), drop_last_empty)).alias("n", "line"))
    return lines.withColumn("n", F.col("n") + 1)


def trimmed_lines(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Trimmed lines that are not empty."""
    return explode_lines(df, keys, text).withColumn("line", trim_line(F.col("line"))).filter("line <> ''")


def line_multiset(lines: DataFrame) -> DataFrame:
    return lines.groupBy("line").agg(F.count("*").alias("n"))


def multiset_union(*multisets: DataFrame) -> DataFrame:
    out = multisets[0]
    for other in multisets[1:]:
        out = out.unionByName(other)
    return out.groupBy("line").agg(F.sum("n").alias("n"))


def multiset_missing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(line, need, have) of lines the new multiset holds too few of."""
    have = new.select("line", F.col("n").alias("have"))
    return (
        old.withColumnRenamed("n", "need")
        .join(have, "line", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .filter(F.col("have") < F.col("need"))
    )


def missing_totals(old: DataFrame, missing: DataFrame) -> DataFrame:
    return old.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"), F.count("*").alias("distinct_lines")
    ).withColumn("missing_lines", missing.agg(F.count("*").alias("n")).scalar())


def multiset_gain(lines: DataFrame, base: DataFrame, order: Sequence[str]) -> DataFrame:
    """Lines beyond the base: of each line the first k are absorbed, k being its base count.

    Lines the base does not have all pass and lines it has enough of all fall, so only the rest is
    ranked, by a sort that spreads one frequent line over many tasks.
    """
    known = base.select("line", F.col("n").alias("__base"))
    totals = line_multiset(lines).join(known, "line", "left")
    totals = totals.select("line", F.col("n").alias("__total"), F.coalesce("__base", F.lit(0)).alias("__base"))
    rows = lines.join(totals.filter("__total > __base"), "line")
    fresh = rows.filter("__base = 0").select(lines.columns)
    partly = positions_within(rows.filter("__base > 0"), ["line"], list(order), "__pos")
    return fresh.unionByName(partly.filter("__pos >= __base").select(lines.columns))


# Copies of a line that one task writes at a time.
RUN = 100_000


def multiset_difference(lines: DataFrame, base: DataFrame) -> DataFrame:
    """Bag difference of two one-column tables of lines: each line as often as it comes more often.

    Counts are compared, then the surplus is written out in runs of `RUN` that are dealt to all
    tasks, so one line with very many copies does not come from one task.
    """
    had = line_multiset(base).select("line", F.col("n").alias("__base"))
    left = line_multiset(lines).join(had, "line", "left")
    surplus = left.select("line", (F.col("n") - F.coalesce("__base", F.lit(0))).alias("__n")).filter("__n > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(RUN).cast("bigint")))
    runs = surplus.select("line", "__n", starts.alias("__at")).repartition("line", "__at")
    copies = F.least(F.lit(RUN), F.col("__n") - F.col("__at")).cast("int")
    return runs.select("line", F.explode(F.array_repeat(F.lit(0), copies))).select("line")


def split_sections(df: DataFrame, keys: Sequence[str], text: str = "text", marker: str = "## ") -> DataFrame:
    """One row per section of each text: idx, section_id, heading, start_line, line_count, lines."""
    cut = df.select(*keys, F.posexplode(sections_of(F.col(text), marker)).alias("idx", "s"))
    return cut.select(
        *keys,
        "idx",
        F.format_string("S%03d", "idx").alias("section_id"),
        heading_of(F.col("s.lines"), marker).alias("heading"),
        F.col("s.start_line").alias("start_line"),
        F.size("s.lines").alias("line_count"),
        F.col("s.lines").alias("lines"),
    )


def section_digest(sections: DataFrame) -> DataFrame:
    """Adds `bytes` (with the final newline), `sha1` (without it) and `text`; drops `lines`."""
    joined = F.array_join("lines", "\n")
    return (
        sections.withColumn("bytes", F.octet_length(joined) + 1)
        .withColumn("sha1", F.sha1(joined))
        .withColumn("text", F.concat(joined, F.lit("\n")))
        .drop("lines")
    )


def _file_path(prefix: str = "m.") -> Column:
    done = F.when(F.col(f"{prefix}status") == "done", "done/").otherwise("")
    return F.concat(done, F.col(f"{prefix}area"), F.lit("/"), F.col(f"{prefix}slug"), F.lit(".md"))


def route_sections(
    sections: DataFrame, metas: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Joins sections to routing metadata by (keys, heading); heading null is the preamble.

    metas: keys, heading, disposition (file | merge | archive | split), merge_into, slug, area,
    status, and for the parts of a split section is_part with first and last line in the section.
    Returns routes (keys, section_id, first_line, last_line, target, kind, chunk_rank) and errors
    (keys, section_id, heading, error). In a target the owning section comes before merged ones.
    """
    on = [*keys, "heading"]
    main = metas.filter(~F.coalesce("is_part", F.lit(False))).drop("is_part", "first", "last")
    parts = metas.filter(F.coalesce("is_part", F.lit(False)))
    repeated = main.groupBy(*on).agg(F.count("*").alias("__n")).filter("__n > 1")
    # Repeated metadata is reported; one of it keeps the joins one-to-many.
    single = main.groupBy(*on).agg(
        F.min(F.struct("disposition", "merge_into", "slug", "area", "status")).alias("m")
    )
    owners = single.select(
        *keys, F.col("heading").alias("merge_into"), F.col("m").alias("t")
    )
    rows = attach(sections, single, on, "left").withColumn("merge_into", F.col("m.merge_into"))
    rows = attach(rows, owners, [*keys, "merge_into"], "left")
    kind = F.col("m.disposition")
    last = F.col("start_line") + F.col("line_count") - 1
    error = (
        F.when(F.col("m").isNull(), "no-route")
        .when(
            (kind == "merge") & ~F.coalesce(F.col("t.disposition") == "file", F.lit(False)),
            "no-merge-file",
        )
        .when(~kind.isin("file", "merge", "archive", "split"), "no-such-disposition")
    )
    errors = (
        rows.withColumn("error", error)
        .filter(F.col("error").isNotNull())
        .select(*keys, "section_id", "heading", "error")
        .unionByName(
            repeated.select(
                *keys,
                F.lit(None).cast("string").alias("section_id"),
                "heading",
                F.lit("repeated-heading").alias("error"),
            )
        )
    )
    good = rows.filter(error.isNull())
    target = F.when(kind == "file", _file_path()).when(kind == "merge", _file_path("t.")).when(
        kind == "archive", "archive"
    )
    whole = good.filter(kind != "split").select(
        *keys,
        "section_id",
        F.col("start_line").cast("bigint").alias("first_line"),
        last.cast("bigint").alias("last_line"),
        target.alias("target"),
        kind.alias("kind"),
        F.when(kind == "merge", 1).otherwise(0).alias("chunk_rank"),
    )
    split = good.filter(kind == "split").select(*keys, "heading", "section_id", "start_line", "line_count")
    renamed = parts.select(
        *[F.col(k).alias(f"__p_{k}") for k in on], "first", "last", F.struct("slug", "area", "status").alias("m")
    )
    match = F.lit(True)
    for k in on:
        match = match & split[k].eqNullSafe(renamed[f"__p_{k}"])
    routed = split.join(renamed, match).select(
        *keys,
        "section_id",
        (F.col("start_line") + F.col("first") - 1).cast("bigint").alias("first_line"),
        (
            F.col("start_line") + F.greatest(F.least("last", "line_count"), F.col("first") - 1) - 1
        ).cast("bigint").alias("last_line"),
        _file_path().alias("target"),
        F.lit("split").alias("kind"),
        F.lit(0).alias("chunk_rank"),
    )
    return whole.unionByName(routed), errors


def _cover(sections: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): line numbers the ranges cover, never past the section's end."""
    bounds = attach(ranges, sections.select(*keys, "line_count"), keys)
    end = F.least("last", "line_count")
    return (
        bounds.filter((F.col("first") <= end) & (F.col("first") >= 1))
        .select(*keys, F.explode(F.sequence(F.col("first").cast("int"), end.cast("int"))).alias("n"))
        .distinct()
    )


def range_coverage(sections: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, line) of lines of the sections that no range covers; not blank, not the heading.

    Ranges are spelled out to line numbers and matched on (keys, n): a plain anti join, which a
    section with very many lines or ranges does not skew.
    """
    lines = sections.select(*keys, F.posexplode("lines").alias("n", "line")).withColumn("n", F.col("n") + 1)
    wanted = lines.filter((F.col("n") != 1) & (trim_line(F.col("line")) != ""))
    covered = _cover(sections, ranges, keys)
    return wanted.join(covered, same_keys(wanted, covered, [*keys, "n"]), "left_anti")


def cut_ranges(
    sections: DataFrame, ranges: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Keep and cut parts of sections by inclusive line ranges (first, last), and the bad ranges.

    A section is one text cell, so the ranges of a section fit a window over its keys. Parts carry
    the line numbers in the section and in the whole text; a bad range is one that overlaps the one
    before it, runs backwards or leaves the section, and a section with one gives no parts.
    """
    line_counts = sections.select(*keys, "start_line", F.col("line_count").cast("bigint").alias("line_count"))
    by_first = Window.partitionBy(*keys).orderBy("first", "last")
    marked = (
        attach(ranges, line_counts, keys)
        .withColumn("__next", F.coalesce(F.lag("last").over(by_first), F.lit(0)) + 1)
        .withColumn("__after", F.lead("first").over(by_first))
        .withColumn(
            "__bad",
            (F.col("first") < F.col("__next")) | (F.col("last") < F.col("first")) | (F.col("last") > F.col("line_count")),
        )
        .withColumn("__any_bad", F.max("__bad").over(Window.partitionBy(*keys)))
    )
    errors = marked.filter("__bad").select(*keys, "first", "last", "line_count")
    good = marked.filter("NOT __any_bad")

    def part(kind: str, first: Column, last: Column) -> Column:
        return F.when(
            first <= last,
            F.struct(F.lit(kind).alias("kind"), first.cast("bigint").alias("first"), last.cast("bigint").alias("last")),
        )

    tail = F.when(F.col("__after").isNull(), F.col("line_count"))
    pieces = F.array(
        part("keep", F.col("__next"), F.col("first") - 1),
        part("cut", F.col("first"), F.col("last")),
        part("keep", F.col("last") + 1, tail),
    )
    cut = good.select(*keys, "start_line", F.inline(F.filter(pieces, lambda p: p.isNotNull())))
    ranged = ranges.select(*keys).distinct()
    untouched = line_counts.join(ranged, same_keys(line_counts, ranged, keys), "left_anti").select(
        *keys, "start_line", F.lit("keep").alias("kind"), F.lit(1).cast("bigint").alias("first"),
        F.col("line_count").alias("last"),
    )
    parts = cut.unionByName(untouched).withColumns(
        {
            "abs_first": F.col("start_line") + F.col("first") - 1,
            "abs_last": F.col("start_line") + F.col("last") - 1,
        }
    )
    pointer = F.when(
        F.col("kind") == "cut",
        F.format_string("[archive: lines %d..%d]", "abs_first", "abs_last"),
    )
    return parts.withColumn("pointer", pointer).drop("start_line"), errors


def route_map(sections: DataFrame, routes: DataFrame, keys: Sequence[str], archived: DataFrame | None = None) -> DataFrame:
    """(keys, section_id, first_line, last_line, heading, target, n_targets, note): where every section has gone.

    One row per route, and one more for each section that was split, without a target but with the
    number of different targets of its parts. `note` lists what there is to say: `merged` into
    another section's file, `retired` to the archive, `split`, and `cut` where lines of `archived`
    (keys, section_id, first_line, last_line) lie in the row's.
    """
    on = [*keys, "section_id"]
    headed = sections.select(*on, "heading", F.col("start_line").cast("bigint").alias("__start"), F.col("line_count").cast("bigint").alias("__count"))
    own = attach(routes.select(*on, "first_line", "last_line", "target", "kind"), headed, on)
    rows = own.select(*on, "first_line", "last_line", "heading", "target", F.lit(1).cast("bigint").alias("n_targets"), "kind")
    parts = routes.filter("kind = 'split'").groupBy(*on).agg(F.count_distinct("target").alias("n_targets"))
    whole = attach(headed, parts, on).select(
        *on, F.col("__start").alias("first_line"), (F.col("__start") + F.col("__count") - 1).alias("last_line"), "heading",
        F.lit(None).cast("string").alias("target"), "n_targets", F.lit("whole").alias("kind"),
    )
    rows = rows.unionByName(whole)
    if archived is None:
        marked = rows.withColumn("__cut", F.lit(False))
    else:
        cuts = archived.select(*[F.col(c).alias(f"__a_{c}") for c in on], F.col("first_line").alias("__from"), F.col("last_line").alias("__to"))
        meets = F.lit(True)
        for c in on:
            meets = meets & rows[c].eqNullSafe(cuts[f"__a_{c}"])
        meets = meets & (F.col("__from") <= rows["last_line"]) & (F.col("__to") >= rows["first_line"]) & (rows["kind"] != "whole")
        touched = rows.join(cuts, meets, "left_semi").withColumn("__cut", F.lit(True))
        marked = touched.unionByName(rows.join(cuts, meets, "left_anti").withColumn("__cut", F.lit(False)))
    note = F.concat_ws(
        ", ", F.when(F.col("kind") == "merge", "merged"), F.when(F.col("kind") == "archive", "retired"), F.when(F.col("kind") == "whole", "split"), F.when(F.col("__cut"), "cut")
    )
    return marked.select(*on, "first_line", "last_line", "heading", "target", "n_targets", note.alias("note"))
