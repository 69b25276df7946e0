"""Text helpers: lines, trimming, escaping, sections of a cell. All stay inside the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from sievework.functions.binding import let

# The characters a line trim removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_line(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE_SPACE))


def lines_of(text: Column, drop_last_empty: bool = False) -> Column:
    """Array of lines; optionally without the one empty line a final newline leaves."""
    lines = F.split(text, "\n", -1)
    if not drop_last_empty:
        return lines
    return let(
        lines,
        lambda l: F.when(F.element_at(l, -1) == "", F.slice(l, F.lit(1), F.size(l) - 1)).otherwise(l),
    )


def escape_markup(text: Column) -> Column:
    """Escapes a value for a quoted markup attribute."""
    # The five characters and their replacements; `&` first.
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def is_iso_date(text: Column) -> Column:
    """True only for an existing day written YYYY-MM-DD; false for null."""
    shaped = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    return F.coalesce(shaped & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def sections_of(text: Column, marker: str = "## ") -> Column:
    """Array of sections (start_line, lines) of one text cell; a marker line opens a section.

    A section is cut out of the cell, so no line is moved between tasks. The text before the
    first marker is a section of its own.
    """
    return let(
        lines_of(text, drop_last_empty=True),
        lambda lines: runs_of(lines, lambda line: line.startswith(marker), "start_line", "lines"),
    )


def runs_of(items: Column, opens: Callable[[Column], Column], start: str, run: str) -> Column:
    """Cuts an array before each item that `opens` holds for: array of (1-based start, run)."""
    starts = F.filter(
        F.transform(items, lambda x, i: F.when((i == 0) | opens(x), i + 1)),
        lambda n: n.isNotNull(),
    )

    def cut(begins: Column) -> Column:
        ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(items) + 1))
        spans = F.filter(
            F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda s: s["a"].isNotNull(),
        )
        return F.transform(
            spans,
            lambda s: F.struct(s["a"].alias(start), F.slice(items, s["a"], s["b"] - s["a"]).alias(run)),
        )

    return let(starts, cut)


def heading_of(lines: Column, marker: str = "## ") -> Column:
    first = F.element_at(lines, 1)
    return F.when(first.startswith(marker), first)
