"""Front matter of a text cell: parsed by one pass over the header's lines, written with built-in functions.

Grammar: a block between two `---` lines of `key: value` lines. A value is bare, "JSON quoted",
'single quoted' (doubled quote inside), null or ~, an inline list [a, "b"], or empty and followed
by `  - item` lines. The parser works on Arrow batches inside the tasks: no line is moved, each line
is looked at once, and a repeated key costs a look-up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievework.functions.text import WHITE_SPACE

_LINE_ENDS = "\n\r\u2028\u2029"
_BLANK = "[" + re.escape(WHITE_SPACE.replace("\n", "")) + "]"
_PAIR = re.compile(rf"([A-Za-z_][A-Za-z0-9_-]*):(?:{_BLANK}([^{_LINE_ENDS}]*))?")
_ITEM = re.compile(rf"{_BLANK}+-([^{_LINE_ENDS}]*)")
_JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')
# One list element up to its comma; a comma inside quotes does not count.
_ELEMENT = re.compile(r"""((?:"(?:\\.|[^"\\])*+(?:"|$)|'[^']*+(?:'|$)|[^,"'])*+),""")

PARSED = T.StructType(
    [
        T.StructField("has_block", T.BooleanType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("scalars", T.MapType(T.StringType(), T.StringType())),
        T.StructField("lists", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("body", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)


class FrontMatter(NamedTuple):
    """What a text cell holds; without a closed block keys, scalars and lists are None."""

    has_block: bool
    keys: list[str] | None
    scalars: dict[str, str | None] | None
    lists: dict[str, list[str | None]] | None
    body: str | None
    errors: list[str]


class BadValue(ValueError):
    """A quoted value that does not end as it should."""


def scalar(v: str) -> str | None:
    """The value of one trimmed scalar."""
    if v in ("", "null", "~"):
        return None
    if v[0] == '"':
        if not _JSON_STRING.fullmatch(v):
            raise BadValue(f"bad-string {v}")
        return json.loads(v).encode("utf-8", "replace").decode() if "\\" in v else v[1:-1]
    if v[0] == "'":
        if len(v) < 2 or v[-1] != "'":
            raise BadValue(f"open-quote {v}")
        return v[1:-1].replace("''", "'")
    return v


def elements(inner: str) -> list[str]:
    """Trimmed elements of an inline list without its brackets; nothing after the last comma is no element."""
    out, at = [], 0
    while hit := _ELEMENT.match(inner, at):
        out.append(hit[1].strip(WHITE_SPACE))
        at = hit.end()
    last = inner[at:].strip(WHITE_SPACE)
    return [*out, last] if last else out


def _values(found: list[tuple[int, str]]) -> tuple[list[str | None], list[tuple[int, str]]]:
    good, bad = [], []
    for n, raw in found:
        try:
            good.append(scalar(raw))
        except BadValue as error:
            bad.append((n, str(error)))
    return good, bad


def parse(text: str | None, list_fields: tuple[str, ...] = ("refs",)) -> FrontMatter:
    """Reads a text cell; null has no block.

    A field set to an empty list is a null scalar unless it is one of `list_fields`. A repeated key
    is an error and its last value wins. Errors are `line: code detail` in line order.
    """
    if text is None or not (text.startswith("---\n") or text == "---"):
        return FrontMatter(False, None, None, None, text, ["no-header"])
    close = (text + "\n").find("\n---\n", 3)
    if close < 0:
        return FrontMatter(False, None, None, None, text, ["open-header"])

    rows: list[tuple[int, str, str, str]] = []
    for n, line in enumerate(text[4:close].split("\n") if close > 4 else (), 2):
        if hit := _PAIR.fullmatch(line):
            rows.append((n, hit[1], (hit[2] or "").strip(WHITE_SPACE), line))
        elif hit := _ITEM.fullmatch(line):
            rows.append((n, "-", hit[1].strip(WHITE_SPACE), line))
        elif line.strip(WHITE_SPACE):
            rows.append((n, "", "", line))

    # By key, in the order in which each was set last; list values are lists.
    found: dict[str, str | None | list[str | None]] = {}
    errors: list[tuple[int, int, str]] = []
    at = 0
    while at < len(rows):
        n, key, value, line = rows[at]
        end = at + 1
        while end < len(rows) and rows[end][1] == "-":
            end += 1
        below, at = rows[at + 1 : end], end
        if key in ("", "-"):
            errors += [(m, 1, f"unreadable {x}") for m, _, _, x in [(n, key, value, line), *below]]
            continue
        if key in found:
            errors.append((n, 0, f"repeated-key {key}"))
        if value == "":
            new, bad = _values([(m, v) for m, _, v, _ in below])
            errors += [(m, 1, e) for m, e in bad]
        else:
            errors += [(m, 1, f"unreadable {x}") for m, _, _, x in below]
            if value[0] != "[":
                one, bad = _values([(n, value)])
                new = one[0] if one else None
            elif value[-1] == "]":
                new, bad = _values([(n, x) for x in elements(value[1:-1])])
            else:
                new, bad = None, [(n, f"open-list {key}")]
            if bad:
                # The field stays unset; of several bad elements the first counts.
                errors.append((n, 1, bad[0][1]))
                continue
        found.pop(key, None)
        found[key] = new

    lists = {k: v for k, v in found.items() if isinstance(v, list) and (v or k in list_fields)}
    scalars = {k: None if isinstance(v, list) else v for k, v in found.items() if k not in lists}
    return FrontMatter(True, list(found), scalars, lists, text[close + 5 :], [f"{n}: {e}" for n, _, e in sorted(errors)])


def with_front_matter(df: DataFrame, text: str = "text", list_fields: tuple[str, ...] = ("refs",)) -> DataFrame:
    """Puts the columns of `PARSED` in place of the text column; the others stay as they are."""
    kept = [c for c in df.columns if c != text]
    source = df.select(*kept, text)
    target = to_arrow_schema(PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(parse(t, list_fields) for t in batch.column(len(kept)).to_pylist()))) or [()] * 6
            # Arrow takes maps as lists of pairs.
            for i in (2, 3):
                columns[i] = [None if m is None else list(m.items()) for m in columns[i]]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, target)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], [*kept, *target.names])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[: len(kept)], *PARSED.fields]))


def quote(text: Column) -> Column:
    """JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def front_matter_write(fields: dict[str, Column]) -> Column:
    """Front-matter text of the nine record fields, in their fixed order."""

    def plain(name: str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(fields[name], F.lit("null")))

    def quoted(name: str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.coalesce(quote(fields[name]), F.lit("null")))

    refs = F.coalesce(fields["refs"], F.array().cast("array<string>"))
    ref_lines = F.when(F.size(refs) == 0, F.array(F.lit("refs: []"))).otherwise(
        F.concat(F.array(F.lit("refs:")), F.transform(refs, lambda r: F.concat(F.lit("  - "), quote(r))))
    )
    head = [quoted("title"), plain("status"), plain("area"), plain("due"), plain("updated"), plain("owner"), quoted("brief")]
    return F.concat(
        F.array_join(
            F.concat(F.array(F.lit("---"), *head), ref_lines, F.array(quoted("test"), F.lit("---"))), "\n"
        ),
        F.lit("\n"),
    )
