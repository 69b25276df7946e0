"""Numbered commits of a folder: what readers see changes in one step.

A commit is one small file `commits/<number>-<name>`, made complete before it gets this name. The
current state is the commit of the highest number (and, of two writers that chose the same one, the
greater name), so nothing is ever overwritten and a writer that dies before its commit has changed
nothing for any reader.
"""

from __future__ import annotations

import json
import posixpath

from pyarrow import fs

from sievework.sources.files import open_folder, put_new


def commits(folder: str) -> list[tuple[int, str]]:
    """(number, name) of all commits, oldest first."""
    system, base = open_folder(f"{folder.rstrip('/')}/commits")
    found = [f.base_name for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True))]
    named = [n.split("-", 1) for n in found if not n.endswith(".tmp")]
    return sorted((int(n[0]), n[1]) for n in named if len(n) == 2 and n[0].isdigit())


def current(folder: str) -> str | None:
    """The name of the newest commit, or None before the first."""
    found = commits(folder)
    return found[-1][1] if found else None


def commit(folder: str, name: str, content: dict | None = None) -> int:
    """Makes `name` the current state; returns the number of the commit."""
    found = commits(folder)
    number = found[-1][0] + 1 if found else 0
    put_new(f"{folder.rstrip('/')}/commits/{number:09d}-{name}", lambda sink: sink.write(json.dumps(content or {}).encode()))
    return number


def content(folder: str, number: int, name: str) -> dict:
    system, base = open_folder(f"{folder.rstrip('/')}/commits/{number:09d}-{name}")
    with system.open_input_file(base) as source:
        return json.loads(source.read())


def forget(folder: str, keep: int) -> list[str]:
    """Removes all commits but the newest `keep`; returns the names that have none left."""
    found = commits(folder)
    old, kept = found[: max(0, len(found) - keep)], {name for _, name in found[max(0, len(found) - keep) :]}
    system, base = open_folder(f"{folder.rstrip('/')}/commits")
    for number, name in old:
        system.delete_file(posixpath.join(base, f"{number:09d}-{name}"))
    return sorted({name for _, name in old} - kept)
