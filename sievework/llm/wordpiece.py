"""Word-piece lengths by a linear longest-match automaton.

Greedy word pieces take the longest piece of the vocabulary, again and again. The automaton does so
in one pass over a word's bytes: a trie of the pieces whose nodes have a failure link, the node one
is at after taking off the pieces that are sure by then, and the number of these pieces. A byte
without a child follows failure links and adds their numbers; no piece is ever built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from sievework.llm.bpe import byte_letters, read_spec
from sievework.llm.common import map_rows, put_bounded

# What a word-end mark becomes: a byte that no word holds.
END = b"\n"
_WORD_CACHE = 500_000
_WORD_BYTES = 64


def pieces(spec: str, mark: str = "</w>") -> list[bytes]:
    """The pieces of a byte-level vocabulary file; those with the mark end a word."""
    letters = byte_letters()
    out = []
    for text in json.loads(spec)["model"]["vocab"]:
        ends = text.endswith(mark) and text != mark
        body = text.removesuffix(mark) if ends else text
        if all(c in letters for c in body):
            out.append(bytes(letters[c] for c in body) + (END if ends else b""))
    return out


class Automaton:
    """Counts the greedy longest-match pieces of words."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        self.child: dict[int, int] = {}
        final, self.nodes = set(), 1
        for piece in vocabulary:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = self.nodes
                    self.nodes += 1
                node = self.child[key]
            if piece:
                final.add(node)
        # Failure link (-1: no piece fits) and pieces taken off on the way to it.
        self.link, self.popped = [-1] * self.nodes, [0] * self.nodes
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        level = [0]
        while level:
            following = []
            for parent in level:
                for byte, node in below.get(parent, ()):
                    following.append(node)
                    if node in final:
                        self.link[node], self.popped[node] = 0, 1
                        continue
                    at, count = self.link[parent], self.popped[parent]
                    while at >= 0 and at << 8 | byte not in self.child:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.child[at << 8 | byte], count
            level = following
        self.known: dict[bytes, int] = {}

    def length(self, word: bytes) -> int:
        """Pieces of a word and its end; 0 if no pieces make it up."""
        child, link, popped = self.child, self.link, self.popped
        at = total = 0
        for byte in word + END:
            while (following := child.get(at << 8 | byte)) is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    return 0
            at = following
        while at > 0:
            total += popped[at]
            at = link[at]
        return total if at == 0 else 0

    def count(self, text: str | None) -> tuple[int, int, int]:
        """(words, pieces, unknown words) of a whole text; an unknown word is one piece."""
        words = (text or "").encode().lower().split()
        known, total, unknown = self.known, 0, 0
        for word in words:
            n = known.get(word)
            if n is None:
                n = self.length(word)
                if len(word) <= _WORD_BYTES:
                    put_bounded(known, word, n, _WORD_CACHE)
            total += n or 1
            unknown += not n
        return len(words), total, unknown


_LOADED: dict[int, Automaton] = {}


def automaton(spec: str, mark: str) -> Automaton:
    """The automaton of a vocabulary file's content, built once per worker process."""
    key = hash((spec, mark))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Automaton(pieces(spec, mark))
    return _LOADED[key]


def lengths(docs: DataFrame, key: str, text: str, vocabulary: str, mark: str = "</w>") -> DataFrame:
    """Rows (key, n_words, n_pieces, n_unknown), one per input row.

    Words are what ASCII white space separates, A-Z in lower case, whole texts. A word that the
    vocabulary cannot make up is unknown and counts as one piece. Null and empty texts give zeros;
    null keys and repeated rows stay as they are; other columns are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        counter = automaton(spec.value, mark)
        for k, t in tuples:
            yield (k, *counter.count(t))

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    return map_rows(docs, [key, text], f"`{key}` {kind}, n_words bigint, n_pieces bigint, n_unknown bigint", rows)
