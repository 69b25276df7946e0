"""Byte-level BPE by backtracking over longest tokens, and decoding by an offset table.

Encoding merges nothing. An Aho-Corasick automaton over the vocabulary gives, in one pass, the
longest token that starts at each byte; the encoder takes it, or the next shorter one, as long as it
goes together with the token before it, and steps back when none does. Two tokens go together if
merging their joined bytes by rank gives the two of them again; a sequence whose neighbours all go
together is the one that merging by rank gives. The prefix of a text has one encoding only, so a
position that was given up is never tried again, and the work is linear in the bytes.

Pair answers and the ids of frequent pre-tokens are kept per worker in caches of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import map_rows, put_bounded

# The pre-token pattern of byte-level tokenizer files.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PAIR_CACHE = 500_000
PIECE_CACHE = 400_000
# Longer pre-tokens are encoded anew each time, so the cache stays small in bytes too.
PIECE_BYTES = 64


def _latin_pattern() -> re.Pattern:
    """The same pattern for texts of Latin-1 characters only, with its classes written out; it runs much faster."""
    latin = [chr(i) for i in range(256)]
    kind = {c: unicodedata.category(c)[0] for c in latin}
    letter = "".join(re.escape(c) for c in latin if kind[c] == "L")
    number = "".join(re.escape(c) for c in latin if kind[c] == "N")
    blank = "".join(re.escape(c) for c in latin if regex.match(r"\s", c))
    parts = ["'s|'t|'re|'ve|'m|'ll|'d", f" ?[{letter}]+", f" ?[{number}]+", f" ?[^{blank}{letter}{number}]+"]
    return re.compile("|".join([*parts, f"[{blank}]+(?![^{blank}])", f"[{blank}]+"]))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes are
    themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a tokenizer file: tokens, merges, automaton, pair answers, decoding offsets."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        self._check(data)
        model, letters = data["model"], byte_letters()
        ids: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*ids.values(), *added.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in ids.items():
            self.tokens[i] = bytes(letters[c] for c in text)
        self.single = [ids[c] for c in sorted(letters, key=letters.get)]
        # Rank -1 is a byte, which no merge made.
        self.rank = [-1] * size
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made, pair = ids[left + right], (ids[left], ids[right])
            self.merge_rank[pair], self.rank[made], self.parts[made] = rank, rank, pair
        reachable = [i for i in ids.values() if self.rank[i] >= 0] + self.single
        by_bytes = {self.tokens[i]: i for i in reachable}
        self.shorter = [-1] * size
        for token, i in by_bytes.items():
            self.shorter[i] = next((by_bytes[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in by_bytes), -1)
        self.automaton = ahocorasick.Automaton()
        for token, i in by_bytes.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        for text, i in added.items():
            self.tokens[i] = text.encode()
        self.added = added
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.latin = _latin_pattern()
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[str, bytes]] = {}

    @staticmethod
    def _check(data: dict) -> None:
        """Refuses files that ask for what is not done here, rather than giving other ids."""
        pre, model = data.get("pre_tokenizer") or {}, data["model"]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [k for k in ("ignore_merges", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or data.get("normalizer") or not plain or odd:
            raise ValueError(f"not a plain byte-level BPE file: {odd or pre}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data["added_tokens"]):
            raise ValueError("added tokens that strip blanks or match whole words only are not supported")

    def together(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes by rank leaves the border between the two tokens alone.

        Goes back in time: the later merge of the two that touch the border is undone, and the
        pair at the border must not be one that would have been merged before what followed.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        never = len(self.merge_rank) + 1
        x, y, x_ends, y_ends, good = left, right, never, never, True
        while True:
            meets = self.merge_rank.get((x, y), never)
            # Of equal ranks the leftmost merge comes first: before the border's on the left side only.
            if meets < x_ends and meets <= y_ends and meets < never:
                good = False
                break
            if self.rank[x] < 0 and self.rank[y] < 0:
                break
            if self.rank[x] > self.rank[y]:
                x_ends, x = self.rank[x], self.parts[x][1]
            else:
                y_ends, y = self.rank[y], self.parts[y][0]
        put_bounded(self.pairs, (left, right), good, PAIR_CACHE)
        return good

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        tokens, shorter, pairs = self.tokens, self.shorter, self.pairs
        size = len(data)
        longest = [-1] * (size + 1)
        # Matches come by rising end, so the last one that starts at a byte is the longest.
        for end, (i, n) in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - n] = i
        out: list[int] = []
        at, last, token, given_up = 0, -1, longest[0], set()
        while at < size:
            while token >= 0:
                end = at + len(tokens[token])
                if end not in given_up:
                    if last < 0:
                        break
                    good = pairs.get((last, token))
                    if self.together(last, token) if good is None else good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = end, token, longest[end]
            else:
                given_up.add(at)
                out.pop()
                at -= len(tokens[last])
                token, last = shorter[last], out[-1] if out else -1
        return out

    def piece(self, text: str) -> tuple[str, bytes]:
        """The ids of a pre-token, as text and as 32-bit integers."""
        found = self.pieces.get(text)
        if found is None:
            ids = self.encode_bytes(text.encode())
            found = ",".join(map(str, ids)), np.array(ids, np.int32).tobytes()
            if len(text) <= PIECE_BYTES:
                put_bounded(self.pieces, text, found, PIECE_CACHE)
        return found

    def _split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin.findall(text)

    def _plain(self, text: str) -> list[tuple[str, bytes]]:
        """Runs of a text without special tokens."""
        pieces, piece = self.pieces, self.piece
        return [pieces.get(p) or piece(p) for p in self._split(text)]

    def _runs(self, text: str) -> list[tuple[str, bytes]]:
        if not self.added or not self.special.search(text):
            return self._plain(text)
        out, start = [], 0
        for hit in self.special.finditer(text):
            out += self._plain(text[start : hit.start()])
            i = self.added[hit.group()]
            out.append((str(i), np.array([i], np.int32).tobytes()))
            start = hit.end()
        return out + self._plain(text[start:])

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of a text, and the same as decimals joined by commas."""
        runs = self._runs(text)
        return np.frombuffer(b"".join([r[1] for r in runs]), np.int32), ",".join([r[0] for r in runs])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: each token's place in one blob comes from the offset table."""
        starts = self.offsets[ids]
        lengths = self.offsets[ids + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        return self.blob[place].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


_LOADED: dict[int, Vocabulary] = {}


def vocabulary(spec: str) -> Vocabulary:
    """The tables of a tokenizer file's content, built once per worker process."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(spec)
    return _LOADED[key]


def read_spec(path: str) -> str:
    """Content of a tokenizer file: a few MB whatever the data, so it may go to every worker."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """Rows (key, ids array<int>, decoded string): the token ids of every whole text and the text they give back.

    One row per input row, in any order; null text counts as empty and gives no ids and an empty
    text; null keys and repeated rows stay as they are; other columns are ignored.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        voc = vocabulary(spec.value)
        for k, t in tuples:
            ids, _ = voc.encode(t or "")
            yield k, ids, voc.decode_text(ids)

    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    return map_rows(df, [key, text], f"`{key}` {kind}, ids array<int>, decoded string", rows, 64)


def encode_digests(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): counts and digests of what `encode` gives.

    The digests are taken where the ids are made, so neither ids nor decoded texts leave a worker.
    Nulls, ties and repeated rows as in `encode`.
    """
    spec = df.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def rows(tuples: Iterator[tuple]) -> Iterator[tuple]:
        voc = vocabulary(spec.value)
        for k, t in tuples:
            ids, listed = voc.encode(t or "")
            decoded = voc.decode_text(ids).encode()
            yield k, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(df, [key, text], schema, rows)
