"""Exact byte-level BPE token counts for every prefix of a text.

A pre-token (a piece of the vocabulary's splitting pattern) is encoded by dynamic
programming over its prefixes. The encoding of a prefix ends in the one token t for which
the encoding of what stands before t ends in a token that stays apart from t when the two
are encoded together; so each prefix needs one look back, and its count is one more than
that of the prefix before t. Counts of pre-tokens add up, which answers "how many tokens
has the text up to here" and "how far do n tokens reach" without encoding again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import texts, utf8

# Fixed value: the splitting pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LIMIT = 1024
KEEP = 600_000


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins that the vocabulary file uses for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class _Spaced(dict):
    """Token counts of a space and a word, by the word; filled when asked, bounded."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= KEEP:
            self.clear()
        found = self[word] = self.count(" " + word)
        return found


class PrefixCounter:
    """Counts for one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        chars = _byte_chars()
        as_bytes = lambda t: bytes(chars[c] for c in t)
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        # A token's number is its age: bytes first, then one for each merge.
        self.number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in ((as_bytes(x), as_bytes(y)) for x, y in merges):
            new, pair = len(self.halves), (self.number[left], self.number[right])
            self.halves.append(pair)
            self.joined[pair] = new
            self.number.setdefault(left + right, new)
        self.longest = max(map(len, self.number))
        self.special = [t["content"] for t in data["added_tokens"] if t.get("special")]
        self.split = regex.compile(PATTERN)
        self.apart: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}
        self.spaced = _Spaced(self._count_plain)

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens that stand side by side: going
        back in age through the parts that touch the border, none joins before the part that
        took its place was made."""
        key, bound = (left, right), len(self.halves)
        found = self.apart.get(key)
        if found is not None:
            return found
        while True:
            if self.joined.get((left, right), bound) < bound:
                found = False
                break
            inner, outer = self.halves[left][1], self.halves[right][0]
            if left > right and left >= 256:
                bound, left = left, inner
            elif right >= 256:
                bound, right = right + 1, outer
            elif left >= 256:
                bound, left = left, inner
            else:
                found = True
                break
        if len(self.apart) >= 4 * KEEP:
            self.apart.clear()
        self.apart[key] = found
        return found

    def ladder(self, data: bytes) -> list[int]:
        """The token count of each prefix of one pre-token."""
        counts, last = [0], [-1]
        number, longest, apart = self.number, self.longest, self._stays_apart
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = number.get(data[start:end])
                if token is not None and (start == 0 or apart(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts

    def count_piece(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= KEEP:
                self.known.clear()
            data = utf8(piece)
            found = self.known[piece] = 1 if data in self.number else self.ladder(data)[-1]
        return found

    def runs(self, text: str) -> Iterator[str]:
        """The text between special strings, which count one token each; those come as well."""
        if not any(s in text for s in self.special):
            yield text
            return
        yield from regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)

    def pieces(self, text: str) -> Iterator[str]:
        """The pre-tokens and special strings of a text, in order."""
        for run in self.runs(text):
            if run in self.special:
                yield run
            else:
                yield from (m[0] for m in self.split.finditer(run))

    def _count_plain(self, text: str) -> int:
        return sum(map(self.count_piece, self.split.findall(text)))

    def _count_run(self, text: str) -> int:
        """A space before a word, or after one, always starts a pre-token, so the words
        between spaces count by themselves; not so a space between white space."""
        if self._inner.search(text):
            return self._count_plain(text)
        head, *words = text.split(" ")
        return (self._count_plain(head) if head else 0) + sum(map(self.spaced.__getitem__, words))

    _inner = re.compile(r"\s (?:\s|$)")

    def count(self, text: str | None) -> int:
        return sum(1 if run in self.special else self._count_run(run) for run in self.runs(text or "") if run)

    def reach(self, text: str | None, limit: int) -> int:
        """The length in characters of the longest run of whole pre-tokens from the start
        with at most ``limit`` tokens, then stretched into the next one by its ladder."""
        used = at = 0
        for piece in self.pieces(text or ""):
            n = 1 if piece in self.special else self.count_piece(piece)
            if used + n > limit:
                inside = [self.piece_prefix(piece, i) for i in range(len(piece))]
                return at + max(i for i, c in enumerate(inside) if used + c <= limit)
            used, at = used + n, at + len(piece)
        return at

    def piece_prefix(self, piece: str, length: int) -> int:
        """Tokens of the first ``length`` characters of a pre-token, as a text that ends there."""
        if length == 0:
            return 0
        if piece in self.special or (piece in CONTRACTIONS and length < len(piece)):
            return sum(self.count_piece(p) for p in self.split.findall(piece[:length]))
        return self.ladder(utf8(piece))[len(utf8(piece[:length]))]


class PrefixTable:
    """The token count of every prefix of one text, as stored ladders."""

    def __init__(self, counter: PrefixCounter, text: str | None):
        self.counter, self.text = counter, text or ""
        self.pieces = list(counter.pieces(self.text))
        self.starts = [0, *accumulate(map(len, self.pieces))]
        self.totals = [0, *accumulate(1 if p in counter.special else counter.count_piece(p) for p in self.pieces)]

    def at(self, length: int) -> int:
        """Tokens of the first ``length`` characters, exactly as the library encodes them.
        White space in front of the cut is one pre-token when the text ends there."""
        head = self.text[:length]
        n = bisect_right(self.starts, length) - 1
        blank = length - len(head.rstrip())
        if blank:
            first = bisect_left(self.starts, length - blank)
            if first < len(self.pieces) and self.starts[first] == length - blank:
                return self.totals[first] + self.counter.count_piece(head[length - blank :])
        if n == len(self.pieces) or length == self.starts[n]:
            return self.totals[n]
        return self.totals[n] + self.counter.piece_prefix(self.pieces[n], length - self.starts[n])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in batches:
        sizes, counts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for n, text in enumerate(texts(batch)):
            if text:
                sizes[n], counts[n] = len(utf8(text)), own.count(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row.

    Null and empty texts have 0 bytes and 0 tokens. Rows with a null or repeated doc_id
    are counted like others; an empty table gives no rows; other columns are not read. The
    vocabulary file ``path`` must lie where every executor can read it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        partial(_counted, path=path, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def _cut_texts(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in batches:
        cut = [None if t is None else t[: own.reach(t, limit)] for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cut, pa.string())], names=["doc_id", "text"])


def truncated(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, text cut to at most ``limit`` tokens; null texts stay null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_cut_texts, path=path, limit=limit), "doc_id long, text string")
