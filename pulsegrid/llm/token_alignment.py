"""Alignment of two tokenizers' tokens by pointer jumping.

The tokens of both encodings of a text are nodes. Each points to its farthest-right
overlapping token of the other encoding; where both end at one byte, the second encoding's
token is terminal and points to itself. Doubling the successors, for all tokens of a batch of
texts at once, brings every token to the terminal one of its component, which labels the
group: the tokens between two bytes where both encodings end a token.

How often a pair of ids is linked is counted over the whole corpus. Pairs are added up per
document, then per task, then by Spark. The counts of frequent pairs, at most ``FREQUENT``
of them, are sent to every executor; those of all other pairs meet their documents by a join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import texts, written
from pulsegrid.llm.prefix_counts import PATTERN, _byte_chars

MARK = "▁"
#: Ids of either vocabulary are below this, so that a pair fits into 32 bits.
IDS = 1 << 16
#: Characters of a part of a long text, and of the texts that are aligned at once, about.
PART = 1 << 18
TOGETHER = 1 << 20
#: Pairs of which a task holds the counts before it passes them on.
HELD = 1 << 20
#: Pairs whose counts are sent to every executor, at most: 12 bytes each.
FREQUENT = 2_000_000
_BREAK = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of ``text`` between single spaces that stand alone. Such a space starts a token
    in both encodings, so each part is encoded like a text of its own, which both put a
    space in front of."""
    at = 0
    while len(text) - at > size:
        found = _BREAK.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


class Encoders:
    """Both tokenizers, with the byte length of every token."""

    def __init__(self, first: str, second: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(first, encoding="utf-8") as file:
            data = json.load(file)
        chars = _byte_chars()
        special = {t["content"] for t in data["added_tokens"]}
        ranks = {bytes(chars[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
        self.first = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = SentencePieceProcessor(model_file=second)
        size = self.second.get_piece_size()
        if max(ranks.values()) >= IDS or size > IDS:
            raise ValueError("vocabularies of at most 65,536 ids are needed")
        self.first_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.first_bytes[i] = len(token)
        names = [self.second.id_to_piece(i) for i in range(size)]
        self.surface = [bytes([int(n[1:-1], 16)]) if self.second.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.second_bytes = np.array([len(s) for s in self.surface], np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both encodings of a space and the text; None if either loses bytes."""
        firsts, seconds = [], []
        for part in parts(text):
            data = (" " + part).encode("utf-8", "surrogatepass")
            a = self.first.encode_to_numpy(" " + part, disallowed_special=())
            b = self.second.encode(part)
            if self.first_bytes[a].sum() != len(data) or b"".join(map(self.surface.__getitem__, b)) != data:
                return None
            firsts.append(a.astype(np.int64))
            seconds.append(np.array(b, np.int64))
        return np.concatenate(firsts), np.concatenate(seconds)


@lru_cache(maxsize=1)
def encoders(first: str, second: str) -> Encoders:
    return Encoders(first, second)


def terminals(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal token (a position in b) of the component of each token of a and of b,
    two segmentations of the same bytes."""
    size = len(end_a)
    # The last token of the other side that starts before this one's end covers its last byte.
    from_a = size + np.searchsorted(start_b, end_a) - 1
    over = np.searchsorted(start_a, end_b) - 1
    from_b = np.where(end_a[over] > end_b, over, size + np.arange(len(end_b)))
    to = np.concatenate([from_a, from_b])
    while True:
        further = to[to]
        if (further == to).all():
            return to[:size] - size, to[size:] - size
        to = further


@dataclass
class Alignment:
    """Texts laid end to end: of each its tokens, groups and links, and the links' id pairs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    sha256: list[str]
    pairs: list[np.ndarray]
    counts: list[np.ndarray]


@lru_cache(maxsize=1)
def _written_ids() -> list[str]:
    return [f"{i}{mark}" for i in range(IDS) for mark in (",", "|", ";", "")]


def align(own: Encoders, both: list[tuple[np.ndarray, np.ndarray]]) -> Alignment:
    """Align the encodings of some texts, in one pass over all their tokens."""
    n_a, n_b = (np.array([len(x[side]) for x in both], np.int64) for side in (0, 1))
    a, b = (np.concatenate([x[side] for x in both]) if both else np.zeros(0, np.int64) for side in (0, 1))
    end_a, end_b = np.cumsum(own.first_bytes[a]), np.cumsum(own.second_bytes[b])
    start_a, start_b = end_a - own.first_bytes[a], end_b - own.second_bytes[b]
    last_a, last_b = terminals(start_a, end_a, start_b, end_b)
    is_last = np.zeros(len(b) + 1, np.int64)
    is_last[last_b] = 1
    number = np.cumsum(is_last) - is_last
    group_a, group_b = number[last_a], number[last_b]
    text_a, text_b = np.repeat(np.arange(len(both)), n_a), np.repeat(np.arange(len(both)), n_b)
    n_groups = np.bincount(text_b, is_last[: len(b)], len(both)).astype(np.int64)
    # Links: the run of tokens of b from the first that ends behind a token's start.
    low = np.searchsorted(end_b, start_a, "right")
    each = np.searchsorted(start_b, end_a) - low
    linked = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
    n_links = np.bincount(text_a, each, len(both)).astype(np.int64)
    key = np.repeat((text_a << 32) | (a << 16), each) | b[linked]
    key, count = np.unique(key, return_counts=True)
    cuts = np.searchsorted(key, np.arange(1, len(both)) << 32)
    pairs = np.split((key & 0xFFFFFFFF).astype(np.uint32), cuts)
    counts = np.split(count.astype(np.uint32), cuts)
    # Both sides in one row: a token stands behind its own side and the other's earlier groups.
    groups = int(number[-1]) if len(number) else 0
    before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=groups))])
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=groups))])
    row_a, row_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b + 1]
    row, side, ids = (np.zeros(len(a) + len(b), np.int64) for _ in range(3))
    row[row_a], row[row_b], ids[row_a], ids[row_b], side[row_b] = group_a, group_b, a, b, 1
    mark = np.where(row[1:] != row[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    mark = np.append(mark, 3) if len(row) else mark
    ends = np.cumsum(n_a + n_b)
    mark[ends[ends > 0] - 1] = 3
    shown, names = ids * 4 + mark, _written_ids()
    digests = []
    for lo, hi in zip(ends - n_a - n_b, ends, strict=True):
        if lo == hi:
            digests.append("")
            continue
        digest = sha256()
        for at in range(lo, hi, TOGETHER):
            digest.update("".join(map(names.__getitem__, shown[at : min(hi, at + TOGETHER)].tolist())).encode())
        digests.append(digest.hexdigest())
    return Alignment(n_a, n_b, n_groups, n_links, digests, pairs, counts)


_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"
_NONE = np.zeros(0, np.int64)


def _aligned(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    own = encoders(first, second)
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    for batch in batches:
        at, both, size = 0, [], 0
        for n, text in enumerate(texts(batch)):
            both.append((own.encode(text) if text else None) or (_NONE, _NONE))
            size += len(text or "")
            if size >= TOGETHER or n == batch.num_rows - 1:
                made = align(own, both)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, n + 1 - at),
                        *map(pa.array, (made.n_a, made.n_b, made.n_groups, made.n_links, made.sha256)),
                        # Sorted pairs as steps, which take less room once compressed.
                        pa.array([np.diff(p, prepend=np.uint32(0)).astype("<u4").tobytes() for p in made.pairs], pa.binary()),
                        pa.array([c.astype("<u4").tobytes() for c in made.counts], pa.binary()),
                    ],
                    names=names,
                )
                at, both, size = n + 1, [], 0


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs and their counts of each row."""
    for steps, counts in zip(batch.column("pairs"), batch.column("counts"), strict=True):
        own = np.cumsum(np.frombuffer(steps.as_py(), "<u4"), dtype=np.uint32)
        yield own.astype(np.int64), np.frombuffer(counts.as_py(), "<u4").astype(np.int64)


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of pairs over the rows of a task, passed on when there are many."""
    pairs, counts, held = [], [], 0

    def out(found: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(count)], names=["pair", "n"])

    for batch in batches:
        for own, count in _stored(batch):
            pairs.append(own)
            counts.append(count)
            held += len(own)
            if held >= 2 * HELD:
                found, count = _summed(pairs, counts)
                if len(found) >= HELD:
                    yield out(found, count)
                    pairs, counts, held = [], [], 0
                else:
                    pairs, counts, held = [found], [count], len(found)
    if pairs:
        yield out(*_summed(pairs, counts))


def _looked_up(batches: Iterator[pa.RecordBatch], frequent) -> Iterator[pa.RecordBatch]:
    """What frequent pairs add to each document, and its other pairs."""
    known, signed = frequent.value
    for batch in batches:
        best, total, rest, times = [], [], [], []
        for own, count in _stored(batch):
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            value = signed[at[hit]]
            best.append(int(count[hit][value > 0].sum()))
            total.append(int((np.abs(value) * count[hit]).sum()))
            rest.append(own[~hit])
            times.append(count[~hit])
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (rest, times)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(best, pa.int64()), pa.array(total, pa.int64()), *lists],
            names=["row", "n_best", "count_sum", "rest", "times"],
        )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (A id * 65536 + B id), n (links of the corpus), best (no pair of that B id has more)."""
    pairs = aligned.select("pairs", "counts").mapInArrow(_added, "pair long, n long")
    pairs = written(aligned.sparkSession, pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    most = pairs.groupBy((F.col("pair") % IDS).alias("b")).agg(F.max("n").alias("most"))
    # One row for each id of the second vocabulary, 65,536 at most.
    return pairs.join(F.broadcast(most), pairs["pair"] % IDS == most["b"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(spark: SparkSession, docs: DataFrame, first: str, second: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Null and empty texts, and those of which an encoding does not keep the bytes (a word mark
    in the text becomes a space in the second one), have zeros and an empty groups_sha256 and
    add to no count. Rows with a null or repeated doc_id are treated like others; equal texts
    count as often as they stand in the table, and among equal highest counts each is best.
    An empty table gives no rows; other columns are not read. Texts of any length are encoded
    in parts. Both vocabulary files must lie where every executor can read them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(partial(_aligned, first=first, second=second), _COLUMNS)
    rows = written(spark, rows.select(F.monotonically_increasing_id().alias("row"), "*"), "aligned")
    counts = written(spark, pair_counts(rows), "pair-counts")
    # The least power of two that few enough pairs reach.
    steps = [F.count_if(F.col("n") >= 1 << k).alias(str(k)) for k in range(63)]
    reach = counts.agg(*steps).first()
    least = next((1 << k for k in range(63) if (reach[k] or 0) <= frequent), 1 << 62)
    often = counts.where(F.col("n") >= least).select("pair", F.when(F.col("best"), F.col("n")).otherwise(-F.col("n")).alias("n")).toArrow()
    order = np.argsort(often["pair"].to_numpy())
    sent = spark.sparkContext.broadcast((often["pair"].to_numpy()[order], often["n"].to_numpy()[order]))
    kinds = "row long, n_best long, count_sum long, rest array<long>, times array<long>"
    found = rows.select("row", "pairs", "counts").mapInArrow(partial(_looked_up, frequent=sent), kinds)
    other = found.select("row", F.explode(F.arrays_zip("rest", "times")).alias("own"))
    other = other.select("row", F.col("own.rest").alias("pair"), F.col("own.times").alias("times"))
    other = other.join(counts.where(F.col("n") < least), "pair")
    other = other.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    sums = found.select("row", "n_best", "count_sum").unionByName(other).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
