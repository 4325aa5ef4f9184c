"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages; a distributed randomised SVD of their TF-IDF matrix
(IDF counted over the whole corpus) gives a latent space. Every window of every document is
projected into it and held against the passages; what could cover half of a passage's
weight is verified: by the longest common subsequence of words, by the weight of
the words in common, and by the passage's end (its answer). Paraphrases that keep the order
of most words are found as well as copies.

Benchmarks are worked through in blocks of about ``BLOCK`` passages, so what is broadcast to
the tasks is bounded: about BLOCK * PASSAGE words and BLOCK passages, each with as many
numbers. Rows have unit length and the rank is that of the block, so short passages keep
their energy; what a passage still loses is measured and allowed for, so that the latent
search passes whatever the verification could accept.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import parts, texts, utf8, written

PASSAGE = 64
BLOCK = 256
OVER = 16
#: A match has this share of the passage's words in order,
ORDERED = 0.6
#: this share of its TF-IDF weight in common,
WEIGHT = 0.5
#: and this share of its last quarter (the answer) in order, unless
ANSWER = 0.5
#: this share of it stands there word for word.
VERBATIM = 0.5
#: Room for rounding in the latent search, as a share of the lengths of both vectors.
ROUNDING = 1e-4
SHORTEST = 5
#: Windows that are gathered before they are searched, and known words that are projected at once.
TOGETHER = 1024
CELLS = 1 << 14
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORDS).split()


def common_order(a: list, b: list) -> int:
    """Length of the longest common subsequence, 64 and more cells per operation."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if hit := row & places.get(x, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def longest_run(a: list, b: list) -> int:
    """Length of the longest stretch of words that stands in both."""
    best, before = 0, {}
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    for x in a:
        here = {j: before.get(j - 1, 0) + 1 for j in places.get(x, ())}
        best, before = max(best, *here.values(), 0), here
    return best


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, ns, lists = [], [], []
        for item, text in zip(batch.column("item_id").to_pylist(), texts(batch), strict=True):
            words = words_of(text)
            if len(words) < SHORTEST:
                continue
            cuts = range(0, max(1, len(words) - PASSAGE // 2), PASSAGE // 2) if len(words) > PASSAGE else (0,)
            for n, at in enumerate(cuts):
                ids.append(item)
                ns.append(n)
                lists.append(words[at : at + PASSAGE])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(lists, pa.list_(pa.binary()))],
            names=["item_id", "n", "words"],
        )


def _frequencies(batches: Iterator[pa.RecordBatch], words) -> Iterator[pa.RecordBatch]:
    asked, found, rows = words.value.keys(), Counter(), 0
    for batch in batches:
        for text in texts(batch):
            rows += 1
            present: set[bytes] = set()
            for part in parts(utf8(text).translate(_WORDS)):
                present |= asked & set(part.split())
            found.update(present)
    yield pa.RecordBatch.from_arrays(
        [pa.array([b"", *found], pa.binary()), pa.array([rows, *found.values()], pa.int64())], names=["word", "docs"]
    )


def _vectors(batches: Iterator[pa.RecordBatch], words, idf) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Each batch of passages with its rows of the TF-IDF matrix (word numbers, weights), of
    unit length each."""
    index, weight = words.value, idf.value
    for batch in batches:
        rows = []
        for own in batch.column("words").to_pylist():
            counted = Counter(index[w] for w in own)
            at = np.array(sorted(counted))
            row = np.array([counted[i] for i in at]) * weight[at]
            rows.append((at, row / max(np.sqrt(row @ row), 1e-12)))
        yield batch, rows


def _sketch(batches, words, idf, probe) -> Iterator[pa.RecordBatch]:
    """A @ probe, row by row."""
    for batch, rows in _vectors(batches, words, idf):
        made = [v @ probe.value[at] for at, v in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("n"), batch.column("words"), pa.array(made, pa.list_(pa.float64()))],
            names=["item_id", "n", "words", "y"],
        )


def _gram(batches) -> Iterator[pa.RecordBatch]:
    """The partition's share of the sketch's Gram matrix, one row for each of its rows."""
    total = None
    for batch in batches:
        y = np.array(batch.column("y").to_pylist())
        if len(y):
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])


def _transposed(batches, words, idf, turn) -> Iterator[pa.RecordBatch]:
    """The partition's share of A' @ (y @ turn): a vector for each word."""
    sums: dict[int, np.ndarray] = {}
    for batch, rows in _vectors(batches, words, idf):
        for (at, v), y in zip(rows, batch.column("y").to_pylist(), strict=True):
            q = np.array(y) @ turn.value
            for i, x in zip(at.tolist(), v, strict=True):
                sums[i] = sums[i] + x * q if i in sums else x * q
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "v"])


def _summed(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and element-wise sums of vectors, added up by Spark."""
    added = rows.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v")).toArrow()
    return added["i"].to_numpy(), np.array(added["v"].to_pylist()).reshape(-1, width)


def latent_basis(spark: SparkSession, passages: DataFrame, words, idf, rank: int, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (words by ``rank``) of the passages' TF-IDF matrix.

    Randomised range finder with one power step; the passages stay distributed, the driver
    sees only matrices of the sketch's width and one vector per word of the block.
    """
    size, width = len(idf.value), rank + OVER
    probe = np.random.default_rng(seed).standard_normal((size, width))
    for step in range(2):
        sent = spark.sparkContext.broadcast(probe)
        sketch = written(
            spark, passages.mapInArrow(partial(_sketch, words=words, idf=idf, probe=sent), "item_id long, n long, words array<binary>, y array<double>"), "sketch"
        )
        at, rows = _summed(sketch.mapInArrow(_gram, "i long, v array<double>"), width)
        gram = np.zeros((width, width))
        gram[at] = rows
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        good = values > max(values.max(), 0) * 1e-10
        turn = np.zeros((width, width))
        turn[:, : good.sum()] = vectors[:, good] / np.sqrt(values[good])
        at, rows = _summed(
            sketch.mapInArrow(partial(_transposed, words=words, idf=idf, turn=spark.sparkContext.broadcast(turn)), "i long, v array<double>"), width
        )
        probe = np.zeros((size, width))
        probe[at] = rows
    values, vectors = np.linalg.eigh(probe.T @ probe)
    order = np.argsort(-values)[:rank]
    order = order[values[order] > max(values.max(), 0) * 1e-10]
    return np.linalg.qr(probe @ vectors[:, order] / np.sqrt(values[order]))[0].astype(np.float32)


def least_product(counts: np.ndarray, energy: np.ndarray) -> float:
    """The least product of a passage's TF-IDF vector with that of a text that has ``WEIGHT``
    of the passage's weight in common: words that the passage has seldom are there first."""
    order = np.argsort(counts)
    mass = (counts * energy)[order]
    before = np.cumsum(mass) - mass
    return float(counts[order] @ np.clip(WEIGHT * mass.sum() - before, 0, mass))


@dataclass
class Block:
    index: dict[bytes, int]
    energy: np.ndarray
    basis: np.ndarray
    items: list[int]
    words: list[list[bytes]]
    latent: np.ndarray
    weight: np.ndarray
    #: Of each passage: the length that its latent vector lacks, the least product with a
    #: window that holds a match, and the energy of its words.
    lost: np.ndarray
    least: np.ndarray
    mass: np.ndarray

    def matches(self, text: str | None) -> dict[int, tuple[float, float, int]]:
        """item -> (share of words in order, cosine, first word of the window), its best."""
        return self.matches_of([text])[0]

    def matches_of(self, all_texts: Iterable[str | None]) -> list[dict[int, tuple[float, float, int]]]:
        """The matches of each text. Windows of many texts are projected and held against the
        passages together."""
        best: list[dict[int, tuple[float, float, int]]] = []
        held, size = [], 0
        for text in all_texts:
            best.append({})
            tail: list[bytes] = []
            at = 0
            for part in parts(utf8(text).translate(_WORDS)):
                words = tail + part.split()
                held.append((best[-1], at, words, *self._windows(words)))
                size += len(held[-1][3])
                if size >= TOGETHER:
                    self._search(held)
                    held, size = [], 0
                keep = min(len(words), 2 * PASSAGE)
                at, tail = at + len(words) - keep, words[len(words) - keep :]
        self._search(held)
        return best

    def _windows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first words of the windows that could hold a match, and the numbers of their
        known words, window after window, with how many each has."""
        get = self.index.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        place = np.flatnonzero(ids >= 0)
        known = ids[place]
        total = np.concatenate([[0.0], np.cumsum(self.energy[known])])
        starts = np.arange(0, max(1, len(words) - PASSAGE), PASSAGE)
        low, high = np.searchsorted(place, starts), np.searchsorted(place, starts + 2 * PASSAGE)
        # A window with less weight than the least that a match needs can't hold one.
        some = total[high] - total[low] >= max(1e-9, WEIGHT * self.mass.min() - 1e-9)
        starts, low, high = starts[some], low[some], high[some]
        each = high - low
        spots = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return starts, known[spots], each

    def _search(self, held: list[tuple]) -> None:
        """Add the matches in the windows of ``held`` (best, offset, words, starts, known, each)."""
        each = np.concatenate([h[5] for h in held]) if held else np.zeros(0, np.int64)
        if not len(each):
            return
        owner = np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
        starts, known = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        ends = np.cumsum(each)
        size = len(self.energy)
        low = 0
        while low < len(each):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS, "right")))
            words = known[ends[low] - each[low] : ends[high - 1]]
            cells, counts = np.unique(np.repeat(np.arange(high - low), each[low:high]) * size + words, return_counts=True)
            window, word = cells // size, cells % size
            value = counts * np.sqrt(self.energy[word])
            length = np.bincount(window, value**2, high - low)
            first = np.searchsorted(window, np.arange(high - low))
            seen = np.add.reduceat(value.astype(np.float32)[:, None] * self.basis[word], first, axis=0)
            product = seen @ self.latent.T
            norms = np.sqrt(length[:, None] * self.weight)
            # What both vectors lack in the latent space adds no more than its lengths' product.
            lacking = np.sqrt(np.maximum(0.0, length - (seen.astype(np.float64) ** 2).sum(axis=1)))
            floor = self.least - lacking[:, None] * self.lost - ROUNDING * norms
            for n, i in zip(*np.nonzero(product >= floor), strict=True):
                best, offset, own = held[owner[low + n]][:3]
                start = int(starts[low + n])
                share = self.verified(i, own[start : start + 2 * PASSAGE])
                cosine = float(product[n, i] / norms[n, i])
                if share and (share, cosine) > best.get(self.items[i], (0.0, 0.0, 0))[:2]:
                    best[self.items[i]] = (share, cosine, offset + start)
            low = high

    def verified(self, i: int, window: list[bytes]) -> float:
        """The share of passage ``i`` in order in the window if it is a match, else 0."""
        passage = self.words[i]
        share = common_order(passage, window) / len(passage)
        if share < ORDERED:
            return 0.0
        there = Counter(window)
        weight = sum(min(n, there[w]) * self.energy[self.index[w]] for w, n in Counter(passage).items())
        if weight < WEIGHT * sum(self.energy[self.index[w]] for w in passage):
            return 0.0
        if longest_run(passage, window) >= VERBATIM * len(passage):
            return share
        answer = passage[-max(3, len(passage) // 4) :]
        return share if common_order(answer, window) >= ANSWER * len(answer) else 0.0


def _block(spark: SparkSession, docs: DataFrame, passages: DataFrame) -> Block:
    """The model of one block of passages."""
    rows = passages.select("item_id", "words").orderBy("item_id", "n").toArrow()
    items, lists = rows["item_id"].to_pylist(), rows["words"].to_pylist()
    index = {w: n for n, w in enumerate(sorted({w for own in lists for w in own}))}
    words = spark.sparkContext.broadcast(index)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(_frequencies, words=words), "word binary, docs long")
    found = counted.groupBy("word").agg(F.sum("docs").alias("docs")).toArrow()
    found = dict(zip(found["word"].to_pylist(), found["docs"].to_pylist(), strict=True))
    corpus = found.pop(b"", 0) or 0
    idf = np.log((2 + corpus) / (1 + np.array([found.get(w, 0) for w in index])))
    sent = spark.sparkContext.broadcast(idf)
    basis = latent_basis(spark, passages, words, sent, len(items))
    latent = np.zeros((len(items), basis.shape[1]))
    weight, least, mass = (np.zeros(len(items)) for _ in range(3))
    for n, own in enumerate(lists):
        counted = Counter(index[w] for w in own)
        at, counts = np.array(list(counted)), np.array(list(counted.values()))
        latent[n] = (counts * idf[at]) @ basis[at].astype(np.float64)
        weight[n] = ((counts * idf[at]) ** 2).sum()
        least[n], mass[n] = least_product(counts, idf[at] ** 2), counts @ idf[at] ** 2
    lost = np.sqrt(np.maximum(weight - (latent**2).sum(axis=1), 0))
    return Block(index, idf**2, basis, items, lists, latent.astype(np.float32), np.maximum(weight, 1e-12), lost, least, mass)


def _found(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    block = model.value
    for batch in batches:
        rows = defaultdict(list)
        for doc, found in zip(batch.column("doc_id").to_pylist(), block.matches_of(texts(batch)), strict=True):
            for item, (share, cosine, at) in sorted(found.items()):
                for name, value in (("doc_id", doc), ("item_id", item), ("ordered", share), ("cosine", cosine), ("first_word", at)):
                    rows[name].append(value)
        kinds = (("doc_id", pa.int64()), ("item_id", pa.int64()), ("ordered", pa.float64()), ("cosine", pa.float64()), ("first_word", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in kinds], names=[n for n, _ in kinds])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, ordered, cosine, first_word: each document with each benchmark item
    found in it, once: the best window's share of words in order, its cosine and its place.

    Null and empty texts and items under ``SHORTEST`` words match nothing; null item ids
    count as no item. Repeated rows give their pairs once; rows with a null doc_id are
    skipped. Empty tables give no rows; other columns are not read.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    passages = items.distinct().mapInArrow(_passages, "item_id long, n long, words array<binary>")
    passages = written(spark, passages, "passages")
    count = passages.count()
    schema = "doc_id long, item_id long, ordered double, cosine double, first_word long"
    out = spark.createDataFrame([], schema)
    blocks = -(-count // BLOCK)
    for n in range(blocks):
        own = passages.where(F.pmod(F.xxhash64("item_id", "n"), F.lit(blocks)) == n)
        if own.isEmpty():
            continue
        model = spark.sparkContext.broadcast(_block(spark, rows, own))
        out = out.unionByName(rows.mapInArrow(partial(_found, model=model), schema))
    best = F.max(F.struct("ordered", "cosine", (-F.col("first_word")).alias("back")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.ordered", "best.cosine", (-F.col("best.back")).alias("first_word")
    )


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found; columns stay as they are.
    Rows with a null doc_id stay."""
    found = written(spark, contaminated(spark, docs, benchmark).select(F.col("doc_id").alias("_leaky")).distinct(), "leaky")
    return docs.join(found, docs["doc_id"] == found["_leaky"], "left_anti")
