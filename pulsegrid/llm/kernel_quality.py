"""Document quality by random Fourier features of document statistics.

Each whole text becomes a short vector of statistics. A fixed random map to cosines makes
inner products of these vectors approximate a Gaussian kernel; a ridge regression on the
cosines needs only sums over rows, which every task adds up for its own partition and Spark
adds up over tasks. The sums are kept by fold, so that the model without a fold costs no
further pass: it scores that fold's rows for an isotonic calibration, which turns scores into
shares of good documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import parts, texts, utf8, written

#: Cosines that approximate the kernel, and its width in standard deviations for each
#: root of a statistic.
COSINES = 384
WIDTH = 1.0
RIDGE = 1e-4
#: Standardised statistics are cut at this many deviations.
FAR = 4.0
#: A text is predicted to be good from this calibrated score.
GOOD = 0.7
#: Of the four remainders of a doc_id's checksum, this one is held out.
HELD_OUT = 2
FOLDS = (0, 1, 3)
#: Bins of scores that the calibration counts.
BINS = 4096
SEED = 20_240_229
#: Rows of the normal equations in one block that travels between tasks.
BLOCK = 64
_UPPER, _LOWER, _DIGIT = (np.array(list(range(*r))) for r in ((0x41, 0x5B), (0x61, 0x7B), (0x30, 0x3A)))
_SPACE, _BREAK = np.array([0x20, 0x09, 0x0B, 0x0C, 0x0D]), 0x0A
_COMMON = np.array([ord(c) for c in ".,;:'-\"()?"])
_SYMBOLS = np.array([b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:'-\"()?"])
_ENDS = tuple(c.encode() for c in (".", "!", "?", ":", ";", '"', ")", "…", "。"))
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_length", "word_spread", "log_longest_word", "upper", "digits", "spaces", "breaks",
    "common_marks", "symbols", "exclamations", "beyond_ascii", "controls", "entropy", "capital_words", "shouted_words", "ended_words",
    "symbol_words", "wordless", "short_words", "distinct_words", "distinct_pairs", "top_word", "repeated_words", "distinct_lines",
    "line_length", "ended_lines", "short_lines", "words_each_end",
)


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; null is empty. Words and lines of a very long text are
    counted in parts, so that only the distinct ones are held."""
    data = utf8(text)
    size = max(1, len(data))
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = byte[byte > 0] / size
    words, pairs, lines = Counter(), set(), set()
    n_words = repeated = total = squares = longest = capital = shouted = ended = symbol = wordless = short = 0
    n_lines = ended_lines = short_lines = 0
    for part in parts(data):
        own = part.split()
        if own:
            words.update(own)
            pairs.update(map(hash, pairwise(own)))
            repeated += sum(map(eq, own, own[1:]))
            length = np.fromiter(map(len, own), np.int64, len(own))
            n_words, total, squares = n_words + len(own), total + int(length.sum()), squares + int((length**2).sum())
            longest, short = max(longest, int(length.max())), short + int((length <= 2).sum())
        for line in part.split(b"\n"):
            line = line.strip()
            if line:
                n_lines += 1
                lines.add(hash(line))
                ended_lines += line.endswith(_ENDS)
                short_lines += len(line) < 40
    for word, n in words.items():
        first = word[0]
        capital += n * (0x41 <= first <= 0x5A)
        shouted += n * (len(word) > 1 and word.isupper())
        ended += n * word.endswith(_ENDS)
        symbol += n * (not word[-1:].isalnum() and word[-1] < 0x80 and word[-1] not in b".,;:'-\"()?!")
        wordless += n * (not any(b >= 0x80 or chr(b).isalnum() for b in word))
    n, m = max(1, n_words), max(1, n_lines)
    mean = total / n
    root = lambda x: math.sqrt(x)
    return [
        math.log1p(len(data)), math.log1p(n_words), math.log1p(n_lines), mean, math.sqrt(max(0.0, squares / n - mean**2)), math.log1p(longest),
        root(byte[_UPPER].sum() / size), root(byte[_DIGIT].sum() / size), byte[_SPACE].sum() / size, root(byte[_BREAK] / size),
        root(byte[_COMMON].sum() / size), root(byte[_SYMBOLS].sum() / size), root(byte[0x21] / size), root(byte[0x80:].sum() / size),
        root(byte[:9].sum() / size), float(-(share * np.log2(share)).sum()), capital / n, shouted / n, root(ended / n), root(symbol / n),
        root(wordless / n), short / n, len(words) / n, len(pairs) / n, root(max(words.values(), default=0) / n), root(repeated / n),
        len(lines) / m, math.log1p(size / m), ended_lines / m, short_lines / m, math.log1p(n_words / (1 + ended)),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t) for t in texts(batch)], np.float32).reshape(-1, len(STATISTICS))
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)
        stats = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), stats], names=["doc_id", "fold", "stats"])


@dataclass
class CosineMap:
    """Standardises statistics and maps them to cosines, with a constant in front."""

    mean: np.ndarray
    scale: np.ndarray
    cosines: int

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.turn = rng.standard_normal((len(self.mean), self.cosines)) / (WIDTH * math.sqrt(len(self.mean)))
        self.phase = rng.uniform(0, 2 * math.pi, self.cosines)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -FAR, FAR)
        return np.hstack([np.ones((len(z), 1)), math.sqrt(2 / self.cosines) * np.cos(z @ self.turn + self.phase)])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(STATISTICS)).astype(np.float64)


def _normal_equations(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The sums of z z', z y and 1 over a partition's rows, by fold, in blocks of rows."""
    to_cosines = sent.value
    size = to_cosines.cosines + 1
    sums = {f: np.zeros((size, size + 2)) for f in FOLDS}
    for batch in batches:
        fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
        z = to_cosines(_rows(batch))
        for f in FOLDS:
            own = z[fold == f]
            sums[f][:, :size] += own.T @ own
            sums[f][:, size] += own.T @ y[fold == f]
            sums[f][0, size + 1] += len(own)
    for f, own in sums.items():
        if own[0, -1]:
            blocks = range(0, size, BLOCK)
            data = [own[at : at + BLOCK].tobytes() for at in blocks]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(data), pa.int32()), pa.array(list(blocks), pa.int32()), pa.array(data, pa.binary())], names=["fold", "at", "part"]
            )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each (fold, at) of rows that arrive in that order; holds one at a time."""
    key = held = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["fold", "at", "part"])

    for batch in batches:
        for fold, at, part in zip(*(batch.column(c) for c in ("fold", "at", "part")), strict=True):
            own = np.frombuffer(part.as_py())
            if key == (fold.as_py(), at.as_py()):
                held = held + own
                continue
            if key is not None:
                yield out()
            key, held = (fold.as_py(), at.as_py()), own
    if key is not None:
        yield out()


def solved(sums: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights from summed normal equations; the constant is not penalised."""
    size, n = len(sums), max(1.0, sums[0, -1])
    penalty = np.full(size, ridge * n)
    penalty[0] = 1e-9 * n
    return np.linalg.solve(sums[:, :size] + np.diag(penalty), sums[:, size])


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The rising fit of the means total / weight, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for n, w, t in zip(range(len(weight)), weight, total, strict=True):
        blocks.append([w, t, n + 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, t, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + t, end]
    out, at = np.zeros(len(weight)), 0
    for w, t, end in blocks:
        out[at:end], at = t / w, end
    return out


@dataclass
class Quality:
    """The fitted model: cosine map, weights, and the calibration's bins with their shares."""

    to_cosines: CosineMap
    weights: np.ndarray
    bins: np.ndarray
    shares: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = to_bins(self.to_cosines(rows) @ self.weights)
        return np.clip(np.interp(raw, self.bins, self.shares), 0, 1)


def to_bins(score: np.ndarray) -> np.ndarray:
    """Where scores from -0.5 to 1.5 lie on the scale of bins."""
    return np.clip((score + 0.5) / 2, 0, 1) * (BINS - 1)


def _crossed(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """By bin: rows and sum of labels, each row scored by the model without its fold."""
    to_cosines, weights = sent.value
    n, total = np.zeros(BINS), np.zeros(BINS)
    for batch in batches:
        fold, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
        z = to_cosines(_rows(batch))
        for f in FOLDS:
            at = np.rint(to_bins(z[fold == f] @ weights[f])).astype(np.int64)
            n += np.bincount(at, minlength=BINS)
            total += np.bincount(at, y[fold == f], BINS)
    seen = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(total[seen])], names=["bin", "n", "total"])


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame, cosines: int = COSINES) -> Quality | None:
    """Fit on all labelled rows of ``stats`` (doc_id, fold, stats) outside the held-out fold;
    None without such rows."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(F.avg(F.least(F.greatest(F.col("quality").cast("double"), F.lit(0.0)), F.lit(1.0))).alias("y"))
    rows = stats.where(F.col("fold").isin(*FOLDS)).join(known, F.col("doc_id") == F.col("id")).select("fold", "stats", "y")
    rows = written(spark, rows, "labelled-stats")
    at = range(len(STATISTICS))
    spread = stats.agg(*[F.avg(F.get("stats", F.lit(i))) for i in at], *[F.stddev_pop(F.get("stats", F.lit(i))) for i in at]).first()
    mean, scale = (np.array([x or 0.0 for x in spread[k * len(at) : (k + 1) * len(at)]]) for k in (0, 1))
    to_cosines = CosineMap(mean, np.where(scale > 1e-9, scale, 1.0), cosines)
    kinds = "fold int, at int, part binary"
    sums = rows.mapInArrow(partial(_normal_equations, sent=spark.sparkContext.broadcast(to_cosines)), kinds)
    sums = sums.repartition(len(FOLDS) * (cosines // BLOCK + 1), "fold", "at").sortWithinPartitions("fold", "at")
    # One matrix of (cosines + 1)^2 numbers for each fold, whatever the number of rows.
    by_fold = {f: np.zeros((cosines + 1, cosines + 3)) for f in FOLDS}
    for row in sums.mapInArrow(_summed, kinds).toArrow().to_pylist():
        own = np.frombuffer(row["part"]).reshape(-1, cosines + 3)
        by_fold[row["fold"]][row["at"] : row["at"] + len(own)] = own
    whole = sum(by_fold.values())
    if not whole[0, -1]:
        return None
    # A fold that holds all labelled rows is calibrated by the model of all.
    without = {f: solved(whole - own if (whole - own)[0, -1] else whole) for f, own in by_fold.items()}
    sent = spark.sparkContext.broadcast((to_cosines, without))
    bins = rows.mapInArrow(partial(_crossed, sent=sent), "bin long, n double, total double").groupBy("bin")
    bins = bins.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("bin").toArrow()
    n, total = (bins[c].to_numpy() for c in ("n", "total"))
    return Quality(to_cosines, solved(whole), bins["bin"].to_numpy().astype(float), isotonic(n, total))


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for batch in batches:
        score = np.full(batch.num_rows, 0.5) if model is None else model.score(_rows(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(batch.column("fold").to_numpy() == HELD_OUT), pa.array(score), pa.array((score >= GOOD).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (calibrated share of good documents, 0 to 1), predicted (1 from
    a score of ``GOOD``) of every row of ``docs``, from its whole text alone.

    Null and empty texts have the statistics of an empty text. Labels of held-out or unknown
    documents and null labels are not used; repeated labels of a document are averaged. Rows
    with a null doc_id are not held out and have no label; repeated rows are scored alike and
    each counts where they are labelled; equal scores in the calibration share one value.
    Without labels every score is 0.5; with one class only it is that class. An empty table
    gives no rows; other columns are not read.
    """
    fold = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 4).cast("int"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), F.col("text").cast("string").alias("text"))
    stats = written(spark, rows.mapInArrow(_measured, "doc_id long, fold int, stats array<float>"), "quality-stats")
    sent = spark.sparkContext.broadcast(fit(spark, stats, labels))
    return stats.mapInArrow(partial(_scored, sent=sent), "doc_id long, held_out boolean, score double, predicted int")
