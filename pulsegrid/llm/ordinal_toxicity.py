"""Toxicity grades by cumulative-link ordinal regression.

P(grade > j | x) = sigmoid(w.x - t_j) with one weight vector w for all ordered thresholds
t_1 < t_2 < ... over sparse word features; the expected severity is the sum of these
probabilities. The model is fitted on a bounded sample of labelled rows and applied to every
text by Spark.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import parts, texts, utf8

#: Labelled rows that the model is fitted on, about, at most.
SAMPLE = 10_000
#: A feature stands in this many distinct sampled texts at least.
SUPPORT = 4
GRADES = 3
#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 5)
STEPS = 400
L1, L2 = 2e-4, 1e-5
#: A text has every grade that it reaches with this probability.
FLAG = 0.3
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)


def word_set(text: str | None) -> set[bytes]:
    """The distinct words of a whole text."""
    found: set[bytes] = set()
    for part in parts(utf8(text).translate(_WORDS)):
        found.update(part.split())
    return found


def features(text: str | None) -> set[bytes]:
    """The distinct words of a whole text, and the beginnings of its longer words, which
    stand for word families."""
    words = word_set(text)
    starts = {b"^" + w[:n] for w in words if len(w) > 5 for n in STEMS}
    return words | starts


def sketch(text: str | None) -> int:
    """The least hash of the text's five-word shingles: near copies mostly share it."""
    least = 1 << 32
    for part in parts(utf8(text).translate(_WORDS)):
        words = part.split()
        lines = (b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
        least = min(least, min(map(zlib.crc32, lines)))
    return least


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = list(texts(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array([sketch(t) for t in own], pa.int64()), pa.array([list(features(t)) for t in own], pa.list_(pa.binary()))],
            names=["toxic", "sketch", "words"],
        )


@dataclass
class CumulativeLink:
    """weight by word, and the ordered thresholds."""

    weight: dict[bytes, float]
    thresholds: list[float]

    def probabilities(self, words: set[bytes]) -> list[float]:
        """P(grade > j) for each threshold."""
        score = sum(self.weight[w] for w in words if w in self.weight)
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - score)))) for t in self.thresholds]


def fit_cumulative_link(
    rows: list[np.ndarray], grades: np.ndarray, size: int, levels: int, rising: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the ordinal likelihood of ``grades`` (0 to
    levels - 1) on binary rows (arrays of feature numbers), with L1 and L2 penalties;
    proximal steps with per-coordinate rates. Thresholds stay ordered by their gaps. If
    ``rising``, no weight is negative: a text can't make up for what it holds elsewhere."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    above = np.array([max(1e-3, min(1 - 1e-3, (grades > j).mean())) for j in range(levels - 1)])
    cuts = np.log((1 - above) / above)
    first, gaps = cuts[0], np.log(np.maximum(np.diff(cuts), 0.05))
    weight = np.zeros(size)
    seen_w, seen_t = np.full(size, 1e-8), np.full(levels - 1, 1e-8)
    for _ in range(STEPS):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(row, weight[at], len(rows))
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, low = 1 / (1 + np.exp(-np.clip(ends[grades + 1] - score, -50, 50))), 1 / (1 + np.exp(-np.clip(ends[grades] - score, -50, 50)))
        up, low = np.where(grades == levels - 1, 1.0, up), np.where(grades == 0, 0.0, low)
        share = np.maximum(up - low, 1e-12)
        slope_up, slope_low = up * (1 - up) / share, low * (1 - low) / share
        by_score = (slope_up - slope_low) / len(rows)
        grad = np.bincount(at, by_score[row], size) + L2 * weight
        by_cut = np.array([(slope_low[grades == j + 1].sum() - slope_up[grades == j].sum()) / len(rows) for j in range(levels - 1)])
        grad_t = np.concatenate([[by_cut.sum()], [by_cut[j + 1 :].sum() * math.exp(gaps[j]) for j in range(levels - 2)]])
        seen_w, seen_t = seen_w + grad**2, seen_t + grad_t**2
        rate = 0.5 / np.sqrt(seen_w)
        weight = weight - rate * grad
        weight = np.maximum(weight - rate * L1, 0) if rising else np.sign(weight) * np.maximum(np.abs(weight) - rate * L1, 0)
        step = 0.1 * grad_t / np.sqrt(seen_t)
        first, gaps = first - step[0], gaps - step[1:]
    return weight, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def graded(words: list[list[bytes]], toxic: np.ndarray, levels: int) -> np.ndarray:
    """Grades from 0/1 labels: 0 for clean texts; toxic ones by how many different words
    they have that mark toxic texts (in few clean ones), cut at even quantiles."""
    inside, outside = Counter(), Counter()
    for own, flag in zip(words, toxic, strict=True):
        (inside if flag else outside).update(own)
    n_in, n_out = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    marks = {w for w, n in inside.items() if n >= max(SUPPORT, 0.02 * n_in) and n / n_in > 20 * (outside[w] + 0.5) / n_out}
    count = np.array([sum(w in marks for w in own) for own in words])
    hit = count[toxic == 1]
    if not len(hit):
        return np.zeros(len(words), np.int64)
    cuts = [np.quantile(hit, k / (levels - 1)) for k in range(1, levels - 1)]
    return np.where(toxic == 1, 1 + sum((count > c).astype(np.int64) for c in cuts), 0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, levels: int = GRADES) -> CumulativeLink:
    """Fit on about ``sample`` labelled rows chosen by a hash; of near copies one is used."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    known = known.select(F.col("doc_id").alias("_id"), "toxic")
    total = known.count()
    rate = min(1.0, sample / max(1, total))
    picked = known.where((F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < rate * 1_000_000))
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample's size is bounded, so its ids can be sent to every executor.
    rows = rows.join(F.broadcast(picked), rows["doc_id"] == picked["_id"]).select("toxic", "text")
    found = rows.mapInArrow(_sampled, "toxic long, sketch long, words array<binary>").toArrow()
    if not found.num_rows:
        return CumulativeLink({}, [50.0] * (levels - 1))
    order = {}
    for n, key in enumerate(zip(found["toxic"].to_pylist(), found["sketch"].to_pylist(), strict=True)):
        order.setdefault(key, n)
    chosen = found.take(sorted(order.values()))
    words = [sorted(own) for own in chosen["words"].to_pylist()]
    toxic = np.array([min(1, max(0, t)) for t in chosen["toxic"].to_pylist()])
    if toxic.min() == toxic.max():
        return CumulativeLink({}, [50.0 if toxic.max() == 0 else -50.0] * (levels - 1))
    inside = Counter(w for own, t in zip(words, toxic, strict=True) if t for w in own)
    outside = Counter(w for own, t in zip(words, toxic, strict=True) if not t for w in own)
    more = (1 - toxic).sum() / toxic.sum()
    index = {w: n for n, w in enumerate(sorted(w for w, n in inside.items() if n + outside[w] >= SUPPORT and n * more > 1.5 * outside[w]))}
    rows_at = [np.array([index[w] for w in own if w in index], np.int64) for own in words]
    grades = graded(words, toxic, levels)
    weight, thresholds = fit_cumulative_link(rows_at, grades, max(1, len(index)), levels, rising=True)
    return CumulativeLink({w: float(weight[n]) for w, n in index.items() if weight[n]}, thresholds.tolist())


def _graded(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = model.value
    for batch in batches:
        rows = [own.probabilities(features(t)) for t in texts(batch)]
        severity = [sum(r) for r in rows]
        grade = [sum(p > FLAG for p in r) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array([g > 0 for g in grade], pa.bool_())],
            names=["doc_id", "severity", "grade", "toxic"],
        )


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade), grade (0 clean to 2), toxic (grade over 0) of every
    row of ``docs``, from its whole text.

    Null and empty texts have no features and get the base rate. Without labels, or with one
    class only, every text gets that class (clean if none). Labels of unknown documents and
    null labels are not used; of repeated labels the highest counts. Rows with a null or
    repeated doc_id are graded like others; an empty table gives no rows.
    """
    model = spark.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_graded, model=model), "doc_id long, severity double, grade int, toxic boolean")
