"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: row p holds a mask of the languages whose
filter has bit p set. The AND of an n-gram's rows is the mask of all languages that may
contain it, in one look-up for all languages. A text's score for a language is the count of
its n-grams with that bit, corrected for the filter's false positives; the largest decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import drawn_below, parts, texts, utf8, written

GRAM = 4
BITS = 20
#: Labelled documents of one language that the filters are fitted on, about, at most.
SAMPLE = 4_000
#: An n-gram is in a language's filter if it is in this share of the language's sample.
SUPPORT = 0.005
MASK = 63
UNKNOWN = "und"
# Multipliers of the hash functions; each gives one row of the filter.
ODD = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
# ASCII letters in lower case and bytes of other characters stay, the rest becomes a space.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str | None) -> Iterator[np.ndarray]:
    """All n-grams of a whole text (four bytes of lower-cased words, one space between) as
    32-bit numbers, in arrays of bounded length."""
    if text is None:
        return
    for part in parts(utf8(text.lower()).translate(_LETTERS)):
        words = part.split()
        if not words:
            continue
        # A single letter and the spaces around it are one byte short of an n-gram.
        data = np.frombuffer((b" " + b" ".join(words) + b" ").ljust(GRAM), np.uint8).astype(np.uint32)
        if len(data) >= GRAM:
            yield data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)


def rows_of(values: np.ndarray) -> list[np.ndarray]:
    """The filter rows of n-grams, one array per hash function."""
    mixed = values ^ (values >> np.uint32(15))
    return [(mixed * odd) >> np.uint32(32 - BITS) for odd in ODD]


@dataclass
class Filters:
    """langs: the languages in order; table: rows by mask words; false: their false positive rates."""

    langs: list[str]
    table: np.ndarray
    false: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letters(text):
            return UNKNOWN, 0.0
        hits, total = np.zeros(len(self.langs)), 0
        for values in grams(text):
            total += len(values)
            one, two, three = rows_of(values)
            for w in range(self.table.shape[1]):
                masks = self.table[one, w] & self.table[two, w] & self.table[three, w]
                low = w * MASK
                for n in range(low, min(low + MASK, len(self.langs))):
                    hits[n] += np.count_nonzero(masks & np.uint64(1 << (n - low)))
        if not total:
            return UNKNOWN, 0.0
        share = np.clip((hits / total - self.false) / (1 - self.false), 0, 1)
        best = int(np.argmax(share))
        return self.langs[best], float(share[best])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        langs = batch.column("lang").to_pylist()
        drawn = Counter(langs)
        # A row per language with g = -1 has the number of documents drawn.
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(drawn)), pa.array([-1] * len(drawn)), pa.array(list(drawn.values()))], names=["lang", "g", "docs"]
        )
        for text, lang in zip(texts(batch), langs, strict=True):
            own = [np.unique(g) for g in grams(text)]
            if own:
                found.setdefault(lang, []).append(np.unique(np.concatenate(own)))
        for lang, own in found.items():
            values, counts = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values)), pa.array(values.astype(np.int64)), pa.array(counts)], names=["lang", "g", "docs"]
            )


def _bloom_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("g").to_numpy().astype(np.uint32)
        index = batch.column("n").to_numpy()
        rows = np.concatenate(rows_of(values)).astype(np.int64)
        times = len(ODD)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(np.tile(index // MASK, times)), pa.array(np.tile(np.left_shift(1, index % MASK), times))],
            names=["row", "word", "mask"],
        )


def fit_filters(spark: SparkSession, labelled: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from rows (doc_id, text, lang). Of each language about ``sample`` documents
    are used, chosen by a hash of doc_id and text; n-gram counts and masks are summed by
    Spark. The table has a fixed number of rows, so collecting it is bounded."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    words = max(1, -(-len(langs) // MASK))
    table = np.zeros((1 << BITS, words), np.uint64)
    if not langs:
        return Filters([], table, np.zeros(0))
    rates = spark.createDataFrame(
        [(lang, min(1.0, sample / sizes[lang])) for lang in langs], "lang string, rate double"
    )
    picked = rows.join(F.broadcast(rates), "lang").where(drawn_below(F.col("rate"), "doc_id", "text"))
    counted = picked.select("text", "lang").mapInArrow(_document_grams, "lang string, g long, docs long")
    counted = written(spark, counted.groupBy("lang", "g").agg(F.sum("docs").alias("docs")), "grams")
    drawn = {r["lang"]: r["docs"] for r in counted.where("g < 0").collect()}
    least = spark.createDataFrame(
        [(lang, n, max(1, round(drawn.get(lang, 0) * SUPPORT))) for n, lang in enumerate(langs)], "lang string, n long, least long"
    )
    kept = counted.where("g >= 0").join(F.broadcast(least), "lang").where("docs >= least").select("g", "n")
    masks = kept.mapInArrow(_bloom_rows, "row long, word long, mask long").groupBy("row", "word").agg(F.bit_or("mask").alias("mask"))
    found = masks.toArrow()
    table[found["row"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy().astype(np.uint64)
    fill = np.array([np.count_nonzero(table[:, n // MASK] & np.uint64(1 << (n % MASK))) for n in range(len(langs))]) / len(table)
    return Filters(langs, table, fill ** len(ODD))


def _predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    filters = model.value
    for batch in batches:
        rows = [filters.predict(t) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    Learns from rows that are not held out and have a language; predicts from the text
    alone. A text that is null or has no letters is ``und`` with score 0, as is every row
    where nothing can be learned; letters that no language knows get the first by name and 0. A row with a null doc_id is not held out. Ties go to the
    language first by name. Repeated rows are predicted alike; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    filters = fit_filters(spark, own.where(~held_out()))
    model = spark.sparkContext.broadcast(filters)
    rows = own.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(partial(_predicted, model=model), "doc_id long, held_out boolean, lang_pred string, score double")


def _kept(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    filters = model.value
    for batch in batches:
        good = [(p := filters.predict(t))[0] != UNKNOWN and p[1] >= least for t in texts(batch)]
        yield batch.filter(pa.array(good, pa.bool_()))


def known_language(spark: SparkSession, docs: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs`` whose text is in a language of the corpus: not ``und`` and at
    least the share ``least`` of its n-grams known. Columns stay as they are."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = spark.sparkContext.broadcast(fit_filters(spark, own.where(~held_out())))
    return docs.mapInArrow(partial(_kept, model=model, least=least), docs.schema)
