"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Texts
with one fingerprint form a class; classes link at ``radius`` or fewer differing bits.
For up to three bits, candidates share two of five blocks of the fingerprint's bits
(pigeonhole: no pair is lost). Near copies by Jaccard similarity share one of ``MINIMA`` least
shingle hashes and lie within a wide radius; both only find candidates, which link where
their MinHash signatures of ``SIGNATURE`` minima agree enough. Within a bucket the fingerprints are stored as vertical bit planes, 64 to a machine word;
a query is held against all lanes of a word at once with carry-save counters, and a word is
abandoned as soon as all of its lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import components, merge_labels, parts, texts, utf8, written

SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
CHUNK = 2048
MINIMA = 6
SIGNATURE = 256
#: Odd factors that give each minimum an order of its own; the signature's follow.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
FACTORS = np.concatenate([FACTORS, np.random.default_rng(SEED).integers(0, 1 << 63, SIGNATURE, np.uint64) * np.uint64(2) + np.uint64(1)])
PAIRS = 1 << 16
ASKED = 1 << 12
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """The hashes of all shingles of ``words``, eight bytes each, highest first."""
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    made = b"".join([digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)])
    return np.frombuffer(made, np.uint8).reshape(-1, 8)


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Shingle hashes of a whole text in tables of bounded length; none without words."""
    tail, seen, made = [], 0, False
    for part in parts(utf8(text).lower()):
        words = part.split()
        seen += len(words)
        words = tail + words
        if len(words) >= width:
            made = True
            yield _hashes(words, width)
        tail = words[-(width - 1) :] if width > 1 else []
    if seen and not made:
        yield _hashes(tail, len(tail))


def summary(text: str | None, width: int = 3, minima: int = 0) -> tuple[int, np.ndarray]:
    """The unsigned fingerprint of a whole text (0 where it has no words), and the least of
    its shingle hashes in ``minima`` different orders."""
    votes, total = np.zeros(64, np.int64), 0
    least = np.full(minima, FULL, np.uint64)
    for table in shingle_hashes(text, width):
        total += len(table)
        for at in range(0, len(table), 1 << 15):
            votes += np.unpackbits(table[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
        if minima:
            values = table.copy().view(">u8").ravel().astype(np.uint64)
            for at in range(0, len(values), 512):
                least = np.minimum(least, (values[at : at + 512, None] * FACTORS[:minima]).min(axis=0))
    if not total:
        return 0, least[:0]
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big"), least


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([summary(t, width)[0] for t in texts(batch)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, width=width), "doc_id long, fp long")


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [summary(t, width, len(FACTORS)) for t in texts(batch)]
        least = [m for _, m in found]
        fps = np.array([f for f, _ in found], np.uint64)
        nodes = [xxhash.xxh64_intdigest(f.tobytes() + m.tobytes(), SEED) for f, m in zip(fps, least, strict=True)]
        columns = [
            batch.column("doc_id"),
            pa.array(np.array(nodes, np.uint64).view(np.int64)),
            pa.array(fps.view(np.int64)),
            pa.array([m[:MINIMA].view(np.int64) for m in least], pa.list_(pa.int64())),
            pa.array([(m[MINIMA:] >> np.uint64(32)).astype(np.uint32).tobytes() for m in least], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "least", "sig"])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node (a hash of fingerprint and minima), fp, the ``MINIMA`` least shingle hashes
    and sig (``SIGNATURE`` more, four bytes each) of every row; every text must have words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_signatures, width=width), "doc_id long, node long, fp long, least array<long>, sig binary")


def _keys() -> list[Column]:
    """One key for each two of the five blocks, with the pair's number above it."""
    shifts = [0, *accumulate(WIDTHS)]
    blocks = [
        F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for shift, width in zip(shifts, WIDTHS, strict=False)
    ]
    return [
        F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(blocks[i], 13) + blocks[j]
        for n, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2))
    ]


def sliced_links(fps: np.ndarray, starts: np.ndarray, asks: np.ndarray, answers: np.ndarray, radius: int, accept=None) -> np.ndarray:
    """Label each fingerprint with the first of its group (``starts``) that it reaches by
    links. Only entries in ``asks`` are queries and only those in ``answers`` are lanes.
    With ``accept`` (arrays of places -> booleans) only pairs that it accepts link; pairs
    that are connected already are not asked."""
    n = len(fps)
    sizes = np.diff(np.append(starts, n))
    first = np.repeat(starts, sizes)
    at = np.arange(n) - first
    lane, own = (at & 63).astype(np.uint64), at >> 6
    words = (sizes + 63) >> 6
    word0 = np.cumsum(words) - words
    heads = np.flatnonzero((at & 63) == 0)
    one = np.uint64(1)
    planes = np.stack([np.bitwise_or.reduceat(((fps >> np.uint64(b)) & one) << lane, heads) for b in range(64)])
    valid = np.bitwise_or.reduceat(answers.astype(np.uint64) << lane, heads)
    group = np.repeat(np.arange(len(starts)), sizes)
    labels = np.arange(n)
    every = np.flatnonzero(asks)
    counts = words[group[every]]
    bounds = np.searchsorted(np.cumsum(counts), np.arange(PAIRS, counts.sum() + PAIRS, PAIRS), "left") + 1
    low = 0
    for high in np.unique(np.minimum(bounds, len(every))):
        asked, times = every[low:high], counts[low:high]
        low = high
        query = np.repeat(asked, times)
        if not len(query):
            continue
        step = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
        word = word0[group[query]] + step
        lanes = valid[word].copy()
        mine = step == own[query]
        lanes[mine] &= ~(one << lane[query[mine]])
        over = ~lanes
        counters = [np.zeros(len(query), np.uint64) for _ in range(max(1, radius.bit_length()))]
        for b in range(64):
            carry = planes[b][word] ^ (np.uint64(0) - ((fps[query] >> np.uint64(b)) & one))
            for n, plane in enumerate(counters):
                counters[n], carry = plane ^ carry, plane & carry
            over |= carry | _beyond(counters, radius)
            if b & 7 == 7:
                live = over != FULL
                query, word, over, *counters = (x[live] for x in (query, word, over, *counters))
                if not len(query):
                    break
        if len(query):
            bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, col = np.nonzero(bits)
            a, b = query[row], heads[word[row]] + col
            if accept is None:
                labels = merge_labels(labels, a, b)
                continue
            for at in range(0, len(a), ASKED):
                x, y = a[at : at + ASKED], b[at : at + ASKED]
                apart = labels[x] != labels[y]
                x, y = x[apart], y[apart]
                true = accept(x, y)
                labels = merge_labels(labels, x[true], y[true])
    return labels


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count (lowest bit plane first) exceeds ``radius``; what does not fit the
    planes has gone over as a carry."""
    more, same = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for bit in reversed(range(len(counters))):
        if radius >> bit & 1:
            same = same & counters[bit]
        else:
            more = more | (same & counters[bit])
            same = same & ~counters[bit]
    return more


def _links(batches: Iterator[pa.RecordBatch], radius: int, similar: float | None = None) -> Iterator[pa.RecordBatch]:
    rest: np.ndarray | None = None
    sigs: np.ndarray | None = None
    names = ("g", "low", "high", "side", "fp") if similar is None else ("g", "low", "high", "side", "fp", "node")

    def linked(rows: np.ndarray, sigs: np.ndarray | None) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        fps, low, high, side = rows[:, 4].copy().view(np.uint64), rows[:, 1], rows[:, 2], rows[:, 3]
        whole = low == high
        accept = None if sigs is None else lambda a, b: (sigs[a] == sigs[b]).sum(axis=1) >= similar * SIGNATURE - 1e-9
        labels = sliced_links(fps, starts, whole | (side == low), whole | (side == high), radius, accept)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(rows[moved, -1]), pa.array(rows[labels[moved], -1])], names=["a", "b"])

    for batch in batches:
        rows = np.column_stack([batch.column(c).to_numpy() for c in names])
        rows = rows if rest is None else np.concatenate([rest, rows])
        if similar is not None:
            own = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, SIGNATURE)
            sigs = own if sigs is None else np.concatenate([sigs, own])
        if not len(rows):
            continue
        ends = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
        cut = ends[-1] + 1 if len(ends) else 0
        if cut:
            yield linked(rows[:cut], None if sigs is None else sigs[:cut])
        rest, sigs = rows[cut:], None if sigs is None else sigs[cut:]
    if rest is not None and len(rest):
        yield linked(rest, sigs)


def _dealt(keyed: DataFrame, chunk: int, unit: str) -> DataFrame:
    """The rows (g, ``unit``, ...) of buckets with more than one, with the two chunks (low,
    high) that meet and the row's own (side)."""
    sizes = keyed.groupBy("g").count().where("count > 1")
    chunks = sizes.select("g", F.ceil(F.col("count") / chunk).cast("long").alias("chunks"))
    met = keyed.join(chunks, "g").withColumn("side", F.pmod(F.xxhash64(unit), F.col("chunks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
    return met.drop("chunks", "other")


def bucket_links(keyed: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between fingerprints of rows (g, fp), unique: those at ``radius`` or fewer
    bits in one bucket g are connected, by a spanning forest of each bucket.

    A bucket over ``chunk`` rows is dealt into chunks by hash; each two chunks meet in a
    group of their own, so no task holds more than about two chunks at once.
    """
    met = _dealt(keyed, chunk, "fp").select("g", "low", "high", "side", "fp")
    met = met.repartition("g", "low", "high").sortWithinPartitions("g", "low", "high", "side", "fp")
    return met.mapInArrow(partial(_links, radius=radius), "a long, b long").distinct()


def reach(similar: float) -> int:
    """Bits within which fingerprints of texts of that Jaccard similarity lie, by five
    standard deviations of their number."""
    share = np.arccos(2 * similar / (1 + similar)) / np.pi
    return int(64 * share + 5 * np.sqrt(64 * share * (1 - share)))


def similar_links(own: DataFrame, similar: float, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between nodes of ``own`` (node, fp, least, sig): those that share a least
    hash, lie within reach and agree in ``similar`` of their signatures are connected, by a
    spanning forest of each bucket."""
    keyed = own.select("node", "fp", F.posexplode("least")).select(F.xxhash64("pos", "col").alias("g"), "node", "fp").distinct()
    sigs = own.groupBy("node").agg(F.first("sig").alias("sig"))
    met = _dealt(keyed, chunk, "node").join(sigs, "node").select("g", "low", "high", "side", "fp", "node", "sig")
    met = met.repartition("g", "low", "high").sortWithinPartitions("g", "low", "high", "side", "fp", "node")
    return met.mapInArrow(partial(_links, radius=reach(similar), similar=similar), "a long, b long").distinct()


def fingerprint_links(classes: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Links between different fingerprints of ``classes`` (fp, unique) that connect all
    pairs at ``radius`` (3 at most) or fewer bits."""
    if not 0 <= radius <= 3:
        raise ValueError("five blocks, two shared, find all pairs up to 3 bits only")
    return bucket_links(classes.select(F.explode(F.array(*_keys())).alias("g"), "fp"), radius, chunk)


def grouped(spark: SparkSession, own: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of the rows of ``own`` (doc_id, fp)."""
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(spark, links)
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(roots, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def near_groups(spark: SparkSession, docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over links. Null, empty and blank texts
    have fingerprint zero and link like others. Rows with a null doc_id link and get a
    component_id, but never give one. Repeated rows are returned as often as they occur; an
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    own = written(spark, fingerprints(docs, width), "fingerprints")
    links = fingerprint_links(own.select("fp").distinct(), radius)
    made = grouped(spark, own, links)
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, similar: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the smallest doc_id stays.

    Two texts are near if their sets of shingles of ``width`` words have that Jaccard
    similarity, by signatures of ``SIGNATURE`` minima (standard error 0.025 at 0.8). Rows that repeat a doc_id are one document: the first by text stays. Rows
    with a null doc_id, and texts without words, are not compared and stay.
    """
    worded = docs.where("doc_id IS NOT NULL AND text RLIKE '\\\\S'")
    own = written(spark, signatures(worded, width), "signatures")
    links = similar_links(own, similar)
    near = grouped(spark, own.select("doc_id", F.col("node").alias("fp")), links)
    fate = near.groupBy("doc_id").agg(F.max(F.expr("doc_id = component_id")).alias("first"), F.count("*").alias("rows"))
    fate = written(spark, fate.where("NOT first OR rows > 1").withColumnRenamed("doc_id", "id"), "fates")
    gone, twice = fate.where("NOT first").select("id"), fate.where("first").select("id")
    # Rows travel as one struct, so that no column of theirs can clash.
    row = F.struct(*docs.columns)
    kept = docs.select(row.alias("row")).join(gone, F.col("row.doc_id") == F.col("id"), "left_anti")
    if not twice.isEmpty():
        again = kept.join(twice, F.col("row.doc_id") == F.col("id"), "left_semi")
        order = F.struct("row.text", F.to_json("row"))
        again = again.groupBy("row.doc_id").agg(F.min_by("row", order).alias("row")).select("row")
        kept = kept.join(twice, F.col("row.doc_id") == F.col("id"), "left_anti").unionByName(again)
    return kept.select("row.*")
