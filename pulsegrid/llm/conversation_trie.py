"""The trie of conversation prefixes, with count-min screening.

A prefix is known by a 128-bit digest: the exclusive or of hashes of its turns with their
positions, which runs along a conversation and over the borders of its stretches. Every task
counts the digests of its rows in a count-min sketch of two rows; the sketches add up. An
estimate never falls short, so an estimate of one proves that a single conversation has the
prefix: its node is written out from its row alone. Only prefixes that may be shared are
shuffled and grouped exactly.

Sums over subtrees need no walk over levels: a node's leaves are the members that stand for
the leaf they end in, and what its subtree saves is, over its members, the length of all
later turns in whose node another member stands first. Both are sums along conversations and
then over the members of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import written
from pulsegrid.session import plain_unions

#: Counters of a row of the sketch for each prefix, and at most: 8 MB a row once packed.
SPARE = 4
WIDEST = 1 << 26
LEAST = 1 << 12
#: Counters of a sketch that travel together.
BLOCK = 1 << 16
#: Turns of a conversation in one window.
STRETCH = 512
#: Nodes that are sent to every executor because many rows ask for them, at most.
SENT = 20_000
#: Turns that a conversation may take from the first one of its hundred.
OPENING = 5
EMPTY = hashlib.sha256(b"").hexdigest()
_PREFIXES = "conv_id long, depth long, total long, size long, d1 long, d2 long, p1 long, p2 long"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, t1, t2 (hashes of role and text), size (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), text, role).alias("t2"),
        F.length(text).cast("long").alias("size"),
    )


def numbered(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``turns`` with part and pos (from 0, in the order of turn, null first, role
    and hashes), and runs: conv_id, part, n (turns in that part), before (turns in earlier ones).

    The table is sorted by ranges, so that a long conversation lies in many parts, each of
    which is numbered by itself.
    """
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("t1"), F.asc("t2")]
    ranged = turns.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    ranged = ranged.repartitionByRange("conv_id", *order, "spread").drop("spread")
    ranged = written(spark, ranged.withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    rows = ranged.select("conv_id", "part", "t1", "t2", "size", (F.row_number().over(inside) - 1).cast("long").alias("at"))
    counts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def own_turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, total, depth, t1, t2, size of every turn of every conversation; depth from 1."""
    rows, runs = numbered(spark, turn_rows(conversations))
    totals = runs.groupBy("conv_id").agg(F.sum("n").alias("total"))
    runs = runs.join(totals, "conv_id").drop("n")
    return rows.join(runs, ["conv_id", "part"]).select("conv_id", "total", (F.col("before") + F.col("at") + 1).alias("depth"), "t1", "t2", "size")


def opened_turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Like ``own_turns`` for conversations that open with the first crc32(conv_id) % 6 turns of
    the first one of their hundred, in place of as many of their own. One without turns has a
    row of depth 0."""
    rows, runs = numbered(spark, turn_rows(conversations))
    runs = written(spark, runs, "runs")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (OPENING + 1)
    known = runs.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    bases = known.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    known = known.join(bases, "base", "left").withColumn("opening", F.least("taken", F.coalesce("there", F.lit(0))))
    known = known.withColumn("total", F.col("opening") + F.greatest(F.col("n") - F.col("taken"), F.lit(0)))
    known = written(spark, known.drop("there", "n"), "conversations")
    placed = rows.join(runs.drop("n"), ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("at"))
    heads = placed.where(F.col("pos") < OPENING).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "size")
    heads = known.join(heads, "base").where("pos < opening").select("conv_id", "total", (F.col("pos") + 1).alias("depth"), "t1", "t2", "size")
    # By run and not by conversation, so that a long one stays spread.
    spread = runs.drop("n").join(known, "conv_id")
    rest = rows.join(spread, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("at")).where("pos >= taken")
    rest = rest.select("conv_id", "total", (F.col("opening") + F.col("pos") - F.col("taken") + 1).alias("depth"), "t1", "t2", "size")
    none = known.where("total = 0").select("conv_id", "total", *[F.lit(0).cast("long").alias(c) for c in ("depth", "t1", "t2", "size")])
    return heads.unionByName(rest).unionByName(none)


def prefixes(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row for each prefix of each conversation, the empty one included: its digest (d1,
    d2), that of its parent (p1, p2) and the size of its last turn."""
    zero = F.lit(0).cast("long")
    roots = turns.where("depth <= 1").select("conv_id", "total", *[zero.alias(c) for c in ("depth", "size", "x1", "x2")])
    rows = turns.where("depth > 0").select("conv_id", "total", "depth", "size", F.xxhash64("depth", "t1", "t2").alias("x1"), F.xxhash64("t2", "depth", "t1").alias("x2"))
    rows = roots.unionByName(rows).withColumn("cell", F.floor(F.col("depth") / STRETCH))
    inside = Window.partitionBy("conv_id", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("conv_id", "cell").agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"))
    cells = cells.select("conv_id", "cell", *[F.coalesce(F.bit_xor(c).over(before), zero).alias(c) for c in ("c1", "c2")])
    rows = rows.select("*", F.bit_xor("x1").over(inside).alias("r1"), F.bit_xor("x2").over(inside).alias("r2")).join(cells, ["conv_id", "cell"])
    d1, d2 = (F.col(f"r{n}").bitwiseXOR(F.col(f"c{n}")) for n in (1, 2))
    return rows.select("conv_id", "depth", "total", "size", d1.alias("d1"), d2.alias("d2"), d1.bitwiseXOR(F.col("x1")).alias("p1"), d2.bitwiseXOR(F.col("x2")).alias("p2"))


def _counters(batch: pa.RecordBatch, columns: tuple[str, str], width: int) -> list[np.ndarray]:
    return [batch.column(c).to_numpy().view(np.uint64) & np.uint64(width - 1) for c in columns]


def _counted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The count-min sketch of a task's digests, where counters stop at 2."""
    sketch = np.zeros((2, width), np.uint8)
    for batch in batches:
        for row, at in zip(sketch, _counters(batch, ("d1", "d2"), width), strict=True):
            seen, n = np.unique(at, return_counts=True)
            row[seen] = np.minimum(2, row[seen] + np.minimum(n, 2))
    blocks = sketch.reshape(-1, min(width, BLOCK))
    for at in np.flatnonzero(blocks.any(axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([blocks[at].tobytes()], pa.binary())], names=["at", "part"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit for each counter of a block: whether the sketches of all tasks, which arrive
    block by block, make it 2 or more."""
    at = held = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(held >= 2, bitorder="little").tobytes()], pa.binary())], names=["at", "part"])

    for batch in batches:
        for own, part in zip(batch.column("at").to_pylist(), batch.column("part"), strict=True):
            more = np.frombuffer(part.as_py(), np.uint8)
            if own == at:
                held = np.minimum(2, held + more)
                continue
            if at is not None:
                yield out()
            at, held = own, more
    if at is not None:
        yield out()


def sketch_bits(rows: DataFrame, width: int) -> np.ndarray:
    """Two rows of packed bits: which counters of the sketch of all digests are 2 or more."""
    kinds = "at int, part binary"
    made = rows.select("d1", "d2").mapInArrow(partial(_counted, width=width), kinds)
    made = made.repartition("at").sortWithinPartitions("at").mapInArrow(_merged, kinds)
    block = min(width, BLOCK) // 8
    bits = np.zeros((2 * width // 8 // block, block), np.uint8)
    for row in made.toArrow().to_pylist():
        bits[row["at"]] = np.frombuffer(row["part"], np.uint8)
    return bits.reshape(2, -1)


def _screened(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    bits = sent.value
    width = bits.shape[1] * 8
    for batch in batches:
        found = []
        for columns in (("d1", "d2"), ("p1", "p2")):
            hit = [row[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 for row, at in zip(bits, _counters(batch, columns, width), strict=True)]
            found.append(pa.array((hit[0] & hit[1]).astype(bool)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "shared", "parent_shared"])


def _with_nodes(rows: DataFrame, nodes: DataFrame, on: list[str], weight: Column, all_rows: int) -> DataFrame:
    """``rows`` with their node, an inner join. Nodes that many rows ask for, as ``weight``
    counts them, are sent to every executor: at most ``SENT``, since their rows add up to
    ``all_rows``. So no task gets the rows of a hot node."""
    bound = max(2, -(-all_rows // SENT))
    hot, rest = nodes.where(weight >= bound), nodes.where(weight < bound)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, from chunks that arrive in order; holds one chunk."""
    key = digest = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], names=["d1", "d2", "ends_sha256"])

    for batch in batches:
        for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "ids")), strict=True):
            if key == (d1, d2):
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                yield out()
            key, digest = (d1, d2), hashlib.sha256(ids.encode())
    if key is not None:
        yield out()


def end_digests(shared: DataFrame) -> DataFrame:
    """d1, d2, ends_sha256 of the nodes in which conversations end. Ids are put together by
    4,096 neighbouring numbers; only these strings meet, and flow through the hash."""
    ends = shared.where("depth = total").select("d1", "d2", "conv_id", F.shiftright("conv_id", 12).alias("chunk"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = ends.groupBy("d1", "d2", "chunk").agg(ids.alias("ids"))
    chunks = chunks.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "chunk")
    return chunks.mapInArrow(_digested, "d1 long, d2 long, ends_sha256 string")


def _subtree_sums(spark: SparkSession, shared: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """d1, d2, n_leaves, saved_tokens of the nodes of ``shared`` rows."""
    heads = nodes.select("d1", "d2", "top", "n_convs", "ends")
    rows = _with_nodes(shared.select("conv_id", "depth", "total", "size", "d1", "d2"), heads, ["d1", "d2"], F.col("n_convs"), total)
    stands = F.col("conv_id") == F.col("top")
    # A member that ends here without standing for a leaf: others end here first, or go on.
    idle = (F.col("depth") == F.col("total")) & ~(stands & (F.col("ends") == F.col("n_convs")))
    rows = rows.select("conv_id", "depth", "d1", "d2", F.when(stands, 0).otherwise(F.col("size")).alias("other"), idle.cast("int").alias("idle"))
    rows = written(spark, rows.withColumn("cell", F.floor(F.col("depth") / STRETCH)), "members")
    inside = Window.partitionBy("conv_id", "cell").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("conv_id", "cell").agg(F.sum("other").alias("own"), F.max("idle").alias("idle"))
    cells = cells.select("conv_id", "cell", F.coalesce(F.sum("own").over(later), F.lit(0)).alias("after"), F.max("idle").over(Window.partitionBy("conv_id")).alias("never"))
    rows = rows.select("conv_id", "cell", "d1", "d2", F.sum("other").over(inside).alias("here")).join(cells, ["conv_id", "cell"])
    return rows.groupBy("d1", "d2").agg(F.sum(1 - F.col("never")).alias("n_leaves"), F.sum(F.col("here") + F.col("after")).alias("saved_tokens"))


def trie_nodes(spark: SparkSession, turns: DataFrame, widest: int = WIDEST) -> DataFrame:
    """One row for each distinct prefix of the conversations in ``turns`` (conv_id, total, depth
    from 1, t1, t2, size; depth 0 for one without turns), the empty prefix included.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, all as counted over the whole table. ``widest`` bounds
    the sketch: beyond about as many prefixes fewer are proven single and more are grouped
    exactly, with the same result. Without conversations there are no nodes, so no root.
    """
    plain_unions(spark)
    rows = written(spark, prefixes(spark, turns), "prefixes")
    width = LEAST
    while width < min(widest, SPARE * rows.count()):
        width *= 2
    sent = spark.sparkContext.broadcast(sketch_bits(rows, width))
    rows = rows.mapInArrow(partial(_screened, sent=sent), _PREFIXES + ", shared boolean, parent_shared boolean")
    single = rows.where("NOT shared")
    shared = written(spark, rows.where("shared"), "shared-prefixes")
    total = shared.count()
    nodes = shared.groupBy("d1", "d2").agg(
        *[F.min(c).alias(c) for c in ("depth", "p1", "p2")],
        F.min("conv_id").alias("top"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if(F.col("depth") == F.col("total")).alias("ends"),
        F.max("parent_shared").alias("parent_shared"),
    )
    nodes = written(spark, nodes, "nodes")
    below = "depth > 0 AND parent_shared"
    children = nodes.where(below).select("p1", "p2").unionByName(single.where(below).select("p1", "p2"))
    children = children.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.join(_subtree_sums(spark, shared, nodes, total), ["d1", "d2"]).join(end_digests(shared), ["d1", "d2"], "left")
    nodes = written(spark, nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "nodes")
    one = F.lit(1).cast("long")
    lone = single.select(
        "depth", "p1", "p2", F.col("conv_id").alias("top"), one.alias("n_convs"), "parent_shared",
        F.when(F.col("depth") < F.col("total"), 1).otherwise(0).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("total"), F.sha2(F.col("top").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    both = nodes.select(*lone.columns).unionByName(lone)
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("top").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    asking = nodes.agg(F.sum("n_children")).first()[0] or 0
    inner = _with_nodes(both.where(below), parents, ["p1", "p2"], F.col("weight"), asking).drop("weight")
    # The parent of a prefix that is not shared has no other member.
    alone = both.where(f"NOT ({below})").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("top")))
    found = inner.unionByName(alone)
    return found.select(F.col("top").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(spark: SparkSession, conversations: DataFrame, opened: bool = False) -> DataFrame:
    """``trie_nodes`` of conversations (conv_id, turn, role, text), as they are or, if ``opened``,
    as ``opened_turns`` rebuilds them.

    Turns stand in the order of turn, null first; of equal ones by role and then by a hash of
    the text, and repeated rows are turns of their own. Null roles and texts are empty ones;
    rows with a null conv_id take no part. Other columns are not read. An empty table gives no
    rows.
    """
    return trie_nodes(spark, (opened_turns if opened else own_turns)(spark, conversations))
