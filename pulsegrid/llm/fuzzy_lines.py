"""Fuzzy line deduplication with DataFrame operations only.

Lines are normalised and hashed; equal ones form a node. Each node has a 63-bit SimHash of
its distinct words. Nodes meet where their SimHashes agree in two of five blocks of bits (pigeonhole
for three differing bits), and link if the edit similarity of their texts is high enough.
Of each connected group the first occurrence stays, all others are removed.

Nodes without a near SimHash in a bucket leave it. The others are held against the first node
of their SimHash, the first of a bucket and the nearest one that follows them in a bucket; a
second pass holds what these links leave unconnected in a bucket against the rest of it. A
group of copies or variants thus costs rows in proportion to its size.

Exact repeats are always found. Near lines are found in part: a pair is compared only if its
SimHashes agree in two of the five blocks and differ in ``NEAR`` bits at most; of these pairs
none is left out. The README gives the recall.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate, combinations
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import components, sent_if_small, written

#: Lines with fewer characters, once normalised, are never removed.
LEAST = 20
SIMILAR = 0.8
#: Beyond so many differing bits of 63 two nodes of a bucket are not verified.
NEAR = 5
#: Neighbours on each side, in the order of a bucket, that a node is held against before it leaves.
SIDE = 8
WIDTHS = (13, 13, 13, 12, 12)
#: Bits of a counter, of which seven fit into a long; of the SimHash; words to a segment.
LANE = 9
BITS = 63
ONES = sum(1 << LANE * j for j in range(BITS // LANE))
SEGMENT = (1 << LANE - 1) - 1
#: Characters that stand for the words of a pair of texts.
SIGNS = "".join(map(chr, range(0x100, 0x800)))
#: More differing words than these are left to the exact distance.
WORD_STEPS = 64


def normalised(line: Column) -> Column:
    """Lower case, with one space for every run of ASCII characters that are no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _majority(counts: list[Column], words: Column) -> Column:
    """The SimHash from packed counters: counter j of long k counts bit j * LANE + k.

    A counter reaches the majority where adding what the majority lacks of its lane's high
    bit sets that bit; counts stay below that bit, and the sign bit is never used, so
    nothing overflows.
    """
    lacking = F.lit((1 << LANE - 1) - 1).cast("long") - F.shiftright(words, 1)
    whole = F.lit(0).cast("long")
    for k, count in enumerate(counts):
        bits = F.shiftrightunsigned((count + lacking * F.lit(ONES)).bitwiseAND(F.lit(ONES << LANE - 1)), LANE - 1)
        whole = whole.bitwiseOR(F.shiftleft(bits, k))
    return whole


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, pos, norm of every line that takes part."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    return rows.select("doc_id", "pos", normalised(F.col("line")).alias("norm")).where(F.length("norm") >= least)


def simhashes(lines: DataFrame) -> DataFrame:
    """doc_id, pos, node, sig of the rows (doc_id, pos, norm): node is the hash of norm, sig
    has the bits that are set in over half of the hashes of its distinct words. Counting a
    word once keeps long lines of one language, which repeat the same few words, apart.

    Words are added up by hash aggregation, seven counters to a long; a line is cut into
    segments of as many words as a counter holds, and only lines of more than one segment
    have their counters unpacked and added up again.
    """
    line = ["u", "doc_id", "pos", "node"]
    rows = lines.select(F.monotonically_increasing_id().alias("u"), "doc_id", "pos", F.xxhash64("norm").alias("node"), "norm")
    rows = rows.select(*line, F.posexplode(F.array_distinct(F.split("norm", " "))).alias("i", "word"))
    rows = rows.select(*line, F.floor(F.col("i") / SEGMENT).alias("seg"), F.xxhash64("word").alias("h"))
    packed = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(ONES))).alias(f"c{k}") for k in range(LANE)]
    added = rows.groupBy(*line, "seg").agg(F.count(F.lit(1)).cast("int").alias("words"), *packed)
    # The first segment, if it is not full, is the line's only one.
    single = F.col("seg") * SEGMENT + F.col("words") < SEGMENT
    short = added.where(single).select(*line[1:], _majority([F.col(f"c{k}") for k in range(LANE)], F.col("words")).alias("sig"))
    counters = [F.sum(F.shiftrightunsigned(f"c{b % LANE}", b // LANE * LANE).bitwiseAND(F.lit((1 << LANE) - 1))).alias(f"b{b}") for b in range(BITS)]
    long = added.where(~single).groupBy(*line).agg(F.sum("words").alias("words"), *counters)
    bits = F.lit(0).cast("long")
    for b in range(BITS):
        bits = bits.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("words"), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return short.union(long.select(*line[1:], bits.alias("sig")))


def _keys() -> Column:
    shifts = [0, *accumulate(WIDTHS)]
    blocks = [
        F.shiftrightunsigned("sig", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for shift, width in zip(shifts, WIDTHS, strict=False)
    ]
    return F.array(
        *[
            F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(blocks[i], 13) + blocks[j]
            for n, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2))
        ]
    )


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= NEAR


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def buckets(nodes: DataFrame) -> DataFrame:
    """g, sig, head (a node), first and next (sig and node of the bucket's first row and of the
    one that follows) of the nodes (node, sig) that have a near SimHash in bucket g.

    A node leaves a bucket if no other one there is near it. That is known where all others are
    among the ``SIDE`` rows before and behind it; in larger buckets a node stays.
    """
    order = Window.partitionBy("g").orderBy("sig", "node")
    keyed = nodes.select("sig", "node", F.explode(_keys()).alias("g"))
    row = F.struct("sig", "node")
    keyed = keyed.select("g", "sig", F.col("node").alias("head"), F.first(row).over(order).alias("first"), F.lead(row).over(order).alias("next"))
    met = keyed.where("head <> first.node OR next IS NOT NULL")
    order = Window.partitionBy("g").orderBy("sig", "head")
    around = [f("sig", n).over(order) for n in range(1, SIDE + 1) for f in (F.lag, F.lead)]
    beyond = [f("sig", SIDE + 1).over(order).isNotNull() for f in (F.lag, F.lead)]
    near = [F.coalesce(F.bit_count(F.col("sig").bitwiseXOR(other)) <= NEAR, F.lit(False)) for other in around]
    met = met.withColumn("stays", reduce(or_, [*near, *beyond]))
    return met.where("stays").drop("stays")


def _verified(spark: SparkSession, pairs: DataFrame, lines: DataFrame, docs: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) of nodes, a written table, whose texts have the edit similarity. Only the
    first line of each of their nodes is read again from its document."""
    asked = written(spark, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    places = lines.join(sent_if_small(asked), "node").groupBy("node").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    places = written(spark, places.select("node", "at.doc_id", "at.pos"), "places")
    wanted = places.select("doc_id").distinct()
    rows = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.join(sent_if_small(written(spark, wanted, "wanted")), "doc_id", "left_semi")
    rows = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).join(sent_if_small(places), ["doc_id", "pos"])
    own = rows.select("node", normalised(F.col("line")).alias("norm")).where(F.xxhash64("norm") == F.col("node"))
    own = written(spark, own.groupBy("node").agg(F.first("norm").alias("norm")), "line-texts")
    x = own.select(F.col("node").alias("a"), F.col("norm").alias("left"))
    y = own.select(F.col("node").alias("b"), F.col("norm").alias("right"))
    both = pairs.join(x, "a").join(y, "b")
    longest = F.greatest(F.length("left"), F.length("right"))
    most = F.floor((1 - similar) * longest + 1e-9).cast("int")
    apart = F.abs(F.length("left") - F.length("right"))
    both = both.withColumn("most", most).where(apart <= F.col("most"))
    # What both begin or end with does not count, which leaves little of most near copies.
    for _ in range(2):
        both = both.withColumn("same", _shared(F.col("left"), F.col("right")))
        rest = [F.reverse(F.substring(c, F.col("same") + 1, F.length(c))).alias(c) for c in ("left", "right")]
        both = both.select("a", "b", "most", *rest)
    # Texts of as many words differ by no more than their differing words, and no two texts
    # by more than the longer one: what that proves similar needs no exact distance.
    words = [F.split(c, " ") for c in ("left", "right")]
    by_word = F.zip_with(*words, lambda x, y: F.when(x == y, 0).otherwise(F.greatest(F.length(x), F.length(y))))
    by_word = F.when(F.size(words[0]) == F.size(words[1]), F.aggregate(by_word, F.lit(0), lambda acc, n: acc + n))
    both = both.withColumn("bound", F.least(F.greatest(F.length("left"), F.length("right")), by_word))
    both = written(spark, both, "line-differences")
    # Few bytes of pairs may stand for much work, so they are dealt out by number; the
    # aggregate, of one row a group, keeps the distances from being worked out before that.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(tasks, "a", "b").groupBy("a", "b").agg(*[F.first(c).alias(c) for c in ("most", "bound", "left", "right")])
    # The cost grows with the distance that is allowed: most pairs end at a small one.
    bounds = [*(f"least({4**k}, most)" for k in range(1, 7)), "most"]
    exact = F.expr(" OR ".join(f"levenshtein(left, right, {n}) >= 0" for n in bounds))
    alike = (F.col("bound") <= F.col("most")) | (word_bound(F.col("left"), F.col("right")) <= F.col("most")) | exact
    return both.where(alike).select("a", "b")


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), 0)


def word_bound(left: Column, right: Column) -> Column:
    """No less than the edit distance of two texts: the words of either that are replaced, left out
    or put in by an alignment of their words cost no more than as many of the longest words,
    and a space each. Null if the texts have more words than ``SIGNS`` has characters, or
    more of them differ than ``WORD_STEPS``.

    Every word becomes one character, so that far fewer cells are filled than by the texts.
    """
    words = [F.split(text, " ") for text in (left, right)]

    def signs(text: Column, known: Column) -> Column:
        return F.array_join(F.transform(text, lambda word: F.substring(F.lit(SIGNS), F.array_position(known, word).cast("int"), F.lit(1))), "")

    lengths = F.sort_array(F.transform(F.concat(*words), lambda word: F.length(word)), asc=False)

    def cost(steps: Column) -> Column:
        return F.when(steps >= 0, F.aggregate(F.slice(lengths, F.lit(1), steps), steps, lambda total, length: total + length))

    def bound(known: Column) -> Column:
        steps = F.levenshtein(signs(words[0], known), signs(words[1], known), WORD_STEPS)
        return F.when(F.size(known) <= len(SIGNS), _with(steps, cost))

    return _with(F.array_union(*words), bound)


def _shared(a: Column, b: Column) -> Column:
    """How many characters two different texts begin with alike, by halving (2^21 at most)."""
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(21))])

    def longer(known: Column, step: Column) -> Column:
        same = F.substring(a, F.lit(1), known + step) == F.substring(b, F.lit(1), known + step)
        return F.when(same, known + step).otherwise(known)

    return F.aggregate(steps, F.lit(0), longer)


def linked_nodes(spark: SparkSession, nodes: DataFrame, lines: DataFrame, docs: DataFrame, similar: float) -> DataFrame:
    """node, component of the nodes (node, sig) that link to others; ``lines`` has their places."""
    heads = nodes.groupBy("sig").agg(F.min("node").alias("head"), F.count("*").alias("nodes"))
    # Nodes of one SimHash against the first of them.
    shared = written(spark, heads.where("nodes > 1").select("sig", "head"), "simhashes")
    within = nodes.join(sent_if_small(shared), "sig").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    met = written(spark, buckets(nodes), "buckets")
    # A node has a first row in each of its buckets; the least of those that are near will do
    # here. Of the rows that follow it, the nearest will.
    apart = F.bit_count(F.col("sig").bitwiseXOR(F.col("next.sig")))
    star = met.where((F.col("head") != F.col("first.node")) & _near("sig", "first.sig")).groupBy(F.col("head").alias("a")).agg(F.min("first").alias("to"))
    chain = met.where(apart <= NEAR).groupBy(F.col("head").alias("a")).agg(F.min(F.struct(apart, "next.node")).alias("to"))
    tried = within.union(star.select("a", "to.node")).union(chain.select("a", "to.node"))
    tried = written(spark, _pairs(tried), "tried")
    first = written(spark, _verified(spark, tried, lines, docs, similar), "links")
    known = written(spark, components(spark, first), "line-groups")
    # What is still apart within a bucket, against the bucket's other components.
    placed = met.join(sent_if_small(known.withColumnRenamed("node", "head")), "head", "left")
    placed = placed.select("g", "sig", "head", F.coalesce("component", "head").alias("part"))
    sizes = placed.groupBy("g", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("g").agg(F.max_by("part", "n").alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = placed.join(main.select("g", "main"), "g")
    others = mixed.where("part <> main").select("g", F.col("sig").alias("sig2"), F.col("head").alias("head2"), F.col("part").alias("part2"))
    cross = mixed.join(others, "g").where((F.col("part") != F.col("part2")) & _near("sig", "sig2"))
    cross = _pairs(cross.select(F.col("head").alias("a"), F.col("head2").alias("b")))
    cross = written(spark, cross.join(tried, ["a", "b"], "left_anti"), "line-pairs")
    second = written(spark, _verified(spark, cross, lines, docs, similar), "links")
    if second.isEmpty():
        return known
    return components(spark, known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second))


def repeats(spark: SparkSession, docs: DataFrame, similar: float = SIMILAR, least: int = LEAST) -> DataFrame:
    """doc_id, removed (sorted positions of lines, from 0) of documents with repeated lines.

    A line is repeated if an occurrence of its group comes earlier, by doc_id and position.
    """
    lines = written(spark, simhashes(occurrences(docs, least)), "lines")
    nodes = lines.groupBy("node").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    nodes = written(spark, nodes, "nodes")
    linked = written(spark, linked_nodes(spark, nodes, lines, docs, similar), "line-groups")
    grouped = nodes.join(sent_if_small(linked), "node", "left").where("n > 1 OR component IS NOT NULL")
    grouped = written(spark, grouped.select("node", F.coalesce("component", "node").alias("part")), "repeated-nodes")
    spots = lines.select("doc_id", "pos", "node").join(sent_if_small(grouped), "node").select("part", "doc_id", "pos")
    spots = written(spark, spots, "spots")
    first = spots.groupBy("part").agg(F.min("doc_id").alias("doc"))
    first = spots.join(first, "part").where("doc_id = doc").groupBy("part", "doc").agg(F.min("pos").alias("at"))
    first = written(spark, first, "kept-lines")
    late = spots.join(sent_if_small(first), "part").where("doc_id <> doc OR pos <> at")
    return late.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def cleaned(spark: SparkSession, docs: DataFrame, similar: float = SIMILAR, least: int = LEAST) -> DataFrame:
    """row (a row of ``docs``), n_lines, removed (positions of lines), text (what stays).

    Null texts stay null and have no lines; rows with a null doc_id stay as they are and
    take no part; rows that repeat a doc_id are treated alike: a line of theirs is removed
    where it repeats an earlier line of any row. Ties do not occur: an occurrence is a
    doc_id and a position. Empty tables pass.
    """
    found = repeats(spark, docs, similar, least).withColumnRenamed("doc_id", "id")
    found = written(spark, found, "repeats")
    # Rows travel as one struct, so that no column of theirs can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.join(sent_if_small(found), F.col("row.doc_id") == F.col("id"), "left")
    rows = rows.withColumn("parts", F.split(F.col("row.text").cast("string"), "\n"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("removed"))
    text = F.array_join(F.transform(rest, lambda i: F.get(F.col("parts"), i)), "\n")
    return rows.select(
        "row",
        F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.when(F.col("removed").isNull() | F.col("parts").isNull(), F.col("row.text")).otherwise(text).alias("text"),
    )


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines removed from text, and n_chars, where there is such a
    column, counted anew. A document of which every line is repeated goes."""
    made = cleaned(spark, docs).where(r"size(removed) = 0 OR text RLIKE '\\S'")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return made.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
