"""Joins on a time tolerance, written as sweeps and not as pair enumeration.

Every operator here costs one shuffle of its inputs on (keys, cell) and emits at most
one row per input row; no operator builds the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import is_finite, ratio
from pulsegrid.operators.scan import ordered_scan, time_cell
from pulsegrid.session import plain_unions

# Events of a chunk, and chunks of a super-chunk for each of them: a fold's work grows with the square.
FOLD_CHUNK = 32
SUPER = 16


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tolerance: int | float,
    *,
    time: str = "t",
    cell_width: int | float | None = None,
    out: str = "match_t",
) -> DataFrame:
    """Nearest right time within the tolerance for every left row; ties go to the earlier one.

    Right times are reduced to distinct values first, so copies cost nothing. Each cell
    also receives the last time of the cell before and the first one of the cell after
    it: with cells at least one tolerance wide nothing further away can match.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    plain_unions(left.sparkSession)
    keys = list(keys)
    width = max(cell_width or 0, tolerance * 8, 1 if isinstance(tolerance, int) else 1e-6)
    cell = time_cell(F.col(time), width)
    candidates = right.select(*keys, time).dropna().distinct().withColumn("_cell", cell)
    edges = candidates.groupBy(*keys, "_cell").agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    borders = edges.select(
        *keys,
        F.inline(
            F.array(
                F.struct((F.col("_cell") + 1).alias("_cell"), F.col("_hi").alias(time)),
                F.struct((F.col("_cell") - 1).alias("_cell"), F.col("_lo").alias(time)),
            )
        ),
    )
    probes = candidates.unionByName(borders).withColumn("_r", F.col(time)).withColumn("_side", F.lit(0))
    rows = left.withColumn("_cell", cell).withColumn("_side", F.lit(1))
    both = rows.unionByName(probes, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "_cell")
    back = part.orderBy(F.col(time), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = part.orderBy(F.col(time).desc(), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(
        "*",
        F.last("_r", ignorenulls=True).over(back).alias("_before"),
        F.last("_r", ignorenulls=True).over(ahead).alias("_after"),
    ).filter(F.col("_side") == 1)
    d_before = F.col(time) - F.col("_before")
    d_after = F.col("_after") - F.col(time)
    best = (
        F.when(d_before.isNull(), F.col("_after"))
        .when(d_after.isNull(), F.col("_before"))
        .when(d_before <= d_after, F.col("_before"))
        .otherwise(F.col("_after"))
    )
    distance = F.abs(F.col(time) - best)
    return found.select(*left.columns, F.when(distance <= F.lit(tolerance), best).alias(out))


def exists_within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    tolerance: int | float,
    *,
    time: str = "t",
    cell_width: int | float | None = None,
    out: str = "near",
) -> DataFrame:
    """Flag left rows that have any right time within the tolerance; right rows are reusable."""
    matched = nearest_within(left, right, keys, tolerance, time=time, cell_width=cell_width, out="_m")
    return matched.withColumn(out, F.col("_m").isNotNull()).drop("_m")


def match_one_to_one(
    references: DataFrame,
    estimates: DataFrame,
    keys: Sequence[str],
    tolerance: int | float,
    *,
    time: str = "t",
    cell_width: int | float | None = None,
    chunk_rows: int = FOLD_CHUNK,
) -> DataFrame:
    """Ordered one-to-one matching within a tolerance, earliest pair first.

    Returns one row per event: keys, side ('ref'/'est'), time, ordinal and partner_t
    (null when unmatched).

    In time order the open events always belong to one side, and they are the latest
    ones of it.  One signed number therefore holds the state: +k when the last k
    references wait, -k when the last k estimates wait.  An event first clamps the state
    to what is still within tolerance and then shifts it by one, and such clamp-and-shift
    steps compose to one step of the same form.  So bounded chunks are folded on their
    own, the composed steps are scanned chunk by chunk, and every chunk is replayed from
    its true start; a track of any density is spread over many tasks.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    keys = list(keys)
    width = max(cell_width or 0, tolerance * 64, 1 if isinstance(tolerance, int) else 1e-6)
    cell = time_cell(F.col("_at"), width)

    def marked(df: DataFrame, side: int) -> DataFrame:
        times = df.select(*keys, F.col(time).alias("_t")).filter(F.col("_t") >= 0)
        return times.filter(is_finite(F.col("_t").cast("double"))).withColumn("_side", F.lit(side))

    events = marked(references, 1).unionByName(marked(estimates, -1))
    # Copies of one (side, time) get a number, so that the order is total.
    copies = Window.partitionBy(*keys, "_side", "_t").orderBy(F.lit(0))
    events = events.withColumn("_copy", F.row_number().over(copies))
    # Arrivals come first at equal times: a distance of exactly the tolerance still matches.
    timeline = events.select(
        *keys,
        "_side",
        "_copy",
        F.inline(
            F.array(
                F.struct(F.col("_t").alias("_at"), F.lit(0).alias("_gone")),
                F.struct((F.col("_t") + F.lit(tolerance)).alias("_at"), F.lit(1).alias("_gone")),
            )
        ),
    )
    order = ["_at", "_gone", "_side", "_copy"]
    is_ref, is_est = F.col("_side") == 1, F.col("_side") == -1
    arrives, leaves = F.col("_gone") == 0, F.col("_gone") == 1
    one = F.lit(1).cast("long")
    counted = ordered_scan(
        timeline,
        keys,
        order,
        cell,
        cumsum={
            "_refs": F.when(is_ref & arrives, one).otherwise(0),
            "_ests": F.when(is_est & arrives, one).otherwise(0),
            "_refs_gone": F.when(is_ref & leaves, one).otherwise(0),
            "_ests_gone": F.when(is_est & leaves, one).otherwise(0),
        },
    ).filter(arrives)
    # Open events before this one: arrived earlier and not yet gone.
    steps = counted.withColumn(
        "_high", F.col("_refs") - F.col("_refs_gone") - F.when(is_ref, 1).otherwise(0)
    ).withColumn("_low", -(F.col("_ests") - F.col("_ests_gone") - F.when(is_est, 1).otherwise(0)))
    seq = F.col("_refs") + F.col("_ests")
    steps = steps.withColumn("_seq", seq).withColumn("_chunk", F.floor((seq - 1) / F.lit(chunk_rows)))

    # Keys that are null meet nothing in the joins below. Said here, both uses of the chunks
    # have one plan up to their shuffle, which is then done once.
    for n in [*keys, "_chunk"]:
        steps = steps.filter(F.col(n).isNotNull())
    step = F.struct("_seq", "_low", "_high", "_side", F.col("_at").alias("_at"), "_refs", "_ests")
    chunks = steps.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    far = 1 << 60
    identity = F.struct(
        F.lit(0).cast("long").alias("a"), F.lit(-far).cast("long").alias("lo"), F.lit(far).cast("long").alias("hi")
    )

    def clamped(f: Column, low: Column, high: Column) -> Column:
        """f followed by a clamp to [low, high]; f is x -> clamp(x + a, lo, hi)."""
        return F.struct(
            f["a"].alias("a"),
            F.least(high, F.greatest(low, f["lo"])).alias("lo"),
            F.least(high, F.greatest(low, f["hi"])).alias("hi"),
        )

    def shifted(f: Column, by: Column) -> Column:
        return F.struct((f["a"] + by).alias("a"), (f["lo"] + by).alias("lo"), (f["hi"] + by).alias("hi"))

    prefix_type = "array<struct<a:bigint,lo:bigint,hi:bigint>>"
    nothing = F.struct(identity.alias("f"), F.array().cast(prefix_type).alias("seen"))

    def walk(acc: Column, s: Column) -> Column:
        # "seen" keeps the composed step up to each event, so a chunk is folded only once.
        open_now = clamped(acc["f"], s["_low"], s["_high"])
        return F.struct(
            shifted(open_now, s["_side"].cast("long")).alias("f"),
            F.concat(acc["seen"], F.array(open_now)).alias("seen"),
        )

    folded = chunks.withColumn("_fold", F.aggregate("_steps", nothing, walk))
    super_chunk = F.floor(F.col("_chunk") / (SUPER * chunk_rows))

    def then(f: Column, g: Column) -> Column:
        """f followed by g."""
        return F.struct(
            (f["a"] + g["a"]).alias("a"),
            F.least(g["hi"], F.greatest(g["lo"], f["lo"] + g["a"])).alias("lo"),
            F.least(g["hi"], F.greatest(g["lo"], f["hi"] + g["a"])).alias("hi"),
        )

    def starts(entries: Column) -> Column:
        """Composed step before each entry, in order, and the composition of all."""
        zero = F.struct(identity.alias("f"), F.array().cast(prefix_type).alias("seen"))

        def add(acc: Column, e: Column) -> Column:
            return F.struct(
                then(acc["f"], e["f"]).alias("f"), F.concat(acc["seen"], F.array(acc["f"])).alias("seen")
            )

        return F.aggregate(entries, zero, add)

    # Chunks of a super-chunk, then super-chunks of a key: both lists stay short.
    groups = (
        folded.select(*keys, super_chunk.alias("_super"), F.struct("_chunk", F.col("_fold.f").alias("f")).alias("_e"))
        .groupBy(*keys, "_super")
        .agg(F.array_sort(F.collect_list("_e")).alias("_entries"))
        .withColumn("_starts", starts(F.col("_entries")))
    )
    ordered = Window.partitionBy(*keys).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    base = F.aggregate(F.collect_list("_starts.f").over(ordered), identity, then)
    chunk_starts = (
        groups.select(*keys, "_entries", "_starts", base.alias("_base"))
        .select(
            *keys,
            "_base",
            F.explode(F.arrays_zip(F.col("_entries").alias("e"), F.col("_starts.seen").alias("s"))).alias("z"),
        )
        .select(*keys, F.col("z.e._chunk").alias("_chunk"), then(F.col("_base"), F.col("z.s")).alias("_start"))
    )
    # Everything starts with nothing open: the state is the composed step applied to 0.
    zero_state = F.least(F.col("_start.hi"), F.greatest(F.col("_start.lo"), F.col("_start.a")))
    replayed = (
        folded.join(chunk_starts.select(*keys, "_chunk", zero_state.alias("_x")), [*keys, "_chunk"])
        .select(
            *keys,
            "_x",
            F.explode(F.arrays_zip(F.col("_steps").alias("s"), F.col("_fold.seen").alias("p"))).alias("z"),
        )
        .select(
            *keys,
            F.col("z.s._side").alias("side"),
            F.col("z.s._at").alias("at"),
            F.col("z.s._refs").alias("refs"),
            F.col("z.s._ests").alias("ests"),
            F.least(F.col("z.p.hi"), F.greatest(F.col("z.p.lo"), F.col("_x") + F.col("z.p.a"))).alias("state"),
        )
    )
    # The event that closes a pair knows the ordinal of its partner: one aggregation
    # brings its time to the partner, a second one brings the partner's time back.
    est_closes = (F.col("side") == -1) & (F.col("state") > 0)
    ref_closes = (F.col("side") == 1) & (F.col("state") < 0)
    own = F.when(F.col("side") == 1, F.col("refs")).otherwise(F.col("ests"))
    partner = F.when(est_closes, F.col("refs") - F.col("state") + 1).when(
        ref_closes, F.col("ests") + F.col("state") + 1
    )
    empty_t = F.lit(None).cast(dict(timeline.dtypes)["_at"])
    empty_n = F.lit(None).cast("long")

    def record(side: Column, ordinal: Column, at: Column, other_t: Column, other: Column) -> Column:
        return F.struct(
            side.cast("int").alias("side"),
            ordinal.alias("ordinal"),
            at.alias("_t"),
            other_t.alias("_pt"),
            other.alias("_pn"),
        )

    def gather(df: DataFrame, first: Column, second: Column, wanted: Column) -> DataFrame:
        both = F.when(wanted.isNotNull(), F.array(first, second)).otherwise(F.array(first))
        return df.select(*keys, F.inline(both)).groupBy(*keys, "side", "ordinal").agg(
            F.max("_t").alias("_t"), F.max("_pt").alias("_pt"), F.max("_pn").alias("_pn")
        )

    side, at = F.col("side"), F.col("at")
    opened = gather(
        replayed,
        record(side, own, at, empty_t, empty_n),
        record(-side, partner, empty_t, at, own),
        partner,
    )
    closed = gather(
        opened,
        record(side, F.col("ordinal"), F.col("_t"), F.col("_pt"), empty_n),
        record(-side, F.col("_pn"), empty_t, F.col("_t"), empty_n),
        F.col("_pn"),
    )
    return closed.select(
        *keys,
        F.when(side == 1, "ref").otherwise("est").alias("side"),
        F.col("_t").alias(time),
        "ordinal",
        F.col("_pt").alias("partner_t"),
    )


def match_metrics(matches: DataFrame, keys: Sequence[str], *, time: str = "t", scale: float = 1.0) -> DataFrame:
    """TP/FP/FN, precision, recall, F1 and absolute errors per key from matched events."""
    is_ref = F.col("side") == "ref"
    hit = is_ref & F.col("partner_t").isNotNull()
    error = F.when(hit, F.abs(F.col(time) - F.col("partner_t")))
    grouped = matches.groupBy(*keys).agg(
        F.sum(F.when(is_ref, 1).otherwise(0)).alias("reference_count"),
        F.sum(F.when(is_ref, 0).otherwise(1)).alias("estimated_count"),
        F.sum(F.when(hit, 1).otherwise(0)).alias("true_positive_count"),
        (F.avg(error) / F.lit(scale)).alias("mean_error"),
        (F.max(error) / F.lit(scale)).alias("max_error"),
    )
    tp, refs, ests = F.col("true_positive_count"), F.col("reference_count"), F.col("estimated_count")
    return grouped.select(
        *keys,
        refs,
        ests,
        tp,
        (ests - tp).alias("false_positive_count"),
        (refs - tp).alias("false_negative_count"),
        ratio(tp, ests).alias("precision"),
        ratio(tp, refs).alias("recall"),
        ratio(2 * tp, refs + ests).alias("f1"),
        "mean_error",
        "max_error",
    )


def count_covering(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    *,
    time: str = "t",
    start: str = "start_t",
    end: str = "end_t",
    margin: int | float = 0,
    closed: bool = False,
    cell_width: int | float,
    out: str = "covering",
) -> DataFrame:
    """How many ranges cover each point: starts so far minus ends so far.

    Half-open ranges leave at ``end``; closed ranges leave just after it. A long range
    costs two rows however many cells it spans.
    """
    keys = list(keys)
    opens = ranges.select(
        *keys, (F.col(start) - F.lit(margin)).alias(time), F.lit(0).alias("_kind"), F.lit(1).alias("_delta")
    )
    ends = ranges.select(
        *keys,
        (F.col(end) + F.lit(margin)).alias(time),
        F.lit(3 if closed else 1).alias("_kind"),
        F.lit(-1).alias("_delta"),
    )
    marks = opens.unionByName(ends).groupBy(*keys, time, "_kind").agg(F.sum("_delta").alias("_delta"))
    probes = points.withColumn("_kind", F.lit(2)).withColumn("_delta", F.lit(0).cast("long"))
    both = probes.unionByName(marks, allowMissingColumns=True).withColumn(
        "_id", F.when(F.col("_kind") == 2, F.monotonically_increasing_id()).otherwise(0)
    )
    swept = ordered_scan(
        both, keys, [time, "_kind", "_id"], time_cell(F.col(time), cell_width), cumsum={out: F.col("_delta")}
    )
    return swept.filter(F.col("_kind") == 2).select(*points.columns, out)


def overlaps_any(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    start: str = "start_t",
    end: str = "end_t",
    cell_width: int | float,
    out: str = "overlaps",
) -> DataFrame:
    """Flag left ranges that share at least one instant with a right range (closed ends).

    A right range misses the left one only by starting after its end or by ending before
    its start, so two running counts decide: starts up to the left end minus ends before
    the left start. Repeated left rows are answered as often as they occur.
    """
    keys = list(keys)
    left_cols = left.columns
    tagged = left.withColumn("_rid", F.struct(*[F.col(c) for c in left_cols]))
    # ends strictly before the left start -> mark kind 1 after probe kind 0 at equal times
    ends = right.groupBy(*keys, F.col(end).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    starts = right.groupBy(*keys, F.col(start).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    start_probe = tagged.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_which"), "_rid")
    end_mark = ends.select(*keys, "_at", F.lit(1).alias("_kind"), "_n", F.lit(1).alias("_which"))
    start_mark = starts.select(*keys, "_at", F.lit(0).alias("_kind"), "_n", F.lit(2).alias("_which"))
    end_probe = tagged.select(*keys, F.col(end).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_n"), F.lit(2).alias("_which"), "_rid")
    marks = end_mark.unionByName(start_mark).withColumn("_id", F.lit(0).cast("long"))
    probes = start_probe.unionByName(end_probe).withColumn("_id", F.monotonically_increasing_id())
    both = probes.unionByName(marks, allowMissingColumns=True)
    swept = ordered_scan(
        both,
        [*keys, "_which"],
        ["_at", "_kind", "_id"],
        time_cell(F.col("_at"), cell_width),
        cumsum={"_seen": F.col("_n")},
    ).filter(F.col("_rid").isNotNull())
    both_counts = swept.groupBy("_rid").agg(
        F.max(F.when(F.col("_which") == 2, F.col("_seen"))).alias("_starts"),
        F.max(F.when(F.col("_which") == 1, F.col("_seen"))).alias("_ends"),
        F.sum(F.when(F.col("_which") == 2, 1).otherwise(0)).cast("int").alias("_copies"),
    )
    whole = both_counts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return whole.select("_rid.*", (F.col("_starts") > F.col("_ends")).alias(out))


def overlap_weighted_mean(
    windows: DataFrame,
    keys: Sequence[str],
    bar_length: int | float,
    value: Column,
    *,
    start: str = "start_t",
    end: str = "end_t",
    out: str = "mean_value",
) -> DataFrame:
    """Mean of a window value per bar, weighted by the shared time.

    Bars are regular, so a window knows the bars it touches: no join is needed and the
    partial sums are combined before the shuffle.
    """
    first = F.floor(F.col(start) / F.lit(bar_length)).cast("long")
    last = (F.ceil(F.col(end) / F.lit(bar_length)) - 1).cast("long")
    spread = windows.filter(F.col(end) > F.col(start)).withColumn("bar", F.explode(F.sequence(first, last)))
    weight = F.least(F.col(end), (F.col("bar") + 1) * F.lit(bar_length)) - F.greatest(
        F.col(start), F.col("bar") * F.lit(bar_length)
    )
    weighed = spread.withColumn("_w", weight.cast("double")).filter(F.col("_w") > 0)
    return weighed.groupBy(*keys, "bar").agg(
        F.sum("_w").alias("overlap"), (F.sum(F.col("_w") * value) / F.sum("_w")).alias(out)
    )


def frame_lookup(
    events: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    frame_of: Column,
    *,
    value: str = "value",
    radius: int = 0,
    out: str = "frame_value",
) -> DataFrame:
    """Largest frame value at the event's frame, optionally with its neighbours.

    The join key holds the frame number, so one hot track is spread over its frames.
    Repeated events are answered as often as they occur.
    """
    keys = list(keys)
    offsets = F.array(*[F.lit(i).cast("long") for i in range(-radius, radius + 1)])
    around = F.transform(offsets, lambda d: frame_of.cast("long") + d)
    probes = events.withColumn("frame", F.explode(around))
    tops = frames.groupBy(*keys, "frame").agg(F.max(value).alias("_value"))
    hits = probes.join(tops, [*keys, "frame"], "left")
    found = hits.groupBy(*events.columns).agg(F.max("_value").alias(out), F.count(F.lit(1)).alias("_probes"))
    copies = F.sequence(F.lit(1), (F.col("_probes") / (2 * radius + 1)).cast("int"))
    return found.withColumn("_copy", F.explode(copies)).select(*events.columns, out)
