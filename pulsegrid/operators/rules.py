"""Rule validation and repairs: each rule gives rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import notes as N
from pulsegrid.functions.numeric import flag_sum, ratio
from pulsegrid.operators.matching import count_covering, nearest_within

MAX_SLOTS = 192


def _issue(condition: Column, code: str, place: Column | None = None) -> Column:
    where = F.lit(None).cast("int") if place is None else place.cast("int")
    return F.when(condition, F.struct(F.lit(code).alias("code"), where.alias("pos")))


def chart_issues(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bar-level findings: size, characters, balloon counts. One row per finding."""
    notes, counts = F.col("notes"), F.col("balloon_counts")
    indexed = F.transform(N.slots(notes), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    balloons = F.transform(F.filter(indexed, lambda x: x["c"] == "7"), lambda x: x["i"])
    bad = F.filter(indexed, lambda x: ~N.in_class(x["c"], N.SUPPORTED_NOTES))
    given, needed = F.size(counts), F.size(balloons)
    none = F.array().cast("array<struct<code:string,pos:int>>")

    def each(items: Column, code: str, place) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(code).alias("code"), place(x).cast("int").alias("pos")))

    nowhere = F.lit(None).cast("int")
    short = F.when(needed > given, F.slice(balloons, given + 1, needed - given)).otherwise(F.array().cast("array<int>"))
    extra = F.when(given > needed, F.sequence(needed, given - 1)).otherwise(F.array().cast("array<int>"))
    found = F.concat(
        F.array_compact(F.array(_issue((F.length(notes) < 1) | (F.length(notes) > MAX_SLOTS), "invalid-note-count"))),
        each(bad, "unsupported-note-character", lambda x: x["i"]),
        each(short, "missing-balloon-count", lambda x: x),
        each(extra, "extra-balloon-count", lambda x: nowhere),
        each(F.filter(counts, lambda c: c <= 0), "invalid-balloon-count", lambda x: nowhere),
        none,
    )
    return bars.select(*keys, "bar", F.inline(found)).orderBy(*keys, "bar", F.asc_nulls_first("pos"), "code")


def event_conflicts(hits: DataFrame, long_notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long notes that overlap the one before, hits inside a long note, two notes on a tick.

    ``keys`` name a bar; a bar holds few long notes, so their order is a plain window.
    """
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("start_tick", "end_tick")
    overlapping = long_notes.withColumn("_end", F.lag("end_tick").over(order)).filter(F.col("start_tick") <= F.col("_end"))
    a = overlapping.select(*keys, F.col("start_tick").alias("tick"), F.lit("overlapping-long-notes").alias("code"))
    distinct_hits = hits.select(*keys, "tick", "note").distinct()
    two = distinct_hits.groupBy(*keys, "tick").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    b = two.select(*keys, "tick", F.lit("conflicting-hit").alias("code"))
    points = hits.select(*keys, "tick").distinct()
    covered = count_covering(
        points, long_notes, keys, time="tick", start="start_tick", end="end_tick", closed=True, cell_width=4096, out="_n"
    )
    c = covered.filter("_n > 0").select(*keys, "tick", F.lit("hit-inside-long-note").alias("code"))
    return a.unionByName(b).unionByName(c)


def encode_events(hits: DataFrame, long_notes: DataFrame, bars: DataFrame, keys: Sequence[str], ticks: int = 48) -> tuple[DataFrame, DataFrame]:
    """(issues, bars) of event bars: rule findings, and note strings of the bars without any.

    ``bars`` give the output ``resolution`` per key; hits have tick and note, long notes
    start_tick, end_tick, kind and balloon_count.
    """
    keys = list(keys)
    step = F.floor(F.lit(ticks) / F.col("resolution")).cast("int")
    grid = bars.select(*keys, "resolution", step.alias("step"))
    fits = (F.col("resolution") > 0) & (F.lit(ticks) % F.col("resolution") == 0)
    bad_grid = grid.filter(~fits).select(*keys, F.lit(None).cast("int").alias("tick"), F.lit("incompatible-resolution").alias("code"))
    usable = grid.filter(fits)

    def inside(tick: Column) -> Column:
        return (tick >= 0) & (tick < ticks)

    h = hits.join(usable, keys).distinct()
    tick = F.col("tick")
    hit_code = (
        F.when(~inside(tick), "tick-out-of-range")
        .when(tick % F.col("step") != 0, "tick-not-representable")
        .when(~N.in_class(F.col("note"), N.NORMAL_NOTES), "unsupported-hit-note")
    )
    judged = h.withColumn("code", hit_code)
    good_hits = judged.filter(F.col("code").isNull()).select(*keys, "tick", "note", "step")
    s, e = F.col("start_tick"), F.col("end_tick")
    ranged = inside(s) & inside(e)
    kind, count = F.col("kind"), F.col("balloon_count")

    def long_issue(condition: Column, code: str) -> Column:
        return F.when(condition, F.lit(code))

    codes = F.array_compact(
        F.array(
            long_issue(~kind.isin("drumroll", "balloon"), "unsupported-long-note-kind"),
            long_issue(~ranged, "tick-out-of-range"),
            long_issue(ranged & ((s % F.col("step") != 0) | (e % F.col("step") != 0)), "tick-not-representable"),
            long_issue(e <= s, "invalid-long-note-range"),
            long_issue((kind == "balloon") & ~F.coalesce(count > 0, F.lit(False)), "invalid-balloon-count"),
            long_issue((kind != "balloon") & count.isNotNull(), "unexpected-balloon-count"),
        )
    )
    longs = long_notes.join(usable, keys).distinct().withColumn("codes", codes)
    good_longs = longs.filter(F.size("codes") == 0).drop("codes")
    issues = (
        bad_grid.unionByName(judged.filter(F.col("code").isNotNull()).select(*keys, "tick", "code"))
        .unionByName(longs.select(*keys, s.alias("tick"), F.explode("codes").alias("code")))
        .unionByName(event_conflicts(good_hits, good_longs, keys))
    )
    clean = usable.join(issues.select(*keys).distinct(), keys, "left_anti")
    placed = good_hits.select(*keys, F.floor(tick / F.col("step")).cast("int").alias("slot"), "note")
    heads = good_longs.select(*keys, F.floor(s / F.col("step")).cast("int").alias("slot"), F.when(kind == "balloon", "7").otherwise("5").alias("note"))
    tails = good_longs.select(*keys, F.floor(e / F.col("step")).cast("int").alias("slot"), F.lit("8").alias("note"))
    # Only clean bars are rendered: in others a slot could hold two notes.
    slots = clean.join(
        placed.unionByName(heads).unionByName(tails).join(clean.select(*keys), keys, "left_semi").groupBy(*keys).agg(
            F.map_from_entries(F.collect_set(F.struct("slot", "note"))).alias("_m")
        ),
        keys,
        "left",
    )
    text = F.array_join(
        F.transform(F.sequence(F.lit(0), F.col("resolution") - 1), lambda i: F.coalesce(F.element_at("_m", i), F.lit("0"))), ""
    )
    return issues, slots.select(*keys, text.alias("notes"))


def sustain_issues(long_notes: DataFrame, spans: DataFrame, keys: Sequence[str], tick_s: float, minimum_s: float) -> DataFrame:
    """Long notes of a bar: more than one, no reliable burst, outside it, or too short."""
    keys = list(keys)
    counted = long_notes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = long_notes.join(spans.select(*keys, "span_start", "span_end"), keys, "left")
    burst = F.col("span_start").isNotNull()
    many = counted.filter("_n > 1").select(*keys, F.lit("too-many-long-notes").alias("code"))
    missing = rows.filter(~burst).select(*keys).distinct().select(*keys, F.lit("no-reliable-burst").alias("code"))
    outside = (F.col("start_tick") < F.col("span_start")) | (F.col("end_tick") > F.col("span_end"))
    a = rows.filter(burst & outside).select(*keys, F.lit("outside-burst").alias("code"))
    short = (F.col("end_tick") - F.col("start_tick")) * tick_s < minimum_s
    b = rows.filter(burst & short).select(*keys, F.lit("too-short").alias("code"))
    every = many.unionByName(missing).unionByName(a).unionByName(b)
    return every.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("issue_count"))


def issue_groups(messages: DataFrame, order: Sequence[str], message: str = "message", samples: int = 3) -> DataFrame:
    """Messages that differ only in an index: template, count and first samples, for every template.

    The samples are cut per template before they meet, so a frequent template never
    gathers its messages.
    """
    rows = messages.withColumn("template", F.regexp_replace(message, r"\[\d+\]", "[*]"))
    sums = rows.groupBy("template").agg(F.count(F.lit(1)).alias("occurrences"))
    numbered = rows.withColumn(
        "_n", F.row_number().over(Window.partitionBy("template").orderBy(*order, message))
    ).filter(F.col("_n") <= samples)
    shown = numbered.groupBy("template").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", message))), lambda x: x[message]), "; ").alias("examples")
    )
    return sums.join(shown, "template").select("template", "occurrences", "examples")


def apply_repairs(bars: DataFrame, violations: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Big notes at violations become normal ones; bars of edge silence are cleared."""
    keys = list(keys)
    places = violations.groupBy(*keys, "bar").agg(F.collect_set("pos").alias("_at"))
    rows = bars.join(places, [*keys, "bar"], "left").join(
        edges.select(*keys, "bar").distinct().withColumn("_edge", F.lit(True)), [*keys, "bar"], "left"
    )
    hit = F.coalesce("_at", F.array().cast("array<int>"))
    softened = F.transform(
        N.slots(F.col("notes")),
        lambda c, i: F.when(F.array_contains(hit, i) & (c == "3"), "1").when(F.array_contains(hit, i) & (c == "4"), "2").otherwise(c),
    )
    edge = F.coalesce("_edge", F.lit(False))
    return rows.select(
        *keys,
        "bar",
        F.when(edge, F.repeat(F.lit("0"), F.length("notes"))).otherwise(F.array_join(softened, "")).alias("notes"),
        F.when(edge, F.array().cast("array<int>")).otherwise(F.col("balloon_counts")).alias("balloon_counts"),
    )


def nearest_tick(wanted: DataFrame, hits: DataFrame, keys: Sequence[str], ticks: int = 48) -> DataFrame:
    """Hit of the same bar nearest to each wanted tick; the earlier one wins a tie."""
    return nearest_within(wanted, hits, keys, ticks, time="tick", out="hit_tick")


def skeleton_compare(expected: DataFrame, actual: DataFrame, spans: DataFrame, keys: Sequence[str], bars: DataFrame) -> DataFrame:
    """Expected against actual ticks per chart, with gates on long charts.

    Expected ticks under a long note of the bar count as matched. ``spans`` are
    (keys, bar, start_tick, end_tick).
    """
    keys = list(keys)
    place = [*keys, "bar", "tick"]
    want, have = expected.select(*place).distinct(), actual.select(*place).distinct()
    both = want.withColumn("_want", F.lit(True)).join(have.withColumn("_have", F.lit(True)), place, "full")
    open_ticks = both.select(*place, F.coalesce("_want", F.lit(False)).alias("w"), F.coalesce("_have", F.lit(False)).alias("h"))
    covered = count_covering(
        open_ticks, spans, [*keys, "bar"], time="tick", start="start_tick", end="end_tick", closed=True, cell_width=4096, out="_n"
    )
    under = F.col("w") & ~F.col("h") & (F.col("_n") > 0)
    sums = covered.groupBy(*keys).agg(
        flag_sum(F.col("w")).alias("expected_count"),
        flag_sum(F.col("h")).alias("actual_count"),
        flag_sum((F.col("w") & F.col("h")) | under).alias("matched_count"),
        flag_sum(F.col("h") & ~F.col("w")).alias("extra_count"),
    )
    sizes = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bars"))
    coverage = ratio(F.col("matched_count"), F.col("expected_count"), empty=1.0)
    extra = ratio(F.col("extra_count"), F.col("actual_count"))
    judged = (F.col("_bars") >= 16) & (F.col("expected_count") >= 32)
    return sums.join(sizes, keys).select(
        *keys,
        "expected_count",
        "actual_count",
        "matched_count",
        "extra_count",
        coverage.alias("coverage"),
        extra.alias("extra_rate"),
        (judged & (coverage < 0.85)).alias("misses_too_much"),
        (judged & (extra > 0.15)).alias("adds_too_much"),
    )
