"""Chart metrics: load, colour, repetition, sustained notes, isolation, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import notes as N
from pulsegrid.functions.numeric import flag_sum, is_finite, ratio, round_half_even
from pulsegrid.operators.scan import ordered_scan, time_cell
from pulsegrid.operators.sequences import rolling_best, same_value_runs, true_runs

BAR_CELL = 64


def valid_duration() -> Column:
    length = F.col("end_s") - F.col("start_s")
    return is_finite(length) & (length > 0) & (F.length("notes") > 0)


def explode_notes(bars: DataFrame, keys: Sequence[str] = ("track", "bar")) -> DataFrame:
    """One row per non-rest slot: keys, pos, res, note, time_s. Bars without a valid length give none."""
    timed = bars.filter(valid_duration())
    slots = timed.select(
        *keys, "start_s", "end_s", F.length("notes").alias("res"), F.posexplode(N.slots(F.col("notes"))).alias("pos", "note")
    ).filter(F.col("note") != N.REST)
    time = F.col("start_s") + (F.col("end_s") - F.col("start_s")) * F.col("pos") / F.col("res")
    return slots.select(*keys, "pos", "res", "note", time.alias("time_s"))


def note_counts(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    notes = F.col("notes")
    return bars.select(
        *keys,
        N.normal_count(notes).alias("normal_count"),
        N.nonrest_count(notes).alias("nonrest_count"),
        N.activity_count(notes).alias("activity_count"),
        N.special_count(notes).alias("special_count"),
        N.start_count(notes).alias("start_count"),
    )


def chart_load(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Notes, seconds and rates over bars of valid length; active bars hold a normal note."""
    length = F.col("end_s") - F.col("start_s")
    rows = bars.filter(valid_duration()).select(
        *keys, N.normal_count(F.col("notes")).alias("hits"), length.alias("seconds")
    )
    sums = rows.groupBy(*keys).agg(
        F.sum("hits").cast("long").alias("playable_note_count"),
        F.sum("seconds").alias("playable_seconds"),
        F.max(F.col("hits") / F.col("seconds")).alias("peak_bar_nps"),
        F.sum(F.when(F.col("hits") > 0, F.col("seconds")).otherwise(0.0)).alias("active_seconds"),
    )
    return sums.select(
        "*",
        ratio(F.col("playable_note_count"), F.col("playable_seconds")).alias("average_nps"),
        ratio(F.col("playable_note_count"), F.col("active_seconds")).alias("active_nps"),
    )


def color_balance(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Don and ka counts, ka share and the longest run of one colour.

    Rests do not break a run; any other note does.
    """
    counts = notes.groupBy(*keys).agg(
        flag_sum(F.col("note") == "1").alias("don_count"), flag_sum(F.col("note") == "2").alias("ka_count")
    )
    value = F.when(F.col("note").isin("1", "2"), F.col("note"))
    cell = time_cell(F.col("bar"), BAR_CELL)
    runs = same_value_runs(notes.select(*keys, "bar", "pos", "note"), keys, ["bar", "pos"], cell, value)
    longest = runs.groupBy(*keys).agg(
        F.max("run_length").alias("longest_run"),
        F.max(F.when(F.col("run_value") == "1", F.col("run_length"))).alias("longest_don_run"),
    )
    don, ka = F.col("don_count"), F.col("ka_count")
    share = ratio(ka, don + ka)
    don_run = F.coalesce("longest_don_run", F.lit(0))
    issue = (
        F.when(don + ka < 32, None)
        .when((ka < 4) & (share < 0.03), "nearly-all-don")
        .when((don_run > 32) & (share < 0.08), "overlong-don-run")
    )
    return counts.join(longest, list(keys), "left").select(
        *keys,
        don,
        ka,
        share.alias("ka_ratio"),
        F.coalesce("longest_run", F.lit(0)).alias("longest_run"),
        issue.alias("balance_issue"),
    )


def color_runs(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram of run lengths per colour."""
    value = F.when(F.col("note").isin("1", "2"), F.col("note"))
    cell = time_cell(F.col("bar"), BAR_CELL)
    runs = same_value_runs(notes.select(*keys, "bar", "pos", "note"), keys, ["bar", "pos"], cell, value)
    return runs.groupBy(*keys, F.col("run_value").alias("color"), "run_length").agg(F.count(F.lit(1)).alias("run_count"))


def pattern_repeat(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated bars and overused patterns among bars with activity."""
    active = bars.filter(N.activity_count(F.col("notes")) > 0)
    patterns = active.select(*keys, N.pattern_key(F.col("notes")).alias("pattern"))
    counted = patterns.groupBy(*keys, "pattern").agg(F.count(F.lit(1)).alias("n"))
    sizes = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("bar_count"))
    limit = F.greatest(F.lit(4), F.floor(F.col("bar_count") / 12))
    rolled = counted.join(sizes, list(keys)).groupBy(*keys, "bar_count").agg(
        F.sum(F.col("n") - 1).alias("repeated_bar_count"),
        F.sum("n").alias("nonempty_bar_count"),
        flag_sum(F.col("n") > limit).alias("overused_pattern_count"),
    )
    joined = sizes.join(rolled.drop("bar_count"), list(keys), "left")
    zero = F.lit(0)
    return joined.select(
        *keys,
        "bar_count",
        F.coalesce("repeated_bar_count", zero).alias("repeated_bar_count"),
        ratio(F.col("repeated_bar_count"), F.col("nonempty_bar_count")).alias("repeated_bar_rate"),
        F.coalesce("overused_pattern_count", zero).alias("overused_pattern_count"),
    )


def empty_runs(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of consecutive bars without activity."""
    return true_runs(bars, keys, "bar", N.activity_count(F.col("notes")) == 0)


def sustain_events(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Openers, enders and reset marks of bars without a valid length."""
    marks = explode_notes(bars, [*keys, "bar"]).filter(F.col("note").isin("5", "7", "8"))
    resets = bars.filter(~valid_duration()).select(
        *keys, "bar", F.lit(-1).alias("pos"), F.lit(0).alias("res"), F.lit("x").alias("note"), F.col("start_s").alias("time_s")
    )
    return marks.unionByName(resets)


def _segments(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number the stretches between enders (or resets); the closing mark belongs to its stretch."""
    closing = F.when(F.col("note").isin("8", "x"), 1).otherwise(0)
    opener = F.when(F.col("note").isin("5", "7"), 1).otherwise(0)
    numbered = ordered_scan(
        marks,
        keys,
        ["bar", "pos"],
        time_cell(F.col("bar"), BAR_CELL),
        cumsum={"_closed": closing, "_opened": opener},
    )
    return numbered.withColumn("segment", F.col("_closed") - closing).drop("_closed")


def sustain_spans(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Toggle pairing: a second opener cancels the first, an ender closes an open span."""
    opener = F.col("note").isin("5", "7")
    place = F.struct("bar", "pos")
    spans = _segments(marks, keys).groupBy(*keys, "segment").agg(
        flag_sum(opener).alias("_openers"),
        F.max_by("time_s", F.when(opener, place)).alias("start_s"),
        F.max_by("note", F.when(opener, place)).alias("note"),
        F.max(F.when(F.col("note") == "8", F.col("time_s"))).alias("end_s"),
    )
    found = (F.col("_openers") % 2 == 1) & (F.col("end_s") > F.col("start_s"))
    return spans.filter(found).select(*keys, "start_s", "end_s", "note")


def span_issues(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strict pairing: overlapping starts, orphan ends and spans never closed."""
    seg = _segments(marks, keys)
    opener = F.col("note").isin("5", "7")
    facts = seg.groupBy(*keys, "segment").agg(
        F.min(F.when(opener, F.col("_opened"))).alias("_first"),
        F.max(F.when(~opener, 1).otherwise(0)).alias("_ended"),
    )
    rows = seg.join(facts, [*keys, "segment"])
    code = (
        F.when(opener & (F.col("_opened") > F.col("_first")), "overlapping-roll-start")
        .when((F.col("note") == "8") & F.col("_first").isNull(), "orphan-roll-end")
        .when(opener & (F.col("_ended") == 0), "unclosed-roll")
    )
    return rows.select(*keys, "bar", "pos", code.alias("code")).filter(F.col("code").isNotNull())


def sustain_metrics(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, seconds and required hits of rolls and balloons; ends are looked up in the same bar."""
    chars = N.slots(F.col("notes"))
    length = F.length("notes")
    seconds = F.col("end_s") - F.col("start_s")
    indexed = F.transform(chars, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    starts = F.filter(indexed, lambda x: x["c"].isin("5", "7"))
    ends = F.filter(indexed, lambda x: x["c"] == "8")
    spans = F.transform(
        starts,
        lambda s: F.struct(
            s["c"].alias("note"),
            F.coalesce(
                F.array_min(F.transform(F.filter(ends, lambda e: e["i"] > s["i"]), lambda e: e["i"])) - s["i"],
                F.lit(0),
            ).alias("slots"),
        ),
    )
    # The k-th balloon of a bar takes the k-th count.
    balloons = F.size(F.filter(chars, lambda c: c == "7"))
    hits = F.aggregate(
        F.slice(F.col("balloon_counts"), F.lit(1), balloons),
        F.lit(0).cast("long"),
        lambda a, c: a + F.when(c > 0, c).otherwise(0),
    )
    valid = valid_duration()

    def total(note: str) -> Column:
        mine = F.filter(spans, lambda s: s["note"] == note)
        return F.aggregate(mine, F.lit(0), lambda a, s: a + s["slots"])

    rows = bars.select(
        *keys,
        N.count_chars(F.col("notes"), "5").alias("rolls"),
        balloons.alias("balloons"),
        F.when(valid, seconds * total("5") / length).otherwise(0.0).alias("roll_s"),
        F.when(valid, seconds * total("7") / length).otherwise(0.0).alias("balloon_s"),
        F.when(balloons > 0, hits).otherwise(0).alias("hits"),
    )
    sums = rows.groupBy(*keys).agg(
        F.sum("rolls").cast("long").alias("drumroll_count"),
        F.sum("balloons").cast("long").alias("balloon_count"),
        F.sum("roll_s").alias("drumroll_seconds"),
        F.sum("balloon_s").alias("balloon_seconds"),
        F.sum("hits").cast("long").alias("balloon_required_hits"),
    )
    return sums.withColumn(
        "balloon_hits_per_second", ratio(F.col("balloon_required_hits"), F.col("balloon_seconds"))
    )


def isolation_violations(notes: DataFrame, keys: Sequence[str], minimum_s: float) -> DataFrame:
    """Big notes whose nearest normal note, in any bar, is not more than ``minimum_s`` away."""
    normal = notes.filter(N.in_class(F.col("note"), N.NORMAL_NOTES))
    near = ordered_scan(
        normal,
        keys,
        ["time_s", "bar", "pos"],
        time_cell(F.col("bar"), BAR_CELL),
        lag={"_before": F.col("time_s")},
        lead={"_after": F.col("time_s")},
    )
    nearest = F.least(F.col("time_s") - F.col("_before"), F.col("_after") - F.col("time_s"))
    big = near.filter(F.col("note").isin("3", "4")).withColumn("nearest_s", nearest)
    return big.filter(F.col("nearest_s") <= minimum_s).select(
        *keys, "bar", "pos", "note", F.greatest(F.lit(0.0), F.col("nearest_s")).alias("nearest_s")
    )


def local_excess(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars with a roll or balloon, or at least two hits above the mean of their neighbours."""
    rows = bars.withColumn("_hits", N.nonrest_count(F.col("notes")))
    near = ordered_scan(
        rows,
        keys,
        ["bar"],
        time_cell(F.col("bar"), 4096),
        lag={"_before": F.col("_hits")},
        lead={"_after": F.col("_hits")},
    )
    sides = F.array_compact(F.array("_before", "_after"))
    mean = F.aggregate(sides, F.lit(0), lambda a, x: a + x) / F.size(sides)
    special = N.count_chars(F.col("notes"), "57") > 0
    excess = (F.size(sides) > 0) & (F.col("_hits") >= F.try_divide(mean * F.size(sides), F.size(sides)) + 2)
    return near.filter(special | excess).select(*keys, "bar", special.alias("special"))


def course_metrics(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per chart: sizes, resolution histogram and changes, note counts, rates, highlighted part."""
    keys = list(keys)
    length = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    rows = bars.select(
        *keys,
        "bar",
        "gogo",
        F.length("notes").alias("res"),
        N.normal_count(F.col("notes")).alias("normal"),
        N.special_count(F.col("notes")).alias("special"),
        length.alias("seconds"),
    )
    stepped = ordered_scan(rows, keys, ["bar"], time_cell(F.col("bar"), 4096), lag={"_prev": F.col("res")})
    sums = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bar_count"),
        flag_sum(F.col("_prev") != F.col("res")).alias("resolution_change_count"),
        F.sum("normal").cast("long").alias("normal_note_count"),
        F.sum("special").cast("long").alias("special_note_count"),
        F.sum("seconds").alias("_seconds"),
        F.max(F.try_divide(F.col("normal"), F.col("seconds"))).alias("_peak"),
        flag_sum(F.col("gogo")).alias("gogo_bar_count"),
        F.sum(F.when(F.col("gogo"), F.col("normal")).otherwise(0)).alias("_gogo_notes"),
        F.sum(F.when(F.col("gogo"), F.col("seconds")).otherwise(0.0)).alias("_gogo_seconds"),
    )
    histogram = (
        rows.groupBy(*keys, "res")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("res", "n"))).alias("h"))
        .select(*keys, F.array_join(F.transform("h", lambda x: F.concat_ws(":", x["res"], x["n"])), ",").alias("resolution_counts"))
    )
    return sums.join(histogram, keys).select(
        *keys,
        "bar_count",
        "resolution_counts",
        "resolution_change_count",
        "normal_note_count",
        "special_note_count",
        round_half_even(F.col("_seconds"), 6).alias("playable_seconds"),
        ratio(F.col("normal_note_count"), F.col("_seconds"), digits=6).alias("average_nps"),
        round_half_even(F.coalesce("_peak", F.lit(0.0)), 6).alias("peak_bar_nps"),
        "gogo_bar_count",
        ratio(F.col("_gogo_notes"), F.col("_gogo_seconds"), digits=6).alias("gogo_average_nps"),
    )


def corpus_rollup(bars: DataFrame) -> DataFrame:
    """Totals, bars per resolution and charts per course and level, in one pass over chart counts."""
    per_chart = bars.groupBy("source_id", "course", "level", F.length("notes").alias("resolution")).agg(
        F.count(F.lit(1)).alias("bars"), flag_sum(F.col("gogo")).alias("gogo")
    )
    marked = per_chart.withColumn("chart", F.struct("source_id", "course"))
    rolled = marked.groupingSets([["course", "level"], ["resolution"], []], "course", "level", "resolution").agg(
        F.grouping_id().alias("_set"),
        F.sum("bars").alias("bar_count"),
        F.sum("gogo").alias("gogo_bar_count"),
        F.count_distinct("chart").alias("chart_count"),
        F.count_distinct("source_id").alias("source_count"),
    )
    kind = F.when(F.col("_set") == 7, "total").when(F.col("_set") == 6, "resolution").otherwise("course_level")
    key = F.coalesce(
        F.col("resolution").cast("string"), F.concat_ws(":", "course", F.col("level").cast("string")), F.lit("")
    )
    return rolled.select(
        kind.alias("kind"), key.alias("group_key"), "bar_count", "gogo_bar_count", "chart_count", "source_count"
    )


def bar_nps() -> Column:
    length = F.col("end_s") - F.col("start_s")
    return F.when(length > 0, N.normal_count(F.col("notes")) / length).otherwise(0.0)


def reference_windows(bars: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Intro, cadence and peak windows per chart; equal starts keep the first role."""
    if size < 2:
        raise ValueError("a window needs at least 2 bars")
    keys = list(keys)
    rated = bars.withColumn("_nps", bar_nps())
    extent = rated.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bars"))
    peak = rolling_best(rated, keys, "bar", "_nps", size)
    width = F.least(F.lit(size), F.col("_bars")).cast("int")
    last = (F.col("_bars") - width).cast("int")
    picks = extent.join(peak, keys).select(
        *keys,
        width.alias("_width"),
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_order"), F.lit("intro").alias("role"), F.lit(0).alias("start_bar")),
                F.struct(F.lit(1).alias("_order"), F.lit("cadence").alias("role"), last.alias("start_bar")),
                F.struct(
                    F.lit(2).alias("_order"),
                    F.lit("peak").alias("role"),
                    F.least(last, F.col("window_start").cast("int")).alias("start_bar"),
                ),
            )
        ),
    )
    chosen = picks.groupBy(*keys, "_width", "start_bar").agg(F.min_by("role", "_order").alias("role"))
    covered = chosen.withColumn(
        "bar", F.explode(F.sequence(F.col("start_bar"), F.col("start_bar") + F.col("_width") - 1))
    ).join(rated, [*keys, "bar"])
    indexed = F.transform(N.slots(F.col("notes")), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    sparse = F.array_join(
        F.transform(F.filter(indexed, lambda x: x["c"] != N.REST), lambda x: F.concat_ws(":", x["i"], x["c"])), " "
    )
    payload = F.concat_ws(
        "|",
        F.col("bar") - F.col("start_bar"),
        F.length("notes"),
        F.col("gogo").cast("int"),
        N.normal_count(F.col("notes")),
        sparse,
        F.array_join(F.col("balloon_counts").cast("array<string>"), ","),
    )
    length = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    return covered.groupBy(*keys, "role", "start_bar", "_width").agg(
        ratio(F.sum(N.normal_count(F.col("notes"))), F.sum(length), digits=6).alias("average_nps"),
        round_half_even(F.avg(F.col("gogo").cast("double")), 6).alias("gogo_ratio"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("bar", payload.alias("p")))), lambda x: x["p"]), ";"
        ).alias("bars"),
    ).select(
        *keys, "role", "start_bar", (F.col("start_bar") + F.col("_width") - 1).alias("end_bar"), "average_nps", "gogo_ratio", "bars"
    )


def retrieve_windows(windows: DataFrame, requests: DataFrame, per_request: int = 3) -> DataFrame:
    """Up to ``per_request`` windows per (course, level) request.

    One window per role by level distance, unused source, then rate or start; then fill by
    distance, unused source, source and start. Charts of all courses serve a course that has
    none. The requests join a short list that is provably enough:

    * role picks: two sources at most are used before one, and three windows of each source
      are listed, so the best nine of a (course, level, role) hold one of an unused source
      wherever there is one;
    * fills: three sources at most are used before them, so the first ``per_request`` + 3
      sources of a (course, level) hold ``per_request`` unused ones, or are all there are;
      of each the first ``per_request`` + 3 windows are listed, as three may be taken.
    """
    key = F.struct(
        F.when(F.col("role") == "peak", -F.col("average_nps")).otherwise(F.col("start_bar").cast("double")),
        F.col("source_id"),
    )
    own = windows.withColumn("pool", F.lower("course"))
    everyone = windows.withColumn("pool", F.lit("*"))
    pooled = own.unionByName(everyone).select(
        "pool", "level", "role", "source_id", "course", "start_bar", "average_nps", key.alias("_key")
    )
    by_source = Window.partitionBy("pool", "level", "role", "source_id").orderBy("_key", "course")
    by_role = Window.partitionBy("pool", "level", "role").orderBy("_key", "course")
    by_fill = Window.partitionBy("pool", "level", "source_id").orderBy("start_bar", "course", "role")
    by_place = Window.partitionBy("pool", "level").orderBy("source_id")
    firsts = pooled.withColumn("_s", F.row_number().over(by_source)).filter(F.col("_s") <= 3)
    leaders = firsts.withColumn("_r", F.row_number().over(by_role)).filter(F.col("_r") <= 9).drop("_r", "_s")
    depth = per_request + 3
    sources = pooled.select("pool", "level", "source_id").distinct()
    sources = sources.withColumn("_p", F.row_number().over(by_place)).filter(F.col("_p") <= depth).drop("_p")
    fills = pooled.join(sources, ["pool", "level", "source_id"], "left_semi")
    fills = fills.withColumn("_f", F.row_number().over(by_fill)).filter(F.col("_f") <= depth).drop("_f")
    shortlist = leaders.unionByName(fills).distinct()
    known = windows.select(F.lower("course").alias("pool")).distinct()
    asked = requests.withColumn("_want", F.lower("course")).join(
        known.withColumnRenamed("pool", "_want").withColumn("_known", F.lit(True)), "_want", "left"
    )
    asked = asked.select(
        F.col("course").alias("want_course"),
        F.col("level").alias("want_level"),
        F.when(F.col("_known"), F.col("_want")).otherwise("*").alias("pool"),
    )
    item = F.struct(
        "role", "_key", "source_id", "course", "start_bar", "average_nps", F.abs(F.col("level") - F.col("want_level")).alias("d"), "level"
    )
    offers = asked.join(shortlist, "pool").groupBy("want_course", "want_level").agg(F.collect_list(item).alias("items"))

    def rank(x: Column, used: Column) -> Column:
        return F.struct(
            x["d"].alias("d"),
            F.array_contains(used, x["source_id"]).alias("u"),
            x["_key"].alias("k"),
            x["course"].alias("c"),
            x.alias("x"),
        )

    none = F.array().cast("array<long>")
    picks = offers.select("*", none.alias("used"))
    chosen: list[Column] = []
    for n, role in enumerate(("intro", "peak", "cadence")):
        wanted = F.lit(role)
        offered = F.filter("items", lambda x: x["role"] == wanted)  # noqa: B023
        best = F.array_min(F.transform(offered, lambda x: rank(x, F.col("used"))))
        picks = picks.withColumn(f"p{n}", best["x"]).withColumn(
            "used", F.when(F.col(f"p{n}").isNotNull(), F.array_append("used", F.col(f"p{n}")["source_id"])).otherwise(F.col("used"))
        )
        chosen.append(F.col(f"p{n}"))
    taken = F.array_compact(F.array(*chosen))
    rest = F.array_except(F.col("items"), taken)
    ranked = F.array_sort(
        F.transform(
            rest,
            lambda x: F.struct(
                x["d"].alias("d"),
                F.array_contains("used", x["source_id"]).alias("u"),
                x["source_id"].alias("s"),
                x["start_bar"].alias("b"),
                x["course"].alias("c"),
                x["role"].alias("r"),
                x.alias("x"),
            ),
        )
    )
    full = F.slice(F.concat(taken, F.transform(ranked, lambda r: r["x"])), 1, per_request)
    return picks.select("want_course", "want_level", F.posexplode(full).alias("pick", "w")).select(
        "want_course", "want_level", "pick", "w.role", "w.source_id", "w.course", "w.level", "w.start_bar"
    )
