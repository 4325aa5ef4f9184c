"""Quality metrics that compare charts with evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import notes as N
from pulsegrid.functions.numeric import flag_sum, ratio, round_half_even
from pulsegrid.operators.evidence import stable_tick
from pulsegrid.operators.matching import count_covering, exists_within, match_one_to_one, nearest_within, overlaps_any
from pulsegrid.operators.scan import ordered_scan, time_cell
from pulsegrid.operators.sequences import same_value_runs


def silence_violations(bars: DataFrame, keys: Sequence[str], silent: Column, activity: Column) -> DataFrame:
    """Activity inside silent bars and its share of all activity."""
    inside = F.when(silent, activity).otherwise(0)
    return bars.groupBy(*keys).agg(
        flag_sum(silent).alias("evaluated_bar_count"),
        F.sum(activity).alias("activity_count"),
        F.sum(inside).alias("violation_count"),
        ratio(F.sum(inside), F.sum(activity), digits=6).alias("violation_rate"),
    )


def arbitrary_grid(notes: DataFrame, keys: Sequence[str], ticks: int = 48, allowed: DataFrame | None = None) -> DataFrame:
    """Share of normal notes off the stable sub-grids, and whether it is too high.

    ``allowed`` holds (keys, bar, tick) rows that do not count as arbitrary.
    """
    normal = notes.filter(N.in_class(F.col("note"), N.NORMAL_NOTES))
    placed = normal.withColumn("tick", N.project_slot(F.col("pos"), F.col("res"), F.lit(ticks)))
    off = ~stable_tick(F.col("tick"), ticks)
    if allowed is not None:
        granted = allowed.select(*keys, "bar", "tick").distinct().withColumn("_ok", F.lit(True))
        placed = placed.join(granted, [*keys, "bar", "tick"], "left")
        off = off & F.col("_ok").isNull()
    counted = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("evaluated"), flag_sum(off).alias("arbitrary"))
    rate = F.col("arbitrary") / F.col("evaluated")
    flagged = (F.col("evaluated") >= 16) & (F.col("arbitrary") >= 4) & (rate > 0.10)
    return counted.select("*", rate.alias("rate"), flagged.alias("flagged"))


def candidate_times(ranked: DataFrame, keys: Sequence[str], bar_s: float = 48.0, ticks: int = 48) -> DataFrame:
    """Candidates with their time in seconds."""
    return ranked.withColumn("t", F.col("bar") * bar_s + F.col("tick") * (bar_s / ticks))


def tick_error(notes: DataFrame, evidence: DataFrame, keys: Sequence[str], tolerance: float, tick_s: float, cell: float) -> DataFrame:
    """Mean distance in ticks of notes to the nearest reliable evidence within the tolerance."""
    near = nearest_within(notes, evidence, keys, tolerance, cell_width=cell)
    error = F.abs(F.col("t") - F.col("match_t")) / tick_s
    return near.groupBy(*keys).agg(
        F.count("match_t").alias("evaluated_count"), round_half_even(F.avg(error), 6).alias("mean_tick_error")
    )


def unsupported_notes(
    notes: DataFrame,
    keys: Sequence[str],
    supports: Sequence[tuple[DataFrame, float]],
    reach: float,
    cell: float,
) -> DataFrame:
    """Notes without evidence near them and without a directly supported note within reach.

    ``notes`` carry ``t`` and a ``sustained`` flag; support does not chain.
    """
    marked = notes
    names = []
    for i, (times, tolerance) in enumerate(supports):
        marked = exists_within(marked, times, keys, tolerance, cell_width=cell, out=f"_s{i}")
        names.append(f"_s{i}")
    direct = F.col("sustained")
    for n in names:
        direct = direct | F.col(n)
    marked = marked.withColumn("direct", direct).drop(*names)
    linked = exists_within(marked, marked.filter("direct"), keys, reach, cell_width=cell, out="linked")
    lost = ~F.col("direct") & ~F.col("linked")
    return linked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated_count"),
        flag_sum(F.col("direct")).alias("direct_count"),
        flag_sum(lost).alias("unsupported_count"),
        ratio(flag_sum(lost), F.count(F.lit(1)), digits=6).alias("unsupported_rate"),
    )


def onset_response(
    onsets: DataFrame, notes: DataFrame, spans: DataFrame, keys: Sequence[str], tolerance: float, cell: float
) -> DataFrame:
    """Onsets answered by a sustained span or, one to one, by a note."""
    keys = list(keys)
    covered = count_covering(
        onsets.select(*keys, "t"), spans, keys, start="start_s", end="end_s", closed=True, cell_width=cell, out="_c"
    )
    inside = covered.filter(F.col("_c") > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("span_count"))
    outside = covered.filter(F.col("_c") == 0).select(*keys, "t")
    matched = match_one_to_one(outside, notes.select(*keys, "t"), keys, tolerance, cell_width=cell)
    is_ref = F.col("side") == "ref"
    answered = matched.filter(is_ref).groupBy(*keys).agg(
        F.count("partner_t").alias("matched_count"), F.count(F.lit(1)).alias("_outside")
    )
    joined = inside.join(answered, keys, "full").fillna(0)
    total = F.col("span_count") + F.col("_outside")
    responded = F.col("span_count") + F.col("matched_count")
    return joined.select(
        *keys,
        total.alias("evaluated_count"),
        "span_count",
        responded.alias("responded_count"),
        ratio(responded, total, empty=1.0, digits=6).alias("response"),
    )


def _kinds_in_reach(
    candidates: DataFrame, notes: DataFrame, keys: Sequence[str], kinds: Sequence[str], tolerance: float, cell: float
) -> DataFrame:
    """Each note once for every kind with a candidate in its cell or close to it.

    A note that no candidate of a kind can reach is passed over by the matching of that kind
    and decides nothing there. Cells are wide against the tolerance, and a candidate marks
    those that lie within twice the tolerance.
    """
    width = tolerance * 8 or cell
    t = F.col("t")
    ends = F.array(time_cell(t - 2 * tolerance, width), time_cell(t + 2 * tolerance, width))
    marked = candidates.select(*keys, "kind", F.explode(F.array_distinct(ends)).alias("_cell"))
    near = marked.groupBy(*keys, "_cell").agg(*[F.max(F.col("kind") == k).alias(f"_k{i}") for i, k in enumerate(kinds)])
    placed = notes.select(*keys, "t", time_cell(t, width).alias("_cell")).join(near, [*keys, "_cell"])
    met = F.array_compact(F.array(*[F.when(F.col(f"_k{i}"), F.lit(k)) for i, k in enumerate(kinds)]))
    return placed.select(*keys, "t", F.explode(met).alias("kind"))


def density_coverage(
    candidates: DataFrame, notes: DataFrame, keys: Sequence[str], kinds: Sequence[str], tolerance: float, cell: float
) -> DataFrame:
    """Reliable candidates answered one to one, per density kind; kinds without any give 1."""
    keys = list(keys)
    every = F.explode(F.array(*[F.lit(k) for k in kinds]))
    spread = _kinds_in_reach(candidates, notes, keys, kinds, tolerance, cell)
    matched = match_one_to_one(
        candidates.select(*keys, "kind", "t"), spread, [*keys, "kind"], tolerance, cell_width=cell
    )
    counted = matched.groupBy(*keys, "kind").agg(
        flag_sum((F.col("side") == "ref") & F.col("partner_t").isNotNull()).alias("responded_count"),
        flag_sum(F.col("side") == "ref").alias("evaluated_count"),
    )
    spine = notes.select(*keys).distinct().withColumn("kind", every)
    full = spine.join(counted, [*keys, "kind"], "left").fillna(0)
    return full.withColumn(
        "coverage", ratio(F.col("responded_count"), F.col("evaluated_count"), empty=1.0, digits=6)
    )


def fill_alignment(
    spans: DataFrame, bursts: DataFrame, bars: DataFrame, excess: DataFrame, notes: DataFrame, keys: Sequence[str], cell: float
) -> DataFrame:
    """Sustained spans over bursts, and ordinary fills on candidates or inside bursts.

    ``bars`` hold bar, start_s, end_s, fill_candidate and has_special; ``bursts`` hold the
    reliable bursts with start_s, end_s, start_tick and end_tick per bar.
    """
    keys = list(keys)
    spans = spans.select(*keys, "start_s", "end_s")
    wide = bursts.filter(F.col("end_tick") > F.col("start_tick")).select(*keys, "start_s", "end_s")
    hit = overlaps_any(spans, wide, keys, start="start_s", end="end_s", cell_width=cell)
    special = hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("span_count"), flag_sum(F.col("overlaps")).alias("span_hits"))
    ranges = bars.select(*keys, "bar", "start_s", "end_s", "fill_candidate", "has_special")
    touched = overlaps_any(ranges, spans, keys, start="start_s", end="end_s", cell_width=cell, out="touched")
    free = touched.filter(~F.col("touched") & ~F.col("has_special"))
    ordinary = free.join(excess.select(*keys, "bar"), [*keys, "bar"])
    inside = (
        notes.join(bursts.select(*keys, "bar", "start_tick", "end_tick"), [*keys, "bar"])
        .filter(F.col("tick").between(F.col("start_tick"), F.col("end_tick")))
        .select(*keys, "bar")
        .distinct()
        .withColumn("_in", F.lit(True))
    )
    judged = ordinary.join(inside, [*keys, "bar"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fill_count"),
        flag_sum(F.col("fill_candidate") | F.coalesce("_in", F.lit(False))).alias("fill_hits"),
    )
    full = bars.select(*keys).distinct().join(special, keys, "left").join(judged, keys, "left").fillna(0)
    aligned, total = F.col("span_hits") + F.col("fill_hits"), F.col("span_count") + F.col("fill_count")
    return full.select(
        *keys, aligned.alias("aligned_count"), total.alias("evaluated_count"), ratio(aligned, total, empty=1.0, digits=6).alias("alignment")
    )


def coverage_report(ranked: DataFrame, notes: DataFrame, keys: Sequence[str], examples: int = 16) -> DataFrame:
    """Coverage of reliable and strong candidates by notes, notes without any candidate,
    the longest run of missed strong ones and the first examples.

    Ordered by bar and rank; the runs are scanned in bar cells and the examples are cut
    per bar before they meet.
    """
    keys = list(keys)
    hits = notes.filter(N.in_class(F.col("note"), N.NORMAL_NOTES)).select(*keys, "bar", "tick").distinct()
    flagged = ranked.select(*keys, "bar", "tick", "rank", "reliable", "kind").join(
        hits.withColumn("_hit", F.lit(True)), [*keys, "bar", "tick"], "left"
    )
    flagged = flagged.withColumn("hit_it", F.coalesce("_hit", F.lit(False))).drop("_hit")
    strong = F.col("kind") == "strong-transient"
    sums = flagged.groupBy(*keys).agg(
        flag_sum(F.col("reliable")).alias("reliable_count"),
        flag_sum(F.col("reliable") & F.col("hit_it")).alias("reliable_hits"),
        flag_sum(strong).alias("strong_count"),
        flag_sum(strong & F.col("hit_it")).alias("strong_hits"),
    )
    runs = same_value_runs(
        flagged.filter(strong),
        keys,
        ["bar", "rank"],
        time_cell(F.col("bar"), 64),
        F.when(~F.col("hit_it"), F.lit("miss")),
    )
    longest = runs.groupBy(*keys).agg(F.max("run_length").alias("longest_miss_run"))
    lost = hits.join(flagged.select(*keys, "bar", "tick").distinct(), [*keys, "bar", "tick"], "left_anti")
    noted = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("note_count"))
    shown = lost.withColumn(
        "_n", F.row_number().over(Window.partitionBy(*keys).orderBy("bar", "tick"))
    ).filter(F.col("_n") <= examples)
    example = shown.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("bar", "tick"))), lambda x: F.concat_ws(":", x["bar"], x["tick"])), " "
        ).alias("unsupported_examples")
    )
    missing = lost.groupBy(*keys).agg(F.count(F.lit(1)).alias("unsupported_count"))
    full = noted.join(sums, keys, "left").join(longest, keys, "left").join(missing, keys, "left").fillna(0).join(example, keys, "left")
    return full.select(
        *keys,
        "note_count",
        "reliable_count",
        ratio(F.col("reliable_hits"), F.col("reliable_count"), empty=1.0, digits=6).alias("reliable_coverage"),
        "strong_count",
        ratio(F.col("strong_hits"), F.col("strong_count"), empty=1.0, digits=6).alias("strong_coverage"),
        "longest_miss_run",
        "unsupported_count",
        ratio(F.col("unsupported_count"), F.col("note_count"), digits=6).alias("unsupported_ratio"),
        F.coalesce("unsupported_examples", F.lit("")).alias("unsupported_examples"),
    )


def accent_coverage(accents: DataFrame, notes: DataFrame, bars: DataFrame, keys: Sequence[str], limit: int = 4, ticks: int = 48) -> DataFrame:
    """Share of the strongest accents per bar that a normal note answers.

    Accent ticks are projected to the slots of the chart bar; ``bars`` hold the bar's
    resolution ``res``.
    """
    keys = list(keys)
    top = accents.filter(F.col("accent_rank") <= limit).join(bars.select(*keys, "bar", "res"), [*keys, "bar"])
    slot = N.project_slot(F.col("tick"), F.lit(ticks), F.col("res"))
    wanted = top.select(*keys, "bar", slot.alias("pos")).distinct()
    normal = notes.filter(N.in_class(F.col("note"), N.NORMAL_NOTES)).select(*keys, "bar", "pos", F.lit(True).alias("_hit"))
    judged = wanted.join(normal, [*keys, "bar", "pos"], "left")
    return judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("accent_candidate_count"),
        F.count("_hit").alias("accent_hit_count"),
        ratio(F.count("_hit"), F.count(F.lit(1)), empty=1.0, digits=6).alias("accent_coverage"),
    )


def stem_quality(bars: DataFrame, ticks: DataFrame, notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How a chart answers the sources: drum, bass and vocal hits, changes, confidence, fills.

    ``ticks`` are evidence points; ``bars`` carry notes, dominant_source, source_confidence,
    phrase_position, role, fill_candidate and the source activities.
    """
    keys = list(keys)
    normal = notes.filter(N.in_class(F.col("note"), N.NORMAL_NOTES)).select(*keys, "bar", "pos", F.lit(True).alias("_hit"))
    placed = ticks.join(
        bars.select(*keys, "bar", F.length("notes").alias("res"), "phrase_position", "role"), [*keys, "bar"]
    )
    slotted = placed.withColumn("pos", N.project_slot(F.col("tick"), F.lit(48), F.col("res")))
    judged = slotted.join(normal, [*keys, "bar", "pos"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    drum = F.col("drum") >= 0.35
    bass = (F.col("bass") >= 0.35) & (F.col("tick") % 12 == 0)
    ends = F.col("phrase_position").isin("phrase_start", "phrase_end", "song_end") | (F.col("role") == "cadence")
    vocal = (F.col("vocal") >= 0.35) & ends
    counts = judged.groupBy(*keys).agg(
        *[
            item
            for name, cond in (("drum", drum), ("bass", bass), ("vocal", vocal))
            for item in (
                flag_sum(cond).alias(f"{name}_candidates"),
                flag_sum(cond & F.col("_hit")).alias(f"{name}_hits"),
            )
        ]
    )
    strongest = ticks.groupBy(*keys, "bar").agg(F.max(F.greatest("drum", "accompaniment")).alias("_fill"))
    rhythm = N.pattern_key(F.col("notes"), N.NORMAL_NOTES, with_note=False)
    facts = bars.join(strongest, [*keys, "bar"], "left").withColumn("_rhythm", rhythm)
    here = F.struct(F.coalesce("dominant_source", F.lit("")).alias("s"), F.col("source_confidence").alias("c"), F.col("_rhythm").alias("r"))
    stepped = ordered_scan(facts, keys, ["bar"], time_cell(F.col("bar"), 4096), lag={"_prev": here})
    changed = (
        (F.col("source_confidence") >= 0.4)
        & (F.col("_prev.c") >= 0.4)
        & (F.coalesce("dominant_source", F.lit("")) != F.col("_prev.s"))
    )
    loud = F.greatest("vocal_activity", "drum_activity", "bass_activity", "accompaniment_activity") > 0
    filled = F.col("fill_candidate") & (F.col("_fill") >= 0.35)
    second = F.expr("substring(notes, int(length(notes) / 2) + 1)")
    rows = stepped.groupBy(*keys).agg(
        flag_sum(changed).alias("change_candidates"),
        flag_sum(changed & (F.col("_rhythm") != F.col("_prev.r"))).alias("change_responses"),
        flag_sum(loud).alias("evidence_bars"),
        flag_sum(loud & (F.col("source_confidence") >= 0.4)).alias("confident_bars"),
        flag_sum(filled).alias("fill_candidates"),
        flag_sum(filled & (N.activity_count(second) > 0)).alias("fill_supported"),
    )
    full = rows.join(counts, keys, "left").fillna(0)

    def share(hit: str, of: str, empty: float = 1.0) -> Column:
        return ratio(F.col(hit), F.col(of), empty=empty, digits=6)

    return full.select(
        *keys,
        share("drum_hits", "drum_candidates").alias("drum_onset_hit_coverage"),
        share("bass_hits", "bass_candidates").alias("bass_downbeat_alignment"),
        share("vocal_hits", "vocal_candidates").alias("vocal_phrase_response"),
        share("change_responses", "change_candidates").alias("transition_response"),
        share("confident_bars", "evidence_bars", 0.0).alias("confident_bar_ratio"),
        share("fill_supported", "fill_candidates").alias("fill_support"),
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; 0 when a side is flat or has fewer than 2 rows.

    Aggregates are worked out before any condition on them, and ``corr`` divides by zero on
    flat rows; so the quotient is taken here.
    """
    both = x.isNotNull() & y.isNotNull()
    flat = (F.count(F.lit(1)) < 2) | (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    flat = flat | ((flag_sum(both) >= 2) & (spread == 0))
    measure = F.try_divide(F.covar_pop(x, y), spread)
    return F.when(flat, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), measure)))


def structure_quality(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relation of load and structure per chart.

    ``bars`` carry nps, energy_percentile, role, fill_candidate, phrase_id,
    phrase_progress and notes.
    """
    keys = list(keys)
    nps, role = F.col("nps"), F.col("role")
    stepped = ordered_scan(
        bars.withColumn("_pattern", N.pattern_key(F.col("notes"))),
        keys,
        ["bar"],
        time_cell(F.col("bar"), 4096),
        lag={"_prev": F.col("_pattern")},
    )
    peak, base = role == "peak", role.isin("stable", "breakdown")
    high = role.isin("peak", "drop", "cadence") | F.col("fill_candidate")
    cadence = (role == "cadence") & F.col("_prev").isNotNull()

    def mean(condition: Column) -> Column:
        return F.coalesce(F.avg(F.when(condition, nps)), F.lit(0.0))

    def contrast(above: Column, below: Column) -> Column:
        return F.when(flag_sum(above) > 0, mean(above) - mean(below)).otherwise(0.0)

    overall = stepped.groupBy(*keys).agg(
        round_half_even(correlation(F.col("energy_percentile"), nps), 6).alias("structure_density_correlation"),
        round_half_even(contrast(peak, base), 6).alias("peak_contrast"),
        ratio(flag_sum(cadence & (F.col("_pattern") != F.col("_prev"))), flag_sum(cadence), digits=6).alias(
            "cadence_variation_rate"
        ),
        round_half_even(contrast(high, ~high), 6).alias("highlight_note_contrast"),
    )
    phrases = bars.filter(F.col("phrase_id").isNotNull()).groupBy(*keys, "phrase_id").agg(
        flag_sum(role == "build_up").alias("_up"),
        F.count(F.lit(1)).alias("_n"),
        correlation(F.col("phrase_progress"), nps).alias("_r"),
    )
    agreement = phrases.filter((F.col("_up") > 0) & (F.col("_n") >= 2)).groupBy(*keys).agg(F.avg("_r").alias("_mean"))
    joined = overall.join(agreement, keys, "left")
    return joined.withColumn(
        "build_up_slope_agreement", round_half_even(F.coalesce("_mean", F.lit(0.0)), 6)
    ).drop("_mean")


def motif_quality(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the most common rhythm per repeated section; phrases that differ from the first of their section."""
    keys = list(keys)
    rhythm = N.pattern_key(F.col("notes"), N.NORMAL_NOTES, with_note=False)
    rows = bars.filter(F.col("section_id").isNotNull()).select(*keys, "section_id", "phrase_id", "bar", rhythm.alias("_r"))
    counted = rows.groupBy(*keys, "section_id", "_r").agg(F.count(F.lit(1)).alias("_n"))
    per_section = counted.groupBy(*keys, "section_id").agg(F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
    consistent = per_section.filter(F.col("_all") >= 2).groupBy(*keys).agg(
        ratio(F.sum("_top"), F.sum("_all"), empty=1.0, digits=6).alias("section_motif_consistency")
    )
    # Phrases are compared by a hash of their ordered rhythms: bars of one phrase only.
    phrases = rows.filter(F.col("phrase_id").isNotNull()).groupBy(*keys, "section_id", "phrase_id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", "_r"))), lambda x: x["_r"]), ";"), 256).alias("_h")
    )
    first = phrases.groupBy(*keys, "section_id").agg(F.min_by("_h", "phrase_id").alias("_first"))
    compared = phrases.join(first, [*keys, "section_id"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_phrases"),
        F.count_distinct("section_id").alias("_sections"),
        flag_sum(F.col("_h") != F.col("_first")).alias("_varied"),
    )
    returned = compared.select(
        *keys, ratio(F.col("_varied"), F.col("_phrases") - F.col("_sections"), digits=6).alias("section_return_variation")
    )
    full = bars.select(*keys).distinct().join(consistent, keys, "left").join(returned, keys, "left")
    return full.select(
        *keys,
        F.coalesce("section_motif_consistency", F.lit(1.0)).alias("section_motif_consistency"),
        F.coalesce("section_return_variation", F.lit(0.0)).alias("section_return_variation"),
    )


def resolution_quality(bars: DataFrame, keys: Sequence[str], base_slots: int = 16) -> DataFrame:
    """Most common resolution (first seen wins ties), changes, fine bars, avoided changes."""
    keys = list(keys)
    rows = bars.select(*keys, "bar", "phrase_id", F.length("notes").alias("res"))
    seen = rows.groupBy(*keys, "res").agg(F.count(F.lit(1)).alias("_n"), F.min("bar").alias("_first"))
    mode = seen.groupBy(*keys).agg(F.max_by("res", F.struct("_n", -F.col("_first"))).alias("base_resolution"))
    stepped = ordered_scan(
        rows, keys, ["bar"], time_cell(F.col("bar"), 4096), lag={"_prev": F.struct("res", "phrase_id")}
    )
    changed = F.col("_prev.res") != F.col("res")
    avoided = (F.col("_prev.res") == F.col("res")) & ~F.col("_prev.phrase_id").eqNullSafe(F.col("phrase_id"))
    sums = stepped.groupBy(*keys).agg(
        flag_sum(changed).alias("resolution_change_count"),
        ratio(flag_sum(changed) * 100, F.count(F.lit(1)), digits=6).alias("changes_per_100_bars"),
        ratio(flag_sum(F.col("res") > base_slots), F.count(F.lit(1)), digits=6).alias("high_resolution_ratio"),
        flag_sum(avoided).alias("avoided_changes"),
    )
    return mode.join(sums, keys)


def expected_bars(ranges: DataFrame, bars: DataFrame, flagged: DataFrame, keys: Sequence[str], bar_s: float, late: Column) -> DataFrame:
    """Bars that hold a range's midpoint against flagged bars: agreement and late flags.

    Bars are regular, so a midpoint names its bar without a range join.
    """
    keys = list(keys)
    middle = (F.col("start_s") + F.col("end_s")) / 2
    wanted = ranges.select(*keys, F.floor(middle / bar_s).cast("int").alias("bar")).distinct()
    wanted = wanted.join(bars.select(*keys, "bar"), [*keys, "bar"], "left_semi").withColumn("_want", F.lit(True))
    got = flagged.select(*keys, "bar", late.alias("_late"), F.lit(True).alias("_got"))
    both = wanted.join(got, [*keys, "bar"], "full")
    want, have = F.coalesce("_want", F.lit(False)), F.coalesce("_got", F.lit(False))
    return both.groupBy(*keys).agg(
        flag_sum(want).alias("expected_count"),
        flag_sum(have).alias("flagged_count"),
        flag_sum(want & have).alias("agreed_count"),
        flag_sum(F.coalesce("_late", F.lit(False))).alias("late_count"),
        F.bool_and(want == have).alias("exact"),
    )
