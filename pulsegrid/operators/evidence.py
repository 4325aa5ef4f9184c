"""Evidence per tick: dense grid, peaks, hit, accent and class scores, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import flag_sum, round_half_even, unit
from pulsegrid.operators.sequences import grouped_quantiles

# Gates, thresholds and role factors of the scores.
ACTIVE = 0.08
ONSET_GATE = 0.08
SPECTRAL_GATE = 0.12
BEAT_GATE = 0.08
HIT_MINIMUM = 0.02
SPECTRAL_MINIMUM = 0.05
ACCENT_MINIMUM = 0.15
STRONG_ONSET = 0.55
USABLE = 0.45
DOMINANCE = 0.12
ATTACK_GATE = 0.35
PERCUSSIVE_GATE = 0.35
PREFERENCE_CAP = 0.75
BURST_SCORE = 0.40
BURST_CONFIDENCE = 0.50
FLUX_GATE = 0.35
BURST_TICK_GATE = 0.25
STEM_ACTIVITY = 0.08
STEM_ONSET = 0.18
BASS_GATE = 0.25
VOCAL_GATE = 0.35
ACCOMPANIMENT_GATE = 0.30
HIT_FACTORS = {"build_up": 1.04, "peak": 1.08, "fill": 1.06, "cadence": 1.06, "drop": 0.92, "breakdown": 0.85}
ACCENT_FACTORS = {"build_up": 1.03, "peak": 1.08, "fill": 1.12, "cadence": 1.12, "drop": 0.95, "breakdown": 0.85}

CHANNELS = ("strength", "activity", "low", "mid", "high", "flux", "vocal", "drum", "bass", "accompaniment")
BAR = ("track", "bar")


def c(name: str) -> Column:
    return F.col(name)


def by_role(factors: dict[str, float]) -> Column:
    value = F.lit(1.0)
    for role, factor in factors.items():
        value = F.when(c("role") == role, factor).otherwise(value)
    return value


def stable_tick(tick: Column, ticks: int = 48) -> Column:
    """Ticks on a straight or triplet sub-grid; grids that are no multiple of 12 are all stable."""
    inside = (tick >= 0) & (tick < ticks)
    if ticks % 12:
        return inside
    return inside & ((tick % 2 == 0) | (tick % 3 == 0))


def stem_strength(onset: Column, activity: Column) -> Column:
    quiet = (onset < STEM_ONSET) | (activity < STEM_ACTIVITY)
    return F.when(quiet, 0.0).otherwise(unit(onset * (0.55 + activity * 0.45)))


def evidence_grid(points: DataFrame, bars: DataFrame, ticks: int = 48, beat: int = 12, whole: bool = True) -> DataFrame:
    """Every tick of every bar with its evidence, zero where there is none.

    ``points`` are sparse rows (track, bar, tick, onset, channels); duplicates take the
    maximum. ``bars`` carry the bar context. Points are gathered per bar (at most ``ticks``
    of them) and the bar is unrolled, so the dense grid is never shuffled. Unless the grid is
    to be ``whole``, ticks off the beat without a point have no row: all they hold is zero.
    """
    # A duplicated tick is settled before the bar is gathered.
    single = points.groupBy(*BAR, "tick").agg(
        F.bool_or("onset").alias("onset"), F.bool_or("hint").alias("hint"), *[F.max(n).alias(n) for n in CHANNELS]
    )
    place = F.sequence(F.lit(0), F.lit(ticks - 1), F.lit(1 if whole else beat))
    if whole:
        value = F.struct("onset", "hint", *CHANNELS)
        gathered = single.groupBy(*BAR).agg(F.map_from_entries(F.collect_list(F.struct("tick", value))).alias("_m"))
        spread = bars.join(gathered, list(BAR), "left").select(*bars.columns, "_m", F.explode(place).alias("tick"))
        found = spread.withColumn("_p", F.element_at("_m", c("tick"))).drop("_m")
    else:
        inside = single.filter(c("tick").between(0, ticks - 1))
        value = F.struct(c("tick").cast("int").alias("tick"), "onset", "hint", *CHANNELS)
        gathered = inside.groupBy(*BAR).agg(F.collect_list(value).alias("_m"))
        empty = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in single.dtypes if n not in BAR and n != "tick"])
        joined = bars.join(gathered, list(BAR), "left").withColumn("_m", F.coalesce("_m", F.array().cast(gathered.schema["_m"].dataType)))
        bare = F.transform(
            F.array_except(place, F.transform("_m", lambda p: p["tick"])),
            lambda t: F.struct(t.alias("tick"), *[empty[n].alias(n) for n in ("onset", "hint", *CHANNELS)]),
        )
        spread = joined.select(*bars.columns, F.explode(F.concat("_m", bare)).alias("_p"))
        found = spread.withColumn("tick", c("_p.tick"))
    onset = F.coalesce(c("_p.onset"), F.lit(False))
    strength = F.when(onset, F.when(c("_p.strength") > 0, unit(c("_p.strength"))).otherwise(1.0)).otherwise(0.0)
    return found.select(
        *bars.columns,
        "tick",
        onset.alias("onset"),
        strength.alias("strength"),
        F.coalesce(c("_p.hint"), F.lit(False)).alias("hint"),
        *[F.coalesce(unit(c(f"_p.{n}")), F.lit(0.0)).alias(n) for n in CHANNELS if n != "strength"],
        (c("tick") % beat == 0).alias("beat"),
        (c("tick") == 0).alias("downbeat"),
    )


def spectral_strength() -> Column:
    return F.greatest(c("low"), c("mid"), c("high"), c("flux") * 0.8)


def drum_strength(spectral: Column) -> Column:
    base = stem_strength(c("drum"), c("drum_activity"))
    return (
        F.when(base <= 0, 0.0)
        .when(c("onset") | (spectral >= SPECTRAL_GATE), unit(base + 0.12))
        .when(~stable_tick(c("tick")), 0.0)
        .otherwise(F.least(F.lit(0.45), base * 0.75))
    )


def with_peaks(grid: DataFrame) -> DataFrame:
    """Onset peaks, spectral peaks, the margin over the neighbouring ticks, and whether any tick
    of the bar moves (_moving): the bar is together here, and later needs no shuffle for it.
    Ticks that the grid leaves out count as zero."""
    moving = c("onset") | (c("spectral") >= SPECTRAL_MINIMUM) | (c("drum_raw") >= STEM_ONSET)
    order = Window.partitionBy(*BAR).orderBy("tick")
    based = grid.withColumn("spectral", spectral_strength()).withColumn("onset_eff", c("strength"))
    based = based.withColumn("drum_raw", drum_strength(c("spectral")))
    based = based.withColumn("_any", F.greatest("onset_eff", "spectral", "drum_raw"))

    # One look at either side brings all that is compared.
    side = F.struct("tick", "strength", "spectral", "onset", "_any")
    based = based.withColumn("_left", F.lag(side).over(order)).withColumn("_right", F.lead(side).over(order))

    def near(name: str, default) -> tuple[Column, Column]:
        before = F.when(c("_left.tick") == c("tick") - 1, c(f"_left.{name}"))
        after = F.when(c("_right.tick") == c("tick") + 1, c(f"_right.{name}"))
        return F.coalesce(before, F.lit(default)), F.coalesce(after, F.lit(default))

    so_l, so_r = near("strength", 0.0)
    sp_l, sp_r = near("spectral", 0.0)
    on_l, on_r = near("onset", False)
    an_l, an_r = near("_any", 0.0)
    sides = based.select(
        "*",
        (c("onset") & (c("strength") > so_l) & (c("strength") >= so_r)).alias("onset_peak"),
        (
            (c("spectral") >= SPECTRAL_MINIMUM)
            & (c("onset") | (~on_l & ~on_r & (c("spectral") > sp_l) & (c("spectral") >= sp_r)))
        ).alias("spectral_peak"),
        unit(c("_any") - F.greatest(an_l, an_r, F.lit(0.0))).alias("margin"),
        F.max(moving).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_moving"),
    )
    return sides.drop("_any", "_left", "_right")


def transient_reference(peaks: DataFrame) -> DataFrame:
    """75th percentile of the transient strengths of a track, outside edge silence."""
    strengths = F.array_compact(
        F.array(
            F.when(c("onset_eff") >= ONSET_GATE, c("onset_eff")),
            F.when(c("drum_raw") >= STEM_ONSET, c("drum_raw")),
            F.when(c("spectral_peak") & (c("spectral") >= SPECTRAL_GATE), c("spectral")),
        )
    )
    rows = peaks.filter(~c("edge")).select("track", F.explode(strengths).alias("x"))
    return grouped_quantiles(rows, ["track"], {"transient_p75": (c("x"), 0.75)}, 0.125)


def hit_scores(peaks: DataFrame, reference: DataFrame) -> DataFrame:
    """Hit score, confidence and reasons of every tick worth keeping."""
    rows = peaks.filter(~c("edge") & ~(c("silent") & ~c("_moving")))
    rows = rows.join(reference, ["track"], "left")
    rows = rows.withColumn("sp", F.when(c("spectral_peak"), c("spectral")).otherwise(0.0))
    rows = rows.withColumn("drum_s", drum_strength(c("sp")))
    rows = rows.withColumn("bass_s", stem_strength(c("bass"), c("bass_activity"))).withColumn(
        "acc_s", stem_strength(c("accompaniment"), c("accompaniment_activity"))
    )
    on_beat = c("beat") | c("downbeat")
    drive = F.greatest(c("activity"), unit(c("energy")))
    transient = F.greatest(
        F.when(c("onset_eff") >= ONSET_GATE, c("onset_eff")).otherwise(0.0),
        F.when(c("sp") >= SPECTRAL_GATE, c("sp")).otherwise(0.0) * 0.75,
        c("drum_s"),
    )
    skeleton = F.when(~on_beat | (drive < BEAT_GATE), 0.0).otherwise(
        unit(
            F.when(c("downbeat"), 0.26).otherwise(0.20) * drive
            + c("bass_s") * F.when(c("downbeat"), 0.10).otherwise(0.06)
        )
    )
    factor = by_role(HIT_FACTORS)
    hit = unit(F.greatest(transient, skeleton) * factor)
    onset_c = F.when(c("onset_eff") >= ONSET_GATE, 0.45 + c("onset_eff") * 0.45).otherwise(0.0)
    spectral_c = F.when(c("sp") >= SPECTRAL_GATE, 0.30 + c("sp") * 0.45).otherwise(0.0)
    drum_c = F.when(c("drum_s") >= STEM_ONSET, 0.30 + c("drum_s") * 0.45).otherwise(0.0)
    beat_c = F.when(on_beat & (drive >= BEAT_GATE), 0.20 + drive * 0.25).otherwise(0.0)

    def bonus(condition: Column, amount: float) -> Column:
        return F.when(condition, amount).otherwise(0.0)

    strongest = F.greatest(c("onset_eff"), c("sp"), c("drum_s"))
    confidence = unit(
        F.greatest(onset_c, spectral_c, drum_c, beat_c)
        + bonus((onset_c > 0) & (spectral_c > 0), 0.10)
        + bonus((drum_c > 0) & ((onset_c > 0) | (spectral_c > 0)), 0.10)
        + bonus(c("activity") >= ACTIVE, 0.05)
        + bonus(on_beat & (c("bass_s") >= STEM_ONSET), 0.05)
        + bonus((F.greatest(onset_c, spectral_c, drum_c) > 0) & (c("acc_s") >= ACCOMPANIMENT_GATE), 0.04)
        + c("margin") * 0.10
        + F.when(c("transient_p75") > 0, F.least(F.lit(1.0), strongest / c("transient_p75")) * 0.05).otherwise(0.0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(c("onset"), "onset"),
            F.when(c("sp") >= SPECTRAL_MINIMUM, "spectral"),
            F.when(c("drum_s") >= STEM_ONSET, "stem:drum-onset"),
            F.when((c("drum_s") >= STEM_ONSET) & (c("onset") | (c("sp") >= SPECTRAL_GATE)), "stem:drum-agreement"),
            F.when((strongest > 0) & (c("acc_s") >= ACCOMPANIMENT_GATE), "stem:accompaniment-support"),
            F.when(c("downbeat"), "downbeat").when(c("beat"), "beat"),
            F.when(on_beat & (c("bass_s") >= STEM_ONSET), "stem:bass-beat"),
            F.when(factor != 1.0, F.concat(F.lit("role:"), c("role"))),
        )
    )
    backed = (F.greatest(c("onset_eff"), c("drum_raw")) >= ONSET_GATE) | (
        c("spectral_peak") & (c("spectral") >= SPECTRAL_GATE)
    )
    scored = rows.withColumn("hit", hit).filter(c("hit") >= HIT_MINIMUM)
    return scored.select(
        *[n for n in rows.columns if n not in ("_moving", "sp", "acc_s", "bass_s", "drum_s")],
        c("acc_s"),
        c("bass_s"),
        round_half_even(c("hit"), 6).alias("hit"),
        round_half_even(confidence, 6).alias("confidence"),
        reasons.alias("reasons"),
        backed.alias("backed"),
    )


def bar_salience(peaks: DataFrame, points: DataFrame, ticks: int = 48) -> DataFrame:
    """Confidence of a bar and why it cannot be used, if so."""
    primary = c("onset") | (c("drum_raw") >= STEM_ONSET)
    grid = peaks.groupBy(*BAR).agg(
        (flag_sum(c("activity") >= ACTIVE) / F.lit(ticks)).alias("_active"),
        flag_sum(primary).alias("_onsets"),
        F.max("edge").alias("_edge"),
        F.max(c("silent")).alias("_silent"),
        F.max("_moving").alias("_moving"),
    )
    found = points.groupBy(*BAR).agg(
        F.count(F.lit(1)).alias("point_count"),
        F.avg("confidence").alias("_mean"),
        flag_sum(c("backed")).alias("backed_count"),
    )
    joined = grid.join(found, list(BAR), "left").fillna({"point_count": 0, "backed_count": 0})
    silenced = c("_edge") | (c("_silent") & ~c("_moving"))
    confidence = F.when(c("point_count") == 0, 0.0).otherwise(
        unit(
            c("_mean") * 0.65
            + c("backed_count") / c("point_count") * 0.15
            + F.least(F.lit(1.0), c("backed_count") / 4) * 0.10
            + F.least(F.lit(1.0), c("_active") / 0.25) * 0.10
        )
    )
    reason = (
        F.when(c("_edge"), "edge-silence")
        .when(silenced, "silent-bar")
        .when(c("point_count") == 0, "no-rhythmic-evidence")
        .when(c("backed_count") == 0, "beat-skeleton-only")
        .when(confidence < USABLE, "low-confidence")
    )
    return joined.select(
        *BAR,
        "point_count",
        "backed_count",
        round_half_even(F.when(silenced, 0.0).otherwise(c("_active")), 6).alias("active_ratio"),
        F.when(silenced, 0).otherwise(c("_onsets")).alias("onset_evidence_count"),
        round_half_even(confidence, 6).alias("bar_confidence"),
        reason.alias("fallback_reason"),
    )


def accent_scores(points: DataFrame) -> DataFrame:
    """Accent score and reasons on top of the hits.

    Bar context: role, phrase_position, boundary_confidence, energy_delta, start_reason.
    """
    first = c("tick") == F.min("tick").over(Window.partitionBy(*BAR))
    rows = points.withColumn("_first", first).withColumn("_vocal", stem_strength(c("vocal"), c("vocal_activity")))
    strong = c("onset_peak") & (c("onset_eff") >= STRONG_ONSET)
    start = c("_first") & c("start_reason").isNotNull()
    rising = c("_first") & (c("energy_delta") > 0.10)
    ending = c("phrase_position").isin("phrase_end", "song_end") | (c("role") == "cadence")
    vocal = c("_first") & (c("_vocal") >= VOCAL_GATE) & (c("start_reason").isNotNull() | ending)
    highlight = (c("acc_s") >= ACCOMPANIMENT_GATE) & c("role").isin("build_up", "peak", "fill", "cadence")
    drums = c("drum_raw") >= STRONG_ONSET
    low = c("spectral_peak") & (c("low") >= SPECTRAL_MINIMUM)

    def at_least(condition: Column, value: Column | float) -> Column:
        return F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(0.0)

    early = F.greatest(
        at_least(c("downbeat"), 0.58), at_least(c("hint"), 0.50), at_least(strong, 0.45 + c("onset_eff") * 0.45)
    )
    lifted = F.when(c("downbeat") & strong, unit(early + 0.10)).otherwise(early)
    raw = F.greatest(
        lifted,
        at_least(drums, 0.35 + c("drum_raw") * 0.45),
        at_least(low, 0.35 + c("low") * 0.40),
        at_least(start, 0.50 + c("boundary_confidence") * 0.25),
        at_least(rising, 0.35 + c("energy_delta") * 0.35),
        at_least(vocal, 0.25 + c("_vocal") * 0.20),
        at_least(highlight, 0.24 + c("acc_s") * 0.18),
    )
    factor = by_role(ACCENT_FACTORS)
    shaped = F.when((raw >= ACCENT_MINIMUM) & (factor != 1.0), unit(raw * factor)).otherwise(raw)
    kept = shaped >= ACCENT_MINIMUM
    reasons = F.array_compact(
        F.array(
            F.when(c("downbeat"), "accent:downbeat"),
            F.when(c("hint"), "accent:hint"),
            F.when(strong, "accent:onset-peak"),
            F.when(c("downbeat") & strong, "accent:downbeat-onset"),
            F.when(drums, "accent:drum-onset"),
            F.when(low, "accent:low-attack"),
            F.when(start, F.concat(F.lit("accent:"), c("start_reason"))),
            F.when(rising, "accent:energy-rise"),
            F.when(vocal, "accent:vocal-context"),
            F.when(highlight, "accent:accompaniment-highlight"),
            F.when((raw >= ACCENT_MINIMUM) & (factor != 1.0), F.concat(F.lit("accent:role:"), c("role"))),
        )
    )
    return rows.select(
        *[n for n in points.columns if n != "reasons"],
        F.when(kept, F.concat("reasons", reasons)).otherwise(c("reasons")).alias("reasons"),
        F.when(kept, round_half_even(shaped, 6)).otherwise(0.0).alias("accent"),
    )


def class_scores(points: DataFrame, beat: int = 12) -> DataFrame:
    """Leaning of each point towards the low or high note class."""
    low, mid, high = c("low"), c("mid"), c("high")
    is_low = c("spectral_peak") & (low >= ATTACK_GATE) & (low - F.greatest(mid, high) >= DOMINANCE)
    is_high = ~is_low & c("spectral_peak") & (high >= ATTACK_GATE) & (high - F.greatest(low, mid) >= DOMINANCE)
    bass = c("bass_s") >= BASS_GATE
    bass_cue = F.least(F.lit(0.40), 0.18 + c("bass_s") * 0.22)
    bass_cue = F.when(c("downbeat"), F.least(F.lit(0.45), bass_cue + 0.05)).otherwise(bass_cue)
    zero = F.lit(0.0)
    don = F.greatest(
        F.when(is_low, low * 0.65).otherwise(zero),
        F.when(bass, bass_cue).otherwise(zero),
        F.when(c("downbeat"), 0.28).otherwise(zero),
    )
    percussive = is_high & (c("percussive_ratio") >= PERCUSSIVE_GATE)
    offbeat = c("tick") % beat == beat // 2
    ka = F.when(is_high, high * 0.55).otherwise(zero)
    cap = F.lit(PREFERENCE_CAP)
    ka = F.when(percussive, F.least(cap, ka + high * (0.10 + c("percussive_ratio") * 0.20))).otherwise(ka)
    ka = F.when(offbeat, F.greatest(ka, F.lit(0.24))).otherwise(ka)
    bright = percussive & (c("brightness") >= 0.55)
    ka = F.when(bright, F.least(cap, ka + (c("brightness") - 0.55) * 0.08)).otherwise(ka)
    reasons = F.array_compact(
        F.array(
            F.when(is_low, "color:low"),
            F.when(is_high, "color:high"),
            F.when(percussive, "color:percussive-high"),
            F.when(bass, "color:bass-onset"),
            F.when(c("downbeat"), "color:downbeat"),
            F.when(offbeat, "color:offbeat"),
            F.when(bright, "color:bright-percussive"),
        )
    )
    return points.select(
        *[n for n in points.columns if n != "reasons"],
        F.concat("reasons", reasons).alias("reasons"),
        round_half_even(F.least(cap, don), 6).alias("don_preference"),
        round_half_even(F.least(cap, ka), 6).alias("ka_preference"),
    )


def bursts(peaks: DataFrame, points: DataFrame, bars: DataFrame, ticks: int = 48) -> DataFrame:
    """Bars whose second half bursts against the first half and the bar before.

    ``bars`` carry the bar context and are one row per bar of a track.
    """
    half = ticks // 2
    second = c("tick") >= half
    primary = c("onset") | (c("drum_raw") >= STEM_ONSET)
    drums = c("drum_raw") >= STEM_ONSET
    lively = second & (primary | (c("flux") >= BURST_TICK_GATE))
    halves = peaks.groupBy(*BAR).agg(
        flag_sum(~second & primary).alias("o1"),
        flag_sum(second & primary).alias("o2"),
        F.max(F.when(~second, c("flux")).otherwise(0.0)).alias("f1"),
        F.max(F.when(second, c("flux")).otherwise(0.0)).alias("f2"),
        flag_sum(~second & drums).alias("d1"),
        flag_sum(second & drums).alias("d2"),
        flag_sum(c("onset")).alias("onsets"),
        flag_sum(lively).alias("lively"),
        F.min(F.when(lively, c("tick"))).alias("start_tick"),
        F.max(F.when(lively, c("tick"))).alias("end_tick"),
    )
    pointed = points.select(*BAR).distinct()
    order = Window.partitionBy("track").orderBy("bar")
    context = bars.join(halves, list(BAR)).select(
        *bars.columns,
        *[n for n in halves.columns if n not in BAR],
        F.lag("percussive_ratio").over(order).alias("prev_percussive"),
        F.lag("onsets").over(order).alias("prev_onsets"),
        F.lead("role").over(order).alias("next_role"),
        F.lead("section_id").over(order).alias("next_section"),
    )
    rows = context.join(pointed, list(BAR)).filter(~c("silent"))
    r1, r2 = c("o1") / half, c("o2") / (ticks - half)
    floor_rate = F.greatest(r2, F.lit(1.0 / ticks))
    density = unit(F.greatest(F.lit(0.0), r2 - r1) / floor_rate * F.least(F.lit(1.0), c("o2") / 4))
    flux = unit(
        F.greatest(F.lit(0.0), c("f2") - F.greatest(c("f1"), F.lit(FLUX_GATE * 0.5))) / max(1.0 - FLUX_GATE * 0.5, 0.01)
    )
    drum_rise = unit(F.greatest(F.lit(0), c("d2") - c("d1")) / 4)
    support = F.least(F.lit(1.0), c("lively") / 4)
    percussive = F.coalesce(
        unit(F.greatest(F.lit(0.0), c("percussive_ratio") - c("prev_percussive")) / 0.6), F.lit(0.0)
    )
    before = F.coalesce(c("prev_onsets") / ticks, r1)
    contrast = unit(F.greatest(F.lit(0.0), r2 - F.greatest(r1, before)) / floor_rate)
    cues = rows.select(
        "*",
        density.alias("density_cue"),
        flux.alias("flux_cue"),
        drum_rise.alias("drum_cue"),
        percussive.alias("percussive_cue"),
        contrast.alias("contrast_cue"),
        support.alias("support"),
    )
    core = ((c("o2") >= 3) & (c("density_cue") >= 0.20)) | (
        (c("lively") >= 2) & (c("f2") >= FLUX_GATE) & (c("flux_cue") >= 0.20)
    )
    ending = c("phrase_position").isin("phrase_end", "song_end")
    cadence = c("role") == "cadence"
    new_section = F.coalesce(c("section_id") != c("next_section"), F.lit(False))
    lifted = F.coalesce(c("next_role").isin("peak", "drop"), F.lit(False))

    def amount(condition: Column, value: Column | float) -> Column:
        return F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(0.0)

    bonus = (
        amount(ending, 0.06 + c("boundary_confidence") * 0.04)
        + amount(cadence, 0.05 + c("transition_confidence") * 0.03)
        + amount(new_section, 0.05)
        + amount(lifted, 0.05)
    )
    names = ("density_cue", "flux_cue", "drum_cue", "percussive_cue", "contrast_cue")
    active = sum((c(n) > 0).cast("int") for n in names[1:]) + (c(names[0]) > 0).cast("int")
    confidence = unit(
        c("support") * 0.40
        + F.greatest(c("density_cue"), c("flux_cue")) * 0.35
        + F.least(F.lit(1.0), active / 3) * 0.25
    )
    score = unit(
        c("density_cue") * 0.40
        + c("flux_cue") * 0.25
        + c("drum_cue") * 0.15
        + c("percussive_cue") * 0.15
        + c("contrast_cue") * 0.10
        + c("support") * 0.10
        + bonus
    )
    labels = {
        "density_cue": "burst:onset-density",
        "flux_cue": "burst:spectral-flux",
        "drum_cue": "burst:drum-onset-rise",
        "percussive_cue": "burst:percussive-rise",
        "contrast_cue": "burst:stable-contrast",
    }
    reasons = F.array_compact(
        F.array(
            *[F.when(c(n) > 0, label) for n, label in labels.items()],
            F.when(ending, "burst:phrase-end"),
            F.when(cadence, "burst:cadence"),
            F.when(new_section, "burst:next-section"),
            F.when(lifted, "burst:next-highlight"),
        )
    )
    return cues.filter(core & (c("lively") > 0)).select(
        *BAR,
        round_half_even(score, 6).alias("burst_score"),
        round_half_even(confidence, 6).alias("burst_confidence"),
        "start_tick",
        "end_tick",
        F.array_join(reasons, " ").alias("burst_reasons"),
    )


def reliable_burst() -> Column:
    return (c("burst_score") >= BURST_SCORE) & (c("burst_confidence") >= BURST_CONFIDENCE)


def burst_span(resolution: int, ticks: int = 48) -> tuple[Column, Column]:
    """Start and end tick of a reliable burst on the output step; null when none fits."""
    step = ticks // resolution
    begin = F.greatest(F.lit(ticks // 2), c("start_tick"))
    start = F.floor((begin + step - 1) / step) * step
    latest = ticks - step
    ended = F.least(F.lit(latest), F.floor(c("end_tick") / step) * step)
    ended = F.when(ended <= start, F.least(F.lit(latest), start + step)).otherwise(ended)
    fits = reliable_burst() & (c("end_tick") > begin) & (start < latest) & (ended > start)
    return F.when(fits, start).cast("int"), F.when(fits, ended).cast("int")


# Candidate classes in order of priority and their lattice bonus.
KINDS = ("strong-transient", "transient", "rhythmic-skeleton", "structure-highlight", "weak-evidence")
LATTICE_BONUS = (0.75, 0.40, 0.20, 0.10, 0.0)


def candidates(points: DataFrame, salience: DataFrame, step: int = 1) -> DataFrame:
    """Classified and scored points, ranked inside their bar.

    ``points`` come from ``class_scores``; ``salience`` from ``bar_salience``. Points of a
    bar are at most one per tick, and only ticks on the step are kept.
    """
    rows = points.filter(c("tick") % step == 0).join(salience.select(*BAR, "bar_confidence"), list(BAR))
    usable = (c("confidence") >= USABLE) & (c("bar_confidence") >= USABLE)

    def has(reason: str) -> Column:
        return F.array_contains("reasons", reason)

    transient = has("onset") | has("spectral") | has("stem:drum-onset")
    hinted = F.exists("reasons", lambda r: r.startswith("role:") | r.startswith("accent:"))
    priority = (
        F.when(usable & transient & (c("hit") >= 0.65), 0)
        .when(usable & transient, 1)
        .when(usable & (c("activity") >= ACTIVE) & (has("downbeat") | has("beat")), 2)
        .when(usable & ((c("accent") > 0) | hinted), 3)
        .otherwise(4)
    )
    trust = F.when(c("bar_confidence") > 0, F.least("confidence", "bar_confidence")).otherwise(c("confidence"))
    score = (
        c("hit") * 0.55
        + trust * 0.25
        + c("accent") * 0.10
        + c("activity") * 0.05
        + F.greatest("don_preference", "ka_preference") * 0.05
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    scored = rows.select(
        *rows.columns, priority.alias("priority"), round_half_even(score, 6).alias("score")
    ).withColumn("kind", F.element_at(kinds, c("priority") + 1))
    order = Window.partitionBy(*BAR).orderBy(
        "priority",
        c("score").desc(),
        c("confidence").desc(),
        c("hit").desc(),
        c("accent").desc(),
        "tick",
    )
    return scored.withColumn("rank", F.row_number().over(order)).withColumn("reliable", c("priority") < 4)


def rank_on_step(ranked: DataFrame, step: int) -> DataFrame:
    """Candidates on the ticks of a coarser step, ranked anew."""
    order = Window.partitionBy(*BAR).orderBy("rank")
    return ranked.filter(c("tick") % step == 0).withColumn("rank", F.row_number().over(order))


def accent_candidates(ranked: DataFrame) -> DataFrame:
    """Candidates that carry an accent, ranked by it inside their bar."""
    hinted = F.array_contains("reasons", "accent:downbeat") | F.array_contains("reasons", "accent:hint")
    order = Window.partitionBy(*BAR).orderBy(
        c("accent").desc(), "priority", c("score").desc(), c("confidence").desc(), "tick"
    )
    kept = ranked.filter((c("accent") >= 0.5) & (c("reliable") | hinted))
    return kept.withColumn("accent_rank", F.row_number().over(order))


def quota_topk(ranked: DataFrame, size: int = 16, arbitrary: int = 1, allow_arbitrary: bool = True) -> DataFrame:
    """Best stable candidates plus a few certain off-grid ones, in rank order."""
    stable = stable_tick(c("tick"))
    certain = ~stable & (c("confidence") >= 0.85) & F.array_contains("reasons", "onset")
    rows = ranked.withColumn("_class", F.when(stable, "s").when(certain & F.lit(allow_arbitrary), "a"))
    rows = rows.filter(c("_class").isNotNull())
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*BAR, "_class").orderBy("rank")))
    extra = F.least(
        F.lit(arbitrary), F.sum(F.when(c("_class") == "a", 1).otherwise(0)).over(Window.partitionBy(*BAR))
    )
    kept = rows.withColumn("_extra", extra).filter(
        F.when(c("_class") == "a", c("_r") <= c("_extra")).otherwise(c("_r") <= size - c("_extra"))
    )
    return kept.drop("_class", "_r", "_extra")


def lattice_weight() -> Column:
    bonus = F.element_at(F.array(*[F.lit(b) for b in LATTICE_BONUS]), c("priority") + 1)
    return 0.25 + c("score") + c("confidence") * 0.5 + bonus
