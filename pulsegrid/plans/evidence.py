"""Plans over evidence built from order lines: binning, scores, candidates, bursts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.numeric import round_half_even
from pulsegrid.operators import binning, evidence as ev, meters
from pulsegrid.plans.bindings import BEAT, DAY, HOUR, SECOND, TICKS, bar_spine, dealt, evidence, lines, stage_bars, timeline
from pulsegrid.plans.registry import cte, plan
from pulsegrid.plans.stages import is_small, stage

ROLES = ("stable", "build_up", "peak", "drop", "breakdown", "cadence", "fill", "stable")


def sparse(spark, sf_dir):
    """Evidence points with the accent hint of their bar."""
    points = evidence(spark, sf_dir)
    hints = staged_context(spark, sf_dir).filter("accents IS NOT NULL").select("track", "bar", "accents")
    return points.join(hints, ["track", "bar"]).withColumn("hint", F.array_contains("accents", F.col("tick"))).drop("accents")


def bar_context(spark, sf_dir):
    """Bar context as a staged table."""
    return staged_context(spark, sf_dir).drop("accents")


def staged_context(spark, sf_dir):
    """Bar context with the accents of bars that have points."""
    return stage_bars(spark, sf_dir, "context", lambda: dealt(spark, sf_dir, build_bar_context(spark, sf_dir)))


def build_bar_context(spark, sf_dir):
    """Bar rows with energy, source activity and a rule-made structure context."""
    points = evidence(spark, sf_dir)
    energy = binning.bar_energy(points, ["track"], 16, TICKS, BEAT)
    means = points.groupBy("track", "bar").agg(
        *[
            round_half_even(F.avg(src), 3).alias(out)
            for src, out in (
                ("vocal", "vocal_activity"),
                ("drum", "drum_activity"),
                ("bass", "bass_activity"),
                ("accompaniment", "accompaniment_activity"),
                ("high", "brightness"),
                ("mid", "percussive_ratio"),
            )
        ],
        (F.sum("activity") / TICKS).alias("mean_activity"),
    )
    b = F.col("bar")
    spine = bar_spine(spark, sf_dir)
    last = spine.groupBy("track").agg(F.max("bar").alias("last_bar"))
    numbers = ["energy", "onset_count", "vocal_activity", "drum_activity", "bass_activity", "accompaniment_activity"]
    bars = (
        spine.join(last, ["track"])
        .join(energy, ["track", "bar"], "left")
        .join(means, ["track", "bar"], "left")
        .fillna(0, [*numbers, "brightness", "percussive_ratio", "mean_activity"])
    )
    roles = F.array(*[F.lit(r) for r in ROLES])
    position = (
        F.when(b == F.col("last_bar"), "song_end")
        .when(b % 8 == 0, "phrase_start")
        .when(b % 8 == 7, "phrase_end")
        .otherwise("phrase_middle")
    )
    context = bars.select(
        "track",
        "bar",
        *numbers,
        "brightness",
        "percussive_ratio",
        F.element_at(roles, b % 8 + 1).alias("role"),
        position.alias("phrase_position"),
        F.concat(F.lit("section-"), (F.floor(b / 16) % 3 + 1).cast("string")).alias("section_id"),
        F.floor(b / 8).cast("int").alias("phrase_id"),
        F.when(b % 8 == 7, (b % 5) / 5.0).otherwise(0.0).alias("boundary_confidence"),
        (((b * 7) % 10 - 4) / 10.0).alias("energy_delta"),
        ((b % 4) / 4.0).alias("transition_confidence"),
        F.when(b == 0, "song-start").when(position == "phrase_start", "phrase-start").alias("start_reason"),
        (position == "phrase_end").alias("fill_candidate"),
        "accents",
        binning.silent_bar(F.col("onset_count"), F.col("energy"), F.col("mean_activity")).alias("silent"),
    )
    return binning.edge_runs(context, ["track"], F.col("silent"))


def grid(spark, sf_dir, whole=True):
    return ev.evidence_grid(sparse(spark, sf_dir), bar_context(spark, sf_dir), TICKS, BEAT, whole)


# Most of a staged table's time is the writing of its columns: those that nothing reads are
# left out (strength is onset_eff), and of a hit point only what later scores read is kept.
_UNREAD = ("onset_count", "section_id", "phrase_id", "transition_confidence", "fill_candidate", "strength")
_POINT = (
    "track", "bar", "tick", "onset_eff", "onset_peak", "spectral_peak", "drum_raw", "activity", "low", "mid", "high", "vocal", "vocal_activity",
    "brightness", "percussive_ratio", "role", "phrase_position", "boundary_confidence", "energy_delta", "start_reason", "hint", "downbeat",
    "acc_s", "bass_s", "hit", "confidence", "reasons", "backed",
)


def peaks(spark, sf_dir):
    """Evidence with peak flags on all ticks that hold any and on the beats, staged: it feeds
    the scores, the bars and the bursts."""
    return stage_bars(spark, sf_dir, "peaks", lambda: ev.with_peaks(grid(spark, sf_dir, whole=False)).drop(*_UNREAD))


def scored(spark, sf_dir):
    """(peaks, hit points)"""
    found = peaks(spark, sf_dir)
    reference = stage(spark, sf_dir, "transients", lambda: ev.transient_reference(found))
    # One number a track: sent to the peaks if it is small, rather than these to it.
    def build():
        if is_small(reference):
            return ev.hit_scores(found, F.broadcast(reference)).select(*_POINT)
        return dealt(spark, sf_dir, ev.hit_scores(found, reference).select(*_POINT))

    return found, stage_bars(spark, sf_dir, "hits", build)


def classed(spark, sf_dir):
    """(peaks, points with hit, accent and class, bar salience)"""
    found, points = scored(spark, sf_dir)
    return found, ev.class_scores(ev.accent_scores(points), BEAT), ev.bar_salience(found, points, TICKS)


def all_candidates(spark, sf_dir):
    """Classified candidates of every tick, staged."""

    def build():
        _, points, salience = classed(spark, sf_dir)
        kept = ["track", "bar", "tick", "hit", "confidence", "accent", "activity", "don_preference", "ka_preference", "reasons"]
        return ev.candidates(points.select(*kept), salience)

    return stage_bars(spark, sf_dir, "candidates", build)


def ranked(spark, sf_dir, step=1):
    """Ranked candidates; a coarser step re-ranks the ticks that stay."""
    found = all_candidates(spark, sf_dir)
    return found if step == 1 else ev.rank_on_step(found, step)


# SQL side ------------------------------------------------------------------------------


def _r(x, n):
    if n < 9:
        x = f"round_even(({x}) * 1000000000, 0) / 1000000000"
    return f"(round_even(({x}) * {10**n}, 0) / {10**n})"


def _unit(x):
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


def _stem(o, a):
    return f"(CASE WHEN {o} < 0.18::DOUBLE OR {a} < 0.08::DOUBLE THEN 0.0::DOUBLE ELSE {_unit(f'{o} * (0.55::DOUBLE + {a} * 0.45::DOUBLE)')} END)"


def _stable(t):
    return f"({t} % 2 = 0 OR {t} % 3 = 0)"


def _drum(sp):
    s = _stem("drum", "drum_activity")
    return (
        f"(CASE WHEN {s} <= 0 THEN 0.0::DOUBLE WHEN onset OR {sp} >= 0.12::DOUBLE THEN {_unit(f'{s} + 0.12::DOUBLE')} "
        f"WHEN NOT {_stable('tick')} THEN 0.0::DOUBLE ELSE least(0.45::DOUBLE, {s} * 0.75::DOUBLE) END)"
    )


def _case(expr, table):
    return f"(CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " ELSE 1.0::DOUBLE END)"


def _if(cond, value):
    return f"CASE WHEN {cond} THEN {value} ELSE 0.0::DOUBLE END"


cte(
    "be",
    f"""SELECT track, bar, {_r("greatest(least(1, sum(CASE WHEN onset THEN strength ELSE 0 END) / 16), least(1, sum(activity) / 48))", 3)} AS energy,
  sum(onset::INT)::BIGINT AS onset_count, max(CASE WHEN onset THEN strength END) AS best, max((onset AND tick % 12 = 0)::INT) AS has_beat,
  {_r("avg(vocal)", 3)} AS vocal_activity, {_r("avg(drum)", 3)} AS drum_activity, {_r("avg(bass)", 3)} AS bass_activity,
  {_r("avg(accompaniment)", 3)} AS accompaniment_activity, {_r("avg(high)", 3)} AS brightness, {_r("avg(mid)", 3)} AS percussive_ratio,
  sum(activity) / 48 AS mean_activity FROM evid GROUP BY track, bar""",
    "evid",
)
cte(
    "ctx0",
    """SELECT s.track, s.bar, max(s.bar) OVER (PARTITION BY s.track) AS last_bar, coalesce(energy, 0) AS energy, coalesce(onset_count, 0) AS onset_count,
  coalesce(vocal_activity, 0) AS vocal_activity, coalesce(drum_activity, 0) AS drum_activity, coalesce(bass_activity, 0) AS bass_activity,
  coalesce(accompaniment_activity, 0) AS accompaniment_activity, coalesce(brightness, 0) AS brightness, coalesce(percussive_ratio, 0) AS percussive_ratio,
  ['stable', 'build_up', 'peak', 'drop', 'breakdown', 'cadence', 'fill', 'stable'][s.bar % 8 + 1] AS role,
  'section-' || ((s.bar // 16) % 3 + 1) AS section_id, s.bar // 8 AS phrase_id, CASE WHEN s.bar % 8 = 7 THEN (s.bar % 5) / 5.0::DOUBLE ELSE 0 END AS boundary_confidence,
  ((s.bar * 7) % 10 - 4) / 10.0::DOUBLE AS energy_delta, (s.bar % 4) / 4.0::DOUBLE AS transition_confidence,
  coalesce(onset_count, 0) = 0 AND (coalesce(energy, 0) <= 0.015::DOUBLE OR (coalesce(energy, 0) <= 0.03::DOUBLE AND coalesce(mean_activity, 0) <= 0.05::DOUBLE)) AS silent
FROM spine s LEFT JOIN be ON be.track = s.track AND be.bar = s.bar""",
    "spine",
    "be",
)
cte(
    "ctx",
    """SELECT *, CASE WHEN bar = 0 THEN 'song-start' WHEN phrase_position = 'phrase_start' THEN 'phrase-start' END AS start_reason,
  phrase_position = 'phrase_end' AS fill_candidate,
  NOT EXISTS (SELECT 1 FROM ctx0 z WHERE z.track = c.track AND z.bar <= c.bar AND NOT z.silent) OR NOT EXISTS (SELECT 1 FROM ctx0 z WHERE z.track = c.track AND z.bar >= c.bar AND NOT z.silent) AS edge
FROM (SELECT *, CASE WHEN bar = last_bar THEN 'song_end' WHEN bar % 8 = 0 THEN 'phrase_start' WHEN bar % 8 = 7 THEN 'phrase_end' ELSE 'phrase_middle' END AS phrase_position FROM ctx0) c""",
    "ctx0",
)
cte(
    "dense",
    """SELECT c.*, k.tick, coalesce(e.onset, false) AS onset, CASE WHEN e.onset THEN CASE WHEN e.strength > 0 THEN e.strength ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS strength,
  coalesce(e.onset AND CASE WHEN be.has_beat = 1 THEN k.tick % 12 = 0 ELSE e.strength = be.best END, false) AS hint,
  coalesce(e.activity, 0) AS activity, coalesce(e.low, 0) AS low, coalesce(e.mid, 0) AS mid, coalesce(e.high, 0) AS high, coalesce(e.flux, 0) AS flux,
  coalesce(e.vocal, 0) AS vocal, coalesce(e.drum, 0) AS drum, coalesce(e.bass, 0) AS bass, coalesce(e.accompaniment, 0) AS accompaniment,
  k.tick % 12 = 0 AS beat, k.tick = 0 AS downbeat
FROM ctx c CROSS JOIN (SELECT unnest(range(0, 48))::INTEGER AS tick) k LEFT JOIN evid e ON e.track = c.track AND e.bar = c.bar AND e.tick = k.tick
LEFT JOIN be ON be.track = c.track AND be.bar = c.bar""",
    "ctx",
    "evid",
    "be",
)
cte(
    "pk",
    f"""SELECT *, onset AND strength > coalesce(lag(strength) OVER w, 0) AND strength >= coalesce(lead(strength) OVER w, 0) AS onset_peak,
  spectral >= 0.05::DOUBLE AND (onset OR (NOT coalesce(lag(onset) OVER w, false) AND NOT coalesce(lead(onset) OVER w, false)
    AND spectral > coalesce(lag(spectral) OVER w, 0) AND spectral >= coalesce(lead(spectral) OVER w, 0))) AS spectral_peak,
  {_unit("anyx - greatest(coalesce(lag(anyx) OVER w, 0), coalesce(lead(anyx) OVER w, 0), 0)")} AS margin
FROM (SELECT *, greatest(strength, spectral, drum_raw) AS anyx FROM (SELECT *, {_drum("spectral")} AS drum_raw FROM
  (SELECT *, greatest(low, mid, high, flux * 0.8::DOUBLE) AS spectral, strength AS onset_eff FROM dense)))
WINDOW w AS (PARTITION BY track, bar ORDER BY tick)""",
    "dense",
)
cte(
    "p75",
    """SELECT track, quantile_cont(x, 0.75) AS transient_p75 FROM (
  SELECT track, onset_eff AS x FROM pk WHERE onset_eff >= 0.08::DOUBLE AND NOT edge UNION ALL SELECT track, drum_raw FROM pk WHERE drum_raw >= 0.18::DOUBLE AND NOT edge
  UNION ALL SELECT track, spectral FROM pk WHERE spectral_peak AND spectral >= 0.12::DOUBLE AND NOT edge) GROUP BY track""",
    "pk",
)
_ONB = "(beat OR downbeat)"
_CONF = f"""greatest(onset_c, spectral_c, drum_c, beat_c) + ({_if("onset_c > 0 AND spectral_c > 0", "0.10::DOUBLE")}) + ({_if("drum_c > 0 AND (onset_c > 0 OR spectral_c > 0)", "0.10::DOUBLE")})
  + ({_if("activity >= 0.08::DOUBLE", "0.05::DOUBLE")}) + ({_if(f"{_ONB} AND bass_s >= 0.18::DOUBLE", "0.05::DOUBLE")})
  + ({_if("greatest(onset_c, spectral_c, drum_c) > 0 AND acc_s >= 0.30::DOUBLE", "0.04::DOUBLE")}) + margin * 0.10::DOUBLE
  + CASE WHEN transient_p75 > 0 THEN least(1.0::DOUBLE, greatest(onset_eff, sp, drum_s) / transient_p75) * 0.05::DOUBLE ELSE 0 END"""
cte(
    "hits",
    f"""SELECT * EXCLUDE (hit0), {_r("hit0", 6)} AS hit, {_r(_unit(_CONF), 6)} AS confidence,
  list_filter([CASE WHEN onset THEN 'onset' END, CASE WHEN sp >= 0.05::DOUBLE THEN 'spectral' END, CASE WHEN drum_s >= 0.18::DOUBLE THEN 'stem:drum-onset' END,
    CASE WHEN drum_s >= 0.18::DOUBLE AND (onset OR sp >= 0.12::DOUBLE) THEN 'stem:drum-agreement' END,
    CASE WHEN greatest(onset_eff, sp, drum_s) > 0 AND acc_s >= 0.30::DOUBLE THEN 'stem:accompaniment-support' END,
    CASE WHEN downbeat THEN 'downbeat' WHEN beat THEN 'beat' END, CASE WHEN {_ONB} AND bass_s >= 0.18::DOUBLE THEN 'stem:bass-beat' END,
    CASE WHEN factor <> 1 THEN 'role:' || role END], lambda x: x IS NOT NULL) AS reasons,
  greatest(onset_eff, drum_raw) >= 0.08::DOUBLE OR (spectral_peak AND spectral >= 0.12::DOUBLE) AS backed
FROM (SELECT *, {_unit("greatest(transient, skeleton) * factor")} AS hit0 FROM (
  SELECT *, {_case("role", ev.HIT_FACTORS)} AS factor,
    greatest({_if("onset_eff >= 0.08::DOUBLE", "onset_eff")}, ({_if("sp >= 0.12::DOUBLE", "sp")}) * 0.75::DOUBLE, drum_s) AS transient,
    CASE WHEN NOT {_ONB} OR drive < 0.08::DOUBLE THEN 0.0::DOUBLE ELSE {_unit("(CASE WHEN downbeat THEN 0.26::DOUBLE ELSE 0.20::DOUBLE END) * drive + bass_s * (CASE WHEN downbeat THEN 0.10::DOUBLE ELSE 0.06::DOUBLE END)")} END AS skeleton,
    {_if("onset_eff >= 0.08::DOUBLE", "0.45::DOUBLE + onset_eff * 0.45::DOUBLE")} AS onset_c, {_if("sp >= 0.12::DOUBLE", "0.30::DOUBLE + sp * 0.45::DOUBLE")} AS spectral_c,
    {_if("drum_s >= 0.18::DOUBLE", "0.30::DOUBLE + drum_s * 0.45::DOUBLE")} AS drum_c, {_if(f"{_ONB} AND drive >= 0.08::DOUBLE", "0.20::DOUBLE + drive * 0.25::DOUBLE")} AS beat_c
  FROM (SELECT *, {_drum("sp")} AS drum_s, {_stem("bass", "bass_activity")} AS bass_s, {_stem("accompaniment", "accompaniment_activity")} AS acc_s, greatest(activity, {_unit("energy")}) AS drive
    FROM (SELECT pk.*, transient_p75, CASE WHEN spectral_peak THEN spectral ELSE 0.0::DOUBLE END AS sp,
      max((onset OR spectral >= 0.05::DOUBLE OR drum_raw >= 0.18::DOUBLE)::INT) OVER (PARTITION BY track, bar) AS moving FROM pk LEFT JOIN p75 USING (track))
    WHERE NOT edge AND NOT (silent AND moving = 0)))) WHERE hit0 >= 0.02::DOUBLE""",
    "pk",
    "p75",
)
cte(
    "sal",
    f"""SELECT track, bar, point_count, backed_count, {_r("CASE WHEN quiet THEN 0 ELSE active END", 6)} AS active_ratio, CASE WHEN quiet THEN 0 ELSE onsets END AS onset_evidence_count,
  {_r("conf", 6)} AS bar_confidence, CASE WHEN edge THEN 'edge-silence' WHEN quiet THEN 'silent-bar' WHEN point_count = 0 THEN 'no-rhythmic-evidence'
    WHEN backed_count = 0 THEN 'beat-skeleton-only' WHEN conf < 0.45::DOUBLE THEN 'low-confidence' END AS fallback_reason
FROM (SELECT *, edge OR (silent AND NOT moving) AS quiet, CASE WHEN point_count = 0 THEN 0 ELSE {_unit("mean * 0.65::DOUBLE + backed_count / point_count::DOUBLE * 0.15::DOUBLE + least(1.0::DOUBLE, backed_count / 4.0::DOUBLE) * 0.10::DOUBLE + least(1.0::DOUBLE, active / 0.25::DOUBLE) * 0.10::DOUBLE")} END AS conf
  FROM (SELECT g.*, coalesce(h.n, 0) AS point_count, coalesce(h.b, 0) AS backed_count, h.mean FROM
    (SELECT track, bar, avg((activity >= 0.08::DOUBLE)::INT) AS active, sum((onset OR drum_raw >= 0.18::DOUBLE)::INT)::BIGINT AS onsets, bool_or(edge) AS edge, bool_or(silent) AS silent,
      bool_or(onset OR spectral >= 0.05::DOUBLE OR drum_raw >= 0.18::DOUBLE) AS moving FROM pk GROUP BY track, bar) g
    LEFT JOIN (SELECT track, bar, count(*) AS n, sum(backed::INT)::BIGINT AS b, avg(confidence) AS mean FROM hits GROUP BY track, bar) h ON h.track = g.track AND h.bar = g.bar))""",
    "pk",
    "hits",
)
_STRONG = "(onset_peak AND onset_eff >= 0.55::DOUBLE)"
_START = "(is_first AND start_reason IS NOT NULL)"
_RISE = "(is_first AND energy_delta > 0.10::DOUBLE)"
_VOC = "(is_first AND voc >= 0.35::DOUBLE AND (start_reason IS NOT NULL OR phrase_position IN ('phrase_end', 'song_end') OR role = 'cadence'))"
_HIGH = "(acc_s >= 0.30::DOUBLE AND role IN ('build_up', 'peak', 'fill', 'cadence'))"
cte(
    "accents",
    f"""SELECT * EXCLUDE (reasons, raw, shaped, early, afactor, is_first, voc), CASE WHEN shaped >= 0.15::DOUBLE THEN {_r("shaped", 6)} ELSE 0.0::DOUBLE END AS accent,
  CASE WHEN shaped >= 0.15::DOUBLE THEN list_concat(reasons, list_filter([CASE WHEN downbeat THEN 'accent:downbeat' END, CASE WHEN hint THEN 'accent:hint' END, CASE WHEN {_STRONG} THEN 'accent:onset-peak' END,
    CASE WHEN downbeat AND {_STRONG} THEN 'accent:downbeat-onset' END, CASE WHEN drum_raw >= 0.55::DOUBLE THEN 'accent:drum-onset' END, CASE WHEN spectral_peak AND low >= 0.05::DOUBLE THEN 'accent:low-attack' END,
    CASE WHEN {_START} THEN 'accent:' || start_reason END, CASE WHEN {_RISE} THEN 'accent:energy-rise' END, CASE WHEN {_VOC} THEN 'accent:vocal-context' END,
    CASE WHEN {_HIGH} THEN 'accent:accompaniment-highlight' END, CASE WHEN raw >= 0.15::DOUBLE AND afactor <> 1 THEN 'accent:role:' || role END], lambda x: x IS NOT NULL)) ELSE reasons END AS reasons
FROM (SELECT *, CASE WHEN raw >= 0.15::DOUBLE AND afactor <> 1 THEN {_unit("raw * afactor")} ELSE raw END AS shaped FROM (
  SELECT *, greatest(CASE WHEN downbeat AND {_STRONG} THEN {_unit("early + 0.10::DOUBLE")} ELSE early END, {_if("drum_raw >= 0.55::DOUBLE", "0.35::DOUBLE + drum_raw * 0.45::DOUBLE")},
    {_if("spectral_peak AND low >= 0.05::DOUBLE", "0.35::DOUBLE + low * 0.40::DOUBLE")}, {_if(_START, "0.50::DOUBLE + boundary_confidence * 0.25::DOUBLE")},
    {_if(_RISE, "0.35::DOUBLE + energy_delta * 0.35::DOUBLE")}, {_if(_VOC, "0.25::DOUBLE + voc * 0.20::DOUBLE")}, {_if(_HIGH, "0.24::DOUBLE + acc_s * 0.18::DOUBLE")}) AS raw
  FROM (SELECT *, greatest({_if("downbeat", "0.58::DOUBLE")}, {_if("hint", "0.50::DOUBLE")}, {_if(_STRONG, "0.45::DOUBLE + onset_eff * 0.45::DOUBLE")}) AS early FROM (
    SELECT *, {_case("role", ev.ACCENT_FACTORS)} AS afactor, tick = min(tick) OVER (PARTITION BY track, bar) AS is_first, {_stem("vocal", "vocal_activity")} AS voc FROM hits))))""",
    "hits",
)
_LOW = "(spectral_peak AND low >= 0.35::DOUBLE AND low - greatest(mid, high) >= 0.12::DOUBLE)"
_HI = f"(NOT {_LOW} AND spectral_peak AND high >= 0.35::DOUBLE AND high - greatest(low, mid) >= 0.12::DOUBLE)"
_PERC = f"({_HI} AND percussive_ratio >= 0.35::DOUBLE)"
_OFF = "(tick % 12 = 6)"
_BASS = "least(0.40::DOUBLE, 0.18::DOUBLE + bass_s * 0.22::DOUBLE)"
_KA1 = f"({_if(_HI, 'high * 0.55::DOUBLE')})"
_KA2 = f"(CASE WHEN {_PERC} THEN least(0.75::DOUBLE, {_KA1} + high * (0.10::DOUBLE + percussive_ratio * 0.20::DOUBLE)) ELSE {_KA1} END)"
_KA3 = f"(CASE WHEN {_OFF} THEN greatest({_KA2}, 0.24::DOUBLE) ELSE {_KA2} END)"
_KA4 = f"(CASE WHEN {_PERC} AND brightness >= 0.55::DOUBLE THEN least(0.75::DOUBLE, {_KA3} + (brightness - 0.55::DOUBLE) * 0.08::DOUBLE) ELSE {_KA3} END)"
cte(
    "classes",
    f"""SELECT * EXCLUDE (reasons), list_concat(reasons, list_filter([CASE WHEN {_LOW} THEN 'color:low' END, CASE WHEN {_HI} THEN 'color:high' END, CASE WHEN {_PERC} THEN 'color:percussive-high' END,
    CASE WHEN bass_s >= 0.25::DOUBLE THEN 'color:bass-onset' END, CASE WHEN downbeat THEN 'color:downbeat' END, CASE WHEN {_OFF} THEN 'color:offbeat' END,
    CASE WHEN {_PERC} AND brightness >= 0.55::DOUBLE THEN 'color:bright-percussive' END], lambda x: x IS NOT NULL)) AS reasons,
  {_r(f"least(0.75::DOUBLE, greatest({_if(_LOW, 'low * 0.65::DOUBLE')}, {_if('bass_s >= 0.25::DOUBLE', f'CASE WHEN downbeat THEN least(0.45::DOUBLE, {_BASS} + 0.05::DOUBLE) ELSE {_BASS} END')}, {_if('downbeat', '0.28::DOUBLE')}))", 6)} AS don_preference,
  {_r(f"least(0.75::DOUBLE, {_KA4})", 6)} AS ka_preference FROM accents""",
    "accents",
)
_TR = "(list_contains(reasons, 'onset') OR list_contains(reasons, 'spectral') OR list_contains(reasons, 'stem:drum-onset'))"
_US = "(confidence >= 0.45::DOUBLE AND bar_confidence >= 0.45::DOUBLE)"
cte(
    "cand",
    f"""SELECT *, row_number() OVER (PARTITION BY track, bar ORDER BY priority, score DESC, confidence DESC, hit DESC, accent DESC, tick) AS rank, priority < 4 AS reliable,
  ['strong-transient', 'transient', 'rhythmic-skeleton', 'structure-highlight', 'weak-evidence'][priority + 1] AS kind FROM (
  SELECT *, CASE WHEN {_US} AND {_TR} AND hit >= 0.65::DOUBLE THEN 0 WHEN {_US} AND {_TR} THEN 1
    WHEN {_US} AND activity >= 0.08::DOUBLE AND (list_contains(reasons, 'downbeat') OR list_contains(reasons, 'beat')) THEN 2
    WHEN {_US} AND (accent > 0 OR len(list_filter(reasons, lambda r: starts_with(r, 'role:') OR starts_with(r, 'accent:'))) > 0) THEN 3 ELSE 4 END AS priority,
    {_r("hit * 0.55::DOUBLE + (CASE WHEN bar_confidence > 0 THEN least(confidence, bar_confidence) ELSE confidence END) * 0.25::DOUBLE + accent * 0.10::DOUBLE + activity * 0.05::DOUBLE + greatest(don_preference, ka_preference) * 0.05::DOUBLE", 6)} AS score
  FROM (SELECT k.*, s.bar_confidence FROM classes k JOIN sal s ON s.track = k.track AND s.bar = k.bar))""",
    "classes",
    "sal",
)


@plan(
    "bar_grid",
    """
    SELECT track, CAST(a // 48 AS INTEGER) AS bar, CAST(a % 48 AS INTEGER) AS tick, max(value) AS value, count(*) AS event_count
    FROM (SELECT track, value, round_even((t - 10800000000) / 450000000.0::DOUBLE, 0)::BIGINT AS a FROM ev WHERE t >= 10800000000) GROUP BY ALL
    """,
    ("ev",),
)
def bar_grid(spark, sf_dir):
    return binning.bar_grid(
        timeline(spark, sf_dir), ["track"], F.col("t"), F.col("value"), start=3 * HOUR, tick=450 * SECOND, ticks=48
    )


@plan(
    "meter_grid",
    """
    WITH m AS (SELECT track, value, t, CASE track % 4 WHEN 0 THEN '4/4' WHEN 1 THEN '3/4' WHEN 2 THEN '6/8' ELSE '5/4' END AS meter FROM ev),
    k AS (SELECT *, CASE meter WHEN '4/4' THEN 48 WHEN '3/4' THEN 36 WHEN '6/8' THEN 36 END AS ticks, round_even((t - 10800000000) / 450000000.0::DOUBLE, 0)::BIGINT AS a FROM m),
    p AS (SELECT track, meter, CAST(a // ticks AS INTEGER) AS bar, CAST(a % ticks AS INTEGER) AS tick, value FROM k WHERE ticks IS NOT NULL AND t >= 10800000000)
    SELECT track, meter, bar, tick, CASE meter WHEN '6/8' THEN tick % 18 = 0 ELSE tick % 12 = 0 END AS is_beat, NULL::VARCHAR AS issue, max(value) AS value, count(*) AS event_count FROM p GROUP BY ALL
    UNION ALL SELECT track, meter, NULL, NULL, false, 'unknown-meter', NULL, count(*) FROM k WHERE ticks IS NULL GROUP BY track, meter
    """,
    ("ev",),
)
def meter_grid(spark, sf_dir):
    k = F.col("track") % 4
    meter = F.when(k == 0, "4/4").when(k == 1, "3/4").when(k == 2, "6/8").otherwise("5/4")
    events = timeline(spark, sf_dir).withColumn("meter", meter)
    return meters.meter_grid(events, ["track"], "meter", F.col("t"), F.col("value"), start=3 * HOUR, quarter=12 * 450 * SECOND)


@plan(
    "frames",
    """
    WITH a AS (SELECT track, t // 86400000000 AS day, list(value ORDER BY t, event_id) AS v, list(event_id % 7 ORDER BY t, event_id) FILTER (kind <> 'error') AS w FROM ev GROUP BY ALL),
    p AS (SELECT track, day, v, w, unnest(range(1, len(v) + 1)) AS i FROM a)
    SELECT track, day, (i - 1)::INTEGER AS frame, (i - 1) * 512 / 22050.0::DOUBLE AS time_s, least(1.0::DOUBLE, v[i] / 100) AS loud, coalesce(least(1.0::DOUBLE, greatest(0, (w[i] - 2) / 4.0::DOUBLE)), 0) AS shifted FROM p
    """,
    ("ev",),
)
def frames(spark, sf_dir):
    def values(condition, value):
        rows = F.array_sort(F.collect_list(F.when(condition, F.struct("t", "event_id", value.alias("x")))))
        return F.transform(rows, lambda r: r["x"])

    events = timeline(spark, sf_dir).withColumn("x", F.col("value") / 100)
    arrays = events.groupBy("track", F.floor(F.col("t") / DAY).alias("day")).agg(
        values(F.lit(True), F.col("x")).alias("loud"),
        values(F.col("kind") != "error", (F.col("event_id") % 7 - 2) / 4).alias("shifted"),
    )
    return binning.expand_frames(arrays, ["track", "day"], ["loud", "shifted"], F.lit(512) / F.lit(22050.0))


@plan(
    "bar_summary",
    f"""
    SELECT track, bar, {_r("max(low)", 3)} AS low, {_r("max(mid)", 3)} AS mid, {_r("max(high)", 3)} AS high, {_r("max(flux)", 3)} AS flux,
      {_r("avg(activity)", 3)} AS activity, {_r("avg(drum)", 3)} AS drum, sum((greatest(low, mid, high, flux) >= 0.05)::INT)::BIGINT AS grid_count
    FROM evid GROUP BY track, bar
    """,
    ("evid",),
)
def bar_summary(spark, sf_dir):
    return binning.bar_summary(evidence(spark, sf_dir), ["track"], ["low", "mid", "high", "flux"], ["activity", "drum"])


@plan(
    "bar_loudness",
    f"""
    WITH f AS (SELECT track, day - 10 AS rel, (q * q * q) / 125000.0::DOUBLE AS x FROM ln), m AS (SELECT track, max(x) AS top FROM f GROUP BY track),
    b AS (SELECT track, CAST(floor(rel / 48.0::DOUBLE) AS INTEGER) AS bar, x FROM f WHERE rel >= 0), g AS (SELECT track, bar, avg(x * x) AS pw, max(x) AS pkx FROM b GROUP BY ALL),
    n AS (SELECT b.track, b.bar, any_value(pw) AS pw, any_value(pkx) AS pkx, avg((x >= pkx * 0.1::DOUBLE)::INT) AS near FROM b JOIN g ON g.track = b.track AND g.bar = b.bar GROUP BY ALL)
    SELECT n.track, n.bar, {_r("20 * log10(greatest(sqrt(pw), 1e-6))", 3)} AS rms_dbfs, {_r("20 * log10(greatest(pkx, 1e-6))", 3)} AS peak_rms_dbfs,
      {_r("20 * log10(greatest(sqrt(pw), 1e-6)) - 20 * log10(greatest(top, 1e-6))", 3)} AS relative_rms_db, {_r("CASE WHEN pkx <= 1e-6 THEN 0 ELSE near END", 3)} AS sustained_ratio
    FROM n JOIN m USING (track)
    """,
    ("ln",),
)
def bar_loudness(spark, sf_dir):
    rms = (F.col("q") * F.col("q") * F.col("q")) / 125000.0
    return binning.bar_loudness(lines(spark, sf_dir), ["track"], F.col("day").cast("double"), rms, 10.0, 48.0)


@plan(
    "bar_energy",
    """
    SELECT b.track, b.bar, b.energy, b.onset_count, string_agg(e.tick, ',' ORDER BY e.tick) AS accents
    FROM be b LEFT JOIN evid e ON e.track = b.track AND e.bar = b.bar AND e.onset AND CASE WHEN has_beat = 1 THEN e.tick % 12 = 0 ELSE e.strength = best END
    GROUP BY b.track, b.bar, b.energy, b.onset_count
    """,
    ("be", "evid"),
)
def bar_energy(spark, sf_dir):
    energy = binning.bar_energy(evidence(spark, sf_dir), ["track"], 16, TICKS, BEAT)
    text = F.array_join(F.col("accents").cast("array<string>"), ",")
    return energy.withColumn("accents", F.when(F.size("accents") > 0, text))


@plan(
    "dominant_source",
    f"""
    WITH u AS (SELECT track, bar, unnest([{{'n': 'vocals', 'v': vocal_activity}}, {{'n': 'drums', 'v': drum_activity}}, {{'n': 'bass', 'v': bass_activity}}, {{'n': 'other', 'v': accompaniment_activity}}], recursive := true) FROM ctx),
    r AS (SELECT *, row_number() OVER (PARTITION BY track, bar ORDER BY v DESC, n) AS rn, lead(v) OVER (PARTITION BY track, bar ORDER BY v DESC, n) AS s FROM u)
    SELECT c.track, c.bar, vocal_activity, drum_activity, bass_activity, accompaniment_activity, CASE WHEN v >= 0.12::DOUBLE AND v - s >= 0.08::DOUBLE THEN n END AS dominant_source,
      CASE WHEN v >= 0.12::DOUBLE AND v - s >= 0.08::DOUBLE THEN {_r("least(1.0::DOUBLE, v * 0.7::DOUBLE + (v - s) * 0.6::DOUBLE)", 3)} ELSE 0 END AS source_confidence
    FROM ctx c JOIN r ON r.track = c.track AND r.bar = c.bar AND r.rn = 1
    """,
    ("ctx",),
)
def dominant_source(spark, sf_dir):
    sources = {
        "vocals": "vocal_activity",
        "drums": "drum_activity",
        "bass": "bass_activity",
        "other": "accompaniment_activity",
    }
    return binning.dominant_source(bar_context(spark, sf_dir), ["track", "bar"], sources)


# Silence works on sparse daily bars of the events table.
cte(
    "eb",
    """SELECT track, bar, last_bar, coalesce(n, 0) AS onset_count, coalesce(least(1, v / 4000), 0) AS energy, coalesce(least(1, v / 4000), 0) / 4 AS mean_activity, notes,
  CASE WHEN v IS NOT NULL THEN -60 + v / 10 END AS rms_dbfs, CASE WHEN v IS NOT NULL THEN -55 + v / 8 END AS peak_dbfs, CASE WHEN v IS NOT NULL THEN -50 + v / 10 END AS relative_db, (bar % 10) / 20.0::DOUBLE AS sustained
FROM (SELECT s.track, s.bar, s.last_bar, e.n, e.v, coalesce(e.notes, 0) AS notes FROM (SELECT track, last_bar, unnest(range(0, last_bar + 1)) AS bar FROM (SELECT track, max(t) // 86400000000 AS last_bar FROM ev GROUP BY track)) s
  LEFT JOIN (SELECT track, t // 86400000000 AS bar, count(*) FILTER (kind IN ('purchase', 'signup')) AS n, round_even(sum(value * 100), 0) / 100 AS v, count(*) FILTER (kind IN ('view', 'click')) AS notes FROM ev GROUP BY ALL) e
  ON e.track = s.track AND e.bar = s.bar)""",
    "ev",
)
cte(
    "quiet",
    """SELECT *, onset_count = 0 AND (energy <= 0.015::DOUBLE OR (energy <= 0.03::DOUBLE AND mean_activity <= 0.05::DOUBLE)) AS silent,
  coalesce(rms_dbfs <= -50 AND relative_db <= -40 AND peak_dbfs <= -40 AND sustained <= 0.15::DOUBLE AND onset_count <= 4, false) AS noise FROM eb""",
    "eb",
)


def event_bars(spark, sf_dir):
    """Daily bars of the events table: onsets, energy, levels, notes."""
    events = timeline(spark, sf_dir)
    daily = events.groupBy("track", F.floor(F.col("t") / DAY).alias("bar")).agg(
        F.sum(F.when(F.col("kind").isin("purchase", "signup"), 1).otherwise(0)).alias("n"),
        (F.rint(F.sum(F.col("value") * 100)) / 100).alias("v"),
        F.sum(F.when(F.col("kind").isin("view", "click"), 1).otherwise(0)).alias("notes"),
    )
    ends = events.groupBy("track").agg(F.floor(F.max("t") / DAY).alias("last_bar"))
    spine = ends.select("track", "last_bar", F.explode(F.sequence(F.lit(0).cast("long"), "last_bar")).alias("bar"))
    energy = F.coalesce(F.least(F.lit(1.0), F.col("v") / 4000), F.lit(0.0))
    bars = spine.join(daily, ["track", "bar"], "left").select(
        "track",
        "bar",
        "last_bar",
        F.coalesce("n", F.lit(0)).alias("onset_count"),
        energy.alias("energy"),
        (energy / 4).alias("mean_activity"),
        F.coalesce("notes", F.lit(0)).alias("notes"),
        (-60 + F.col("v") / 10).alias("rms_dbfs"),
        (-55 + F.col("v") / 8).alias("peak_dbfs"),
        (-50 + F.col("v") / 10).alias("relative_db"),
        ((F.col("bar") % 10) / 20.0).alias("sustained"),
    )
    onsets = F.col("onset_count")
    return bars.withColumn("silent", binning.silent_bar(onsets, F.col("energy"), F.col("mean_activity"))).withColumn(
        "noise",
        binning.edge_noise(onsets, 16, F.col("rms_dbfs"), F.col("relative_db"), F.col("peak_dbfs"), F.col("sustained")),
    )


@plan("silent_bars", "SELECT track, bar, silent, noise FROM quiet WHERE silent OR noise", ("quiet",))
def silent_bars(spark, sf_dir):
    return event_bars(spark, sf_dir).filter("silent OR noise").select("track", "bar", "silent", "noise")


_EDGE = """NOT EXISTS (SELECT 1 FROM quiet z WHERE z.track = q.track AND z.bar <= q.bar AND NOT (z.silent OR z.noise))
  OR NOT EXISTS (SELECT 1 FROM quiet z WHERE z.track = q.track AND z.bar >= q.bar AND NOT (z.silent OR z.noise))"""


@plan("edge_silence", f"SELECT track, bar FROM quiet q WHERE {_EDGE}", ("quiet",))
def edge_silence(spark, sf_dir):
    bars = binning.edge_runs(event_bars(spark, sf_dir), ["track"], F.col("silent") | F.col("noise"))
    return bars.filter("edge").select("track", "bar")


@plan(
    "silence_violations",
    f"""
    SELECT track, sum(CASE WHEN silent OR edge THEN 1 ELSE 0 END)::BIGINT AS evaluated_bar_count, sum(notes)::BIGINT AS activity_count,
      sum(CASE WHEN silent OR edge THEN notes ELSE 0 END)::BIGINT AS violation_count,
      {_r("coalesce(sum(CASE WHEN silent OR edge THEN notes ELSE 0 END) / nullif(sum(notes), 0)::DOUBLE, 0)", 6)} AS violation_rate
    FROM (SELECT *, {_EDGE} AS edge FROM quiet q) GROUP BY track
    """,
    ("quiet",),
)
def silence_violations(spark, sf_dir):
    from pulsegrid.operators.quality import silence_violations as violations

    bars = binning.edge_runs(event_bars(spark, sf_dir), ["track"], F.col("silent") | F.col("noise"))
    return violations(bars, ["track"], F.col("silent") | F.col("edge"), F.col("notes"))


_GRID_COLUMNS = ("track", "bar", "tick", "onset", "strength", "hint", "activity", "low", "mid", "high", "flux", "drum", "beat", "downbeat")


@plan("evidence_grid", f"SELECT {', '.join(_GRID_COLUMNS)} FROM dense", ("dense",))
def evidence_grid(spark, sf_dir):
    return grid(spark, sf_dir).select(*_GRID_COLUMNS)


@plan(
    "evidence_peaks",
    f"SELECT track, bar, tick, onset_peak, spectral_peak, {_r('margin', 6)} AS margin FROM pk WHERE onset_peak OR spectral_peak",
    ("pk",),
)
def evidence_peaks(spark, sf_dir):
    found = peaks(spark, sf_dir).filter("onset_peak OR spectral_peak")
    return found.select("track", "bar", "tick", "onset_peak", "spectral_peak", round_half_even(F.col("margin"), 6).alias("margin"))


@plan("transient_p75", "SELECT track, transient_p75 FROM p75", ("p75",))
def transient_p75(spark, sf_dir):
    return ev.transient_reference(peaks(spark, sf_dir))


@plan(
    "salience_hit",
    "SELECT track, bar, tick, hit, confidence, array_to_string(reasons, ' ') AS reasons FROM hits",
    ("hits",),
)
def salience_hit(spark, sf_dir):
    _, points = scored(spark, sf_dir)
    return points.select("track", "bar", "tick", "hit", "confidence", F.array_join("reasons", " ").alias("reasons"))


@plan("salience_bar", "SELECT * FROM sal", ("sal",))
def salience_bar(spark, sf_dir):
    return ev.bar_salience(*scored(spark, sf_dir), TICKS)


@plan(
    "salience_accent",
    "SELECT track, bar, tick, accent, array_to_string(reasons, ' ') AS reasons FROM accents WHERE accent > 0",
    ("accents",),
)
def salience_accent(spark, sf_dir):
    _, points = scored(spark, sf_dir)
    found = ev.accent_scores(points).filter("accent > 0")
    return found.select("track", "bar", "tick", "accent", F.array_join("reasons", " ").alias("reasons"))


@plan(
    "salience_class",
    "SELECT track, bar, tick, don_preference, ka_preference, array_to_string(reasons, ' ') AS reasons FROM classes WHERE don_preference > 0 OR ka_preference > 0",
    ("classes",),
)
def salience_class(spark, sf_dir):
    _, points, _ = classed(spark, sf_dir)
    found = points.filter("don_preference > 0 OR ka_preference > 0")
    return found.select("track", "bar", "tick", "don_preference", "ka_preference", F.array_join("reasons", " ").alias("reasons"))


@plan(
    "candidates",
    "SELECT track, bar, tick, kind, priority::INTEGER AS priority, score, rank::INTEGER AS rank, reliable FROM cand WHERE tick % 2 = 0 QUALIFY true".replace(
        "rank::INTEGER AS rank", "row_number() OVER (PARTITION BY track, bar ORDER BY rank)::INTEGER AS rank"
    ).replace(" QUALIFY true", ""),
    ("cand",),
)
def candidates(spark, sf_dir):
    found = ranked(spark, sf_dir, step=2)
    return found.select("track", "bar", "tick", "kind", "priority", "score", "rank", "reliable")


@plan(
    "quota_topk",
    """
    WITH s AS (SELECT *, (tick % 2 = 0 OR tick % 3 = 0) AS st, NOT (tick % 2 = 0 OR tick % 3 = 0) AND confidence >= 0.85::DOUBLE AND list_contains(reasons, 'onset') AS ar FROM cand),
    r AS (SELECT *, row_number() OVER (PARTITION BY track, bar, st, ar ORDER BY rank) AS k, least(1, sum(ar::INT) OVER (PARTITION BY track, bar)) AS ex FROM s)
    SELECT track, bar, tick, rank::INTEGER AS rank FROM r WHERE (ar AND k <= ex) OR (st AND k <= 8 - ex)
    """,
    ("cand",),
)
def quota_topk(spark, sf_dir):
    return ev.quota_topk(ranked(spark, sf_dir), size=8, arbitrary=1).select("track", "bar", "tick", "rank")


@plan(
    "topk_to_target",
    """
    SELECT track, bar, tick, k::INTEGER AS pick FROM (SELECT *, row_number() OVER (PARTITION BY track, bar ORDER BY rank) AS k FROM cand WHERE reliable) WHERE k <= 3 + bar % 4
    """,
    ("cand",),
)
def topk_to_target(spark, sf_dir):
    from pulsegrid.operators.targets import take_to_target

    return take_to_target(ranked(spark, sf_dir), 3 + F.col("bar") % 4).select("track", "bar", "tick", "pick")


_PH = "(phrase_position IN ('phrase_end', 'song_end'))"
cte(
    "bur",
    f"""WITH h AS (SELECT track, bar, sum((tick < 24 AND pr)::INT) AS o1, sum((tick >= 24 AND pr)::INT) AS o2, max(CASE WHEN tick < 24 THEN flux ELSE 0 END) AS f1, max(CASE WHEN tick >= 24 THEN flux ELSE 0 END) AS f2,
    sum((tick < 24 AND drum_raw >= 0.18::DOUBLE)::INT) AS d1, sum((tick >= 24 AND drum_raw >= 0.18::DOUBLE)::INT) AS d2, sum(onset::INT) AS onsets, sum(lv::INT) AS lively,
    min(CASE WHEN lv THEN tick END) AS start_tick, max(CASE WHEN lv THEN tick END) AS end_tick
  FROM (SELECT *, tick >= 24 AND (pr OR flux >= 0.25::DOUBLE) AS lv FROM (SELECT *, onset OR drum_raw >= 0.18::DOUBLE AS pr FROM pk)) GROUP BY track, bar),
c AS (SELECT x.*, h.* EXCLUDE (track, bar), lag(percussive_ratio) OVER w AS pp, lag(onsets) OVER w AS po, lead(role) OVER w AS nr, lead(section_id) OVER w AS ns FROM ctx x JOIN h ON h.track = x.track AND h.bar = x.bar WINDOW w AS (PARTITION BY x.track ORDER BY x.bar)),
r AS (SELECT *, o1 / 24.0::DOUBLE AS r1, o2 / 24.0::DOUBLE AS r2 FROM c WHERE NOT silent AND EXISTS (SELECT 1 FROM hits z WHERE z.track = c.track AND z.bar = c.bar)),
q AS (SELECT *, {_unit("greatest(0.0::DOUBLE, r2 - r1) / greatest(r2, 1 / 48.0::DOUBLE) * least(1.0::DOUBLE, o2 / 4.0::DOUBLE)")} AS density, {_unit("greatest(0.0::DOUBLE, f2 - greatest(f1, 0.175::DOUBLE)) / 0.825::DOUBLE")} AS fluxc,
    {_unit("greatest(0, d2 - d1) / 4.0::DOUBLE")} AS drumc, coalesce({_unit("greatest(0.0::DOUBLE, percussive_ratio - pp) / 0.6::DOUBLE")}, 0) AS percc,
    {_unit("greatest(0.0::DOUBLE, r2 - greatest(r1, coalesce(po / 48.0::DOUBLE, r1))) / greatest(r2, 1 / 48.0::DOUBLE)")} AS conc, least(1.0::DOUBLE, lively / 4.0::DOUBLE) AS support FROM (SELECT * REPLACE (CASE WHEN pp IS NULL THEN NULL ELSE pp END AS pp) FROM r)),
k AS (SELECT *, (density > 0)::INT + (fluxc > 0)::INT + (drumc > 0)::INT + (percc > 0)::INT + (conc > 0)::INT AS act FROM (SELECT * REPLACE (CASE WHEN pp IS NULL THEN 0 ELSE percc END AS percc) FROM q)
  WHERE ((o2 >= 3 AND density >= 0.20::DOUBLE) OR (lively >= 2 AND f2 >= 0.35::DOUBLE AND fluxc >= 0.20::DOUBLE)) AND lively > 0)
SELECT track, bar, {_r(_unit(f"density * 0.40::DOUBLE + fluxc * 0.25::DOUBLE + drumc * 0.15::DOUBLE + percc * 0.15::DOUBLE + conc * 0.10::DOUBLE + support * 0.10::DOUBLE + (({_if(_PH, '0.06::DOUBLE + boundary_confidence * 0.04::DOUBLE')}) + ({_if(chr(114) + 'ole = ' + chr(39) + 'cadence' + chr(39), '0.05::DOUBLE + transition_confidence * 0.03::DOUBLE')}) + ({_if('ns <> section_id', '0.05::DOUBLE')}) + (CASE WHEN nr IN ('peak', 'drop') THEN 0.05::DOUBLE ELSE 0 END))"), 6)} AS burst_score,
  {_r(_unit("support * 0.40::DOUBLE + greatest(density, fluxc) * 0.35::DOUBLE + least(1.0::DOUBLE, act / 3.0::DOUBLE) * 0.25::DOUBLE"), 6)} AS burst_confidence, start_tick, end_tick,
  array_to_string(list_filter([CASE WHEN density > 0 THEN 'burst:onset-density' END, CASE WHEN fluxc > 0 THEN 'burst:spectral-flux' END, CASE WHEN drumc > 0 THEN 'burst:drum-onset-rise' END, CASE WHEN percc > 0 THEN 'burst:percussive-rise' END,
    CASE WHEN conc > 0 THEN 'burst:stable-contrast' END, CASE WHEN {_PH} THEN 'burst:phrase-end' END, CASE WHEN role = 'cadence' THEN 'burst:cadence' END, CASE WHEN ns <> section_id THEN 'burst:next-section' END,
    CASE WHEN nr IN ('peak', 'drop') THEN 'burst:next-highlight' END], lambda x: x IS NOT NULL), ' ') AS burst_reasons FROM k""",
    "pk",
    "ctx",
    "hits",
)


def bursts_of(spark, sf_dir):
    found, points = scored(spark, sf_dir)
    return ev.bursts(found, points, bar_context(spark, sf_dir), TICKS)


_BURST_SPAN = """CASE WHEN burst_score >= 0.40::DOUBLE AND burst_confidence >= 0.50::DOUBLE AND end_tick > greatest(24, start_tick) AND s0 < 45 AND e1 > s0 THEN"""


@plan(
    "burst",
    f"""
    SELECT track, bar, burst_score, burst_confidence, start_tick, end_tick, burst_reasons, ({_BURST_SPAN} s0 END)::INTEGER AS span_start, ({_BURST_SPAN} e1 END)::INTEGER AS span_end
    FROM (SELECT *, CASE WHEN e0 <= s0 THEN least(45, s0 + 3) ELSE e0 END AS e1 FROM (SELECT *, ((greatest(24, start_tick) + 2) // 3) * 3 AS s0, least(45, (end_tick // 3) * 3) AS e0 FROM bur))
    """,
    ("bur",),
)
def burst(spark, sf_dir):
    start, end = ev.burst_span(16, TICKS)
    return bursts_of(spark, sf_dir).select("*", start.alias("span_start"), end.alias("span_end"))


@plan(
    "grid_coarsen",
    """
    SELECT track, bar, CAST(least(45, greatest(0, round_even(tick / 3.0::DOUBLE, 0) * 3)) AS INTEGER) AS tick, bool_or(onset) AS onset, max(strength) AS strength, max(activity) AS activity,
      max(low) AS low, max(high) AS high, max(drum) AS drum FROM evid GROUP BY ALL
    """,
    ("evid",),
)
def grid_coarsen(spark, sf_dir):
    return binning.grid_coarsen(
        evidence(spark, sf_dir), ["track", "bar"], 3, TICKS, ["onset"], ["strength", "activity", "low", "high", "drum"]
    )


@plan(
    "profile12",
    f"""
    WITH b AS (SELECT i, CAST(round_even(i * 48 / 12.0::DOUBLE, 0) AS INTEGER) AS a, CAST(round_even((i + 1) * 48 / 12.0::DOUBLE, 0) AS INTEGER) AS z FROM range(0, 12) t(i)),
    x AS (SELECT s.track, s.bar, b.i, {_r("coalesce(max(e.strength), 0)", 6)} AS mx, {_r("coalesce(sum(e.activity), 0) / any_value(b.z - b.a)", 6)} AS mn FROM spine s CROSS JOIN b
      LEFT JOIN evid e ON e.track = s.track AND e.bar = s.bar AND e.tick >= b.a AND e.tick < b.z GROUP BY s.track, s.bar, b.i)
    SELECT track, bar, list(mx ORDER BY i) AS rhythm_profile, list(mn ORDER BY i) AS activity_profile FROM x GROUP BY track, bar
    """,
    ("spine", "evid"),
)
def profile12(spark, sf_dir):
    points = evidence(spark, sf_dir)
    rhythm = binning.profile12(points, ["track", "bar"], "strength", TICKS, "max").withColumnRenamed("profile", "rhythm_profile")
    activity = binning.profile12(points, ["track", "bar"], "activity", TICKS, "mean").withColumnRenamed("profile", "activity_profile")
    empty = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.lit(0.0))
    both = bar_spine(spark, sf_dir).join(rhythm, ["track", "bar"], "left").join(activity, ["track", "bar"], "left")
    return both.select("track", "bar", *[F.coalesce(n, empty).alias(n) for n in ("rhythm_profile", "activity_profile")])


@plan(
    "arbitrary_grid",
    """
    SELECT track, count(*) AS evaluated, sum((NOT (tick % 2 = 0 OR tick % 3 = 0))::INT)::BIGINT AS arbitrary, sum((NOT (tick % 2 = 0 OR tick % 3 = 0))::INT) / count(*)::DOUBLE AS rate,
      count(*) >= 16 AND sum((NOT (tick % 2 = 0 OR tick % 3 = 0))::INT) >= 4 AND sum((NOT (tick % 2 = 0 OR tick % 3 = 0))::INT) / count(*)::DOUBLE > 0.10::DOUBLE AS flagged
    FROM nt WHERE note IN ('1', '2', '3', '4') GROUP BY track
    """,
    ("nt",),
)
def arbitrary_grid(spark, sf_dir):
    from pulsegrid.operators.quality import arbitrary_grid as arbitrary
    from pulsegrid.plans.charts import notes_of

    return arbitrary(notes_of(spark, sf_dir), ["track"])


