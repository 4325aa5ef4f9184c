"""Plans that compare charts with density hints, candidates, bursts and structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import notes as N
from pulsegrid.operators import binning, charts, evidence as ev, quality, targets
from pulsegrid.operators.sequences import energy_rank
from pulsegrid.plans.bindings import TICKS, chart_bars, evidence
from pulsegrid.plans.charts import COURSES, notes_of
from pulsegrid.plans.evidence import _EDGE, _r, ROLES, bar_context, bursts_of, event_bars, ranked
from pulsegrid.plans.registry import cte, plan
from pulsegrid.plans.stages import stage

CELL = 96.0


def walk_ctes(name: str, sides: str, keys: str, tol: float) -> tuple[str, str]:
    """Recursive two-pointer walk over sorted lists; ``sides`` has (keys, side, t)."""
    lists = f"""{name}_l AS (SELECT {keys}, coalesce(list(t ORDER BY t) FILTER (side = 'ref'), []) AS r, coalesce(list(t ORDER BY t) FILTER (side = 'est'), []) AS e FROM ({sides}) GROUP BY {keys}),
{name}_w AS (SELECT {keys}, r, e, 1::BIGINT AS i, 1::BIGINT AS j, NULL::DOUBLE AS hit FROM {name}_l
  UNION ALL SELECT {keys}, r, e, CASE WHEN e[j] < r[i] - {tol} THEN i ELSE i + 1 END, CASE WHEN e[j] > r[i] + {tol} THEN j ELSE j + 1 END,
    CASE WHEN abs(e[j] - r[i]) <= {tol} THEN abs(e[j] - r[i]) END FROM {name}_w WHERE i <= len(r) AND j <= len(e))"""
    return lists, f"(SELECT {keys}, any_value(len(r))::BIGINT AS refs, any_value(len(e))::BIGINT AS ests, count(hit) AS tp FROM {name}_w GROUP BY {keys})"


# Density hints on daily event bars ------------------------------------------------------
SECTIONS = ("verse", "break", "chorus", "break")
DENSITIES = ("low", "medium", "auto", "high", "max")

cte(
    "hctx",
    f"""SELECT q.*, ({_EDGE}) AS edge, ['stable', 'build_up', 'peak', 'drop', 'breakdown', 'cadence', 'fill', 'stable'][bar % 8 + 1] AS role,
  CASE WHEN bar = last_bar THEN 'song_end' WHEN bar % 8 = 7 THEN 'phrase_end' ELSE 'phrase_middle' END AS phrase_position, bar % 8 = 7 OR bar % 8 = 5 AS fill_candidate, (bar % 8) / 7.0::DOUBLE AS phrase_progress,
  ['verse', 'break', 'chorus', 'break'][bar // 8 % 4 + 1] AS section, least(1.0::DOUBLE, energy * 6) AS activity_level, notes * 5 AS active_count FROM quiet q""",
    "quiet",
)
_HINT = f"""SELECT *, CASE WHEN kind IN ('silent', 'rest') THEN 1.0::DOUBLE ELSE {_r("least(1.15::DOUBLE, greatest(0.65::DOUBLE, CASE role WHEN 'build_up' THEN 0.9::DOUBLE + 0.2::DOUBLE * phrase_progress WHEN 'peak' THEN 1.12::DOUBLE WHEN 'breakdown' THEN 0.72::DOUBLE WHEN 'drop' THEN 0.95::DOUBLE WHEN 'cadence' THEN CASE WHEN fill_candidate THEN 1.05::DOUBLE ELSE 0.92::DOUBLE END ELSE 1.0::DOUBLE END))", 3)} END AS target_scale,
  CASE rule WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN CASE WHEN onset_count > 0 THEN 1 ELSE 0 END WHEN 4 THEN 3 WHEN 5 THEN 5 ELSE 2 END AS min_hits,
  CASE rule WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN silent THEN 0 ELSE 2 END WHEN 2 THEN 12 WHEN 3 THEN 4 WHEN 4 THEN 14 WHEN 5 THEN 16 ELSE 12 END AS max_hits,
  rule IN (0, 1) OR (rule = 3 AND onset_count = 0) AS allow_empty, rule IN (2, 4, 5, 6) AS in_average
FROM (SELECT *, ['silent', 'rest', 'normal', 'sparse', 'fill', 'dense', 'normal'][rule + 1] AS kind FROM (SELECT *, CASE WHEN edge THEN 0
  WHEN activity_level < 0.18::DOUBLE AND CASE WHEN silent THEN section IN ('break', 'verse', 'unknown') ELSE section = 'break' AND ((energy <= 0.025::DOUBLE AND onset_count <= 1) OR (energy <= 0.04::DOUBLE AND onset_count = 0)) END THEN 1
  WHEN activity_level >= 0.25::DOUBLE AND active_count >= 9 AND onset_count <= 3 THEN 2
  WHEN (energy <= 0.08::DOUBLE AND onset_count <= 2) OR (activity_level < 0.18::DOUBLE AND section = 'break' AND energy <= 0.08::DOUBLE AND onset_count <= 3) THEN 3
  WHEN fill_candidate THEN 4 WHEN energy >= 0.45::DOUBLE OR onset_count >= 24 THEN 5 ELSE 6 END AS rule FROM hctx))"""
cte("hint", _HINT, "hctx")


# The same hints on the bars of the charts, from their evidence.
cte(
    "chctx",
    """SELECT *, (bar % 8) / 7.0::DOUBLE AS phrase_progress, ['verse', 'break', 'chorus', 'break'][bar // 8 % 4 + 1] AS section, least(1.0::DOUBLE, energy * 6) AS activity_level, onset_count * 5 AS active_count FROM ctx""",
    "ctx",
)
cte("chint", _HINT.replace("FROM hctx", "FROM chctx"), "chctx")


def chart_hints(spark, sf_dir):
    """Density hints of the chart bars, staged."""

    def build():
        b = F.col("bar").cast("int")
        names = F.array(*[F.lit(n) for n in SECTIONS])
        rows = bar_context(spark, sf_dir).select(
            "*",
            ((b % 8) / 7.0).alias("phrase_progress"),
            F.element_at(names, (F.floor(b / 8) % 4 + 1).cast("int")).alias("section"),
            F.least(F.lit(1.0), F.col("energy") * 6).alias("activity_level"),
            (F.col("onset_count") * 5).alias("active_count"),
        )
        return targets.density_hints(rows, TICKS)

    return stage(spark, sf_dir, "chart-hints", build)


def hinted_bars(spark, sf_dir):
    """Density hints of the daily bars, staged."""
    return stage(spark, sf_dir, "hints", lambda: build_hinted_bars(spark, sf_dir))


def build_hinted_bars(spark, sf_dir):
    bars = binning.edge_runs(event_bars(spark, sf_dir), ["track"], F.col("silent") | F.col("noise"))
    b = F.col("bar").cast("int")

    def pick(names, index):
        return F.element_at(F.array(*[F.lit(n) for n in names]), index + 1)

    rows = bars.select(
        "*",
        pick(ROLES, b % 8).alias("role"),
        F.when(b == F.col("last_bar"), "song_end").when(b % 8 == 7, "phrase_end").otherwise("phrase_middle").alias("phrase_position"),
        (b % 8).isin(5, 7).alias("fill_candidate"),
        ((b % 8) / 7.0).alias("phrase_progress"),
        pick(SECTIONS, (F.floor(b / 8) % 4).cast("int")).alias("section"),
        F.least(F.lit(1.0), F.col("energy") * 6).alias("activity_level"),
        (F.col("notes") * 5).alias("active_count"),
    )
    return targets.density_hints(rows, TICKS)


@plan("density_hint", "SELECT track, bar, kind, min_hits, max_hits, allow_empty, in_average, target_scale FROM hint", ("hint",))
def density_hint(spark, sf_dir):
    return hinted_bars(spark, sf_dir).select(
        "track", "bar", "kind", "min_hits", "max_hits", "allow_empty", "in_average", "target_scale"
    )


@plan(
    "density_compliance",
    """
    SELECT track, sum((notes <= max_hits AND (allow_empty OR notes >= min_hits))::INT)::BIGINT AS compliant_bars, count(*) AS evaluated_bars,
      sum((notes <= max_hits AND (allow_empty OR notes >= min_hits))::INT) / count(*)::DOUBLE AS compliance_rate FROM hint GROUP BY track
    """,
    ("hint",),
)
def density_compliance(spark, sf_dir):
    fits = targets.compliant(F.col("notes")).cast("int")
    return hinted_bars(spark, sf_dir).groupBy("track").agg(
        F.sum(fits).alias("compliant_bars"),
        F.count(F.lit(1)).alias("evaluated_bars"),
        (F.sum(fits) / F.count(F.lit(1))).alias("compliance_rate"),
    )


_PROFILE_ROWS = ", ".join(f"('{k}', {', '.join(str(x) for x in v)})" for k, v in targets.COURSE_PROFILES.items())
cte(
    "loadctx",
    f"""SELECT h.*, p.*, ['low', 'medium', 'auto', 'high', 'max'][CAST(h.track % 5 + 1 AS INTEGER)] AS density, CAST(h.track % 10 + 1 AS INTEGER) AS level, CASE WHEN bar % 5 = 4 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS seconds,
  4 AS beat_count, (bar % 5) / 5.0::DOUBLE AS drum_activity, (bar % 3) / 3.0::DOUBLE AS bass_activity, (bar % 4) / 4.0::DOUBLE AS other_activity, (bar % 7) / 7.0::DOUBLE AS vocal_activity
FROM hint h JOIN (SELECT col0 AS course, col1 AS min_level, col2 AS max_level, col3::DOUBLE AS min_nps, col4::DOUBLE AS max_nps, col5::DOUBLE AS speed_cap, col6::DOUBLE AS occupancy, col7::DOUBLE AS min_balloon, col8::DOUBLE AS max_balloon FROM (VALUES {_PROFILE_ROWS})) p
  ON p.course = ['Easy', 'Normal', 'Hard', 'Oni'][CAST(h.track % 4 + 1 AS INTEGER)]""",
    "hint",
)


def load_rows(spark, sf_dir):
    b, t = F.col("bar").cast("int"), F.col("track")

    def pick(names, size):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(t, F.lit(size)) + 1).cast("int"))

    rows = hinted_bars(spark, sf_dir).select(
        "*",
        pick(COURSES, 4).alias("course"),
        pick(DENSITIES, 5).alias("density"),
        (F.pmod(t, F.lit(10)) + 1).cast("int").alias("level"),
        F.when(b % 5 == 4, 0.0).otherwise(2.0).alias("seconds"),
        F.lit(4).alias("beat_count"),
        ((b % 5) / 5.0).alias("drum_activity"),
        ((b % 3) / 3.0).alias("bass_activity"),
        ((b % 4) / 4.0).alias("other_activity"),
        ((b % 7) / 7.0).alias("vocal_activity"),
    )
    # The course table has four fixed rows.
    return rows.join(F.broadcast(targets.course_dim(spark)), "course")


@plan(
    "load_target",
    """
    WITH a AS (SELECT *, (least(max_level, greatest(min_level, level)) - min_level) / (max_level - min_level)::DOUBLE AS lp, CASE density WHEN 'low' THEN 0.75::DOUBLE WHEN 'medium' THEN 0.9::DOUBLE WHEN 'auto' THEN 1.0::DOUBLE WHEN 'high' THEN 1.1::DOUBLE ELSE 1.2::DOUBLE END AS df FROM loadctx),
    b AS (SELECT *, least(speed_cap, greatest(0.5::DOUBLE, (min_nps + (max_nps - min_nps) * lp) * df)) AS nps, least(max_hits, 16, greatest(1, floor(16 * occupancy)))::BIGINT AS t0,
      0.75::DOUBLE + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (energy + least(1.0::DOUBLE, onset_count / 8.0::DOUBLE)) / 2)) * 0.35::DOUBLE + least(1.0::DOUBLE, drum_activity * 0.4::DOUBLE + bass_activity * 0.25::DOUBLE + other_activity * 0.2::DOUBLE + vocal_activity * 0.15::DOUBLE) * 0.08::DOUBLE AS m0 FROM a),
    c AS (SELECT *, CASE WHEN kind = 'normal' THEN least(t0, greatest(min_hits, greatest(onset_count, beat_count, active_count) + floor(16 * occupancy / 2)))::BIGINT ELSE t0 END AS t1,
      CASE WHEN kind IN ('dense', 'fill') THEN greatest(m0, 1.0::DOUBLE) WHEN kind = 'sparse' THEN least(m0, 0.75::DOUBLE) ELSE m0 END AS mf FROM b),
    d AS (SELECT *, CASE WHEN seconds > 0 THEN least(t1, greatest(1, floor(seconds * least(speed_cap, 12))))::BIGINT ELSE t1 END AS hi FROM c),
    e AS (SELECT *, least(min_hits, hi) AS lo FROM d)
    SELECT track, bar, greatest(lo, least(CASE WHEN seconds > 0 THEN round_even(nps * mf * target_scale * seconds, 0) ELSE round_even((lo + (t1 - lo) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, mf - 0.5::DOUBLE))) * target_scale, 0) END::BIGINT, hi)) AS target_hits,
      greatest(1, round_even(seconds * (min_balloon + (max_balloon - min_balloon) * lp) * df, 0)::BIGINT) AS balloon_hits FROM e
    """,
    ("loadctx",),
)
def load_target(spark, sf_dir):
    return targets.load_target(load_rows(spark, sf_dir)).select("track", "bar", "target_hits", "balloon_hits")


@plan(
    "density_target",
    """
    WITH q AS (SELECT *, CASE WHEN density IN ('high', 'max') THEN density WHEN density = 'auto' AND course = 'Oni' AND level >= 10 THEN 'max' WHEN density = 'auto' AND course = 'Oni' AND level >= 8 THEN 'high' ELSE density END AS qd FROM loadctx),
    b AS (SELECT *, CASE WHEN kind = 'sparse' THEN greatest(min_hits, CASE WHEN qd IN ('high', 'max') THEN 2 ELSE 1 END)
      WHEN qd = 'max' THEN CASE kind WHEN 'normal' THEN 8 WHEN 'dense' THEN 11 WHEN 'fill' THEN 9 ELSE min_hits END WHEN qd = 'high' THEN CASE kind WHEN 'normal' THEN 6 WHEN 'dense' THEN 10 WHEN 'fill' THEN 8 ELSE min_hits END
      WHEN qd = 'medium' THEN CASE kind WHEN 'normal' THEN 4 WHEN 'dense' THEN 7 WHEN 'fill' THEN 6 ELSE min_hits END ELSE CASE kind WHEN 'normal' THEN 3 WHEN 'dense' THEN 5 WHEN 'fill' THEN 4 ELSE min_hits END END AS base FROM q)
    SELECT track, bar, qd AS density_class, CASE WHEN kind = 'silent' OR max_hits = 0 THEN 0 WHEN kind = 'rest' THEN least(max_hits, 1) ELSE least(greatest(min_hits, round_even(base * target_scale, 0)), max_hits) END::BIGINT AS target_hits FROM b
    """,
    ("loadctx",),
)
def density_target(spark, sf_dir):
    rows = load_rows(spark, sf_dir).withColumn(
        "density_class", targets.quality_density(F.col("density"), F.col("course"), F.col("level"))
    )
    return rows.select("track", "bar", "density_class", targets.density_target(F.col("density_class")).alias("target_hits"))


# Charts against candidates --------------------------------------------------------------
def timed_notes(spark, sf_dir):
    """Normal notes with time and tick."""
    tick = N.project_slot(F.col("pos"), F.col("res"), F.lit(TICKS))
    rows = notes_of(spark, sf_dir).filter(N.in_class(F.col("note"), N.NORMAL_NOTES))
    return rows.withColumn("tick", tick).withColumnRenamed("time_s", "t")


def timed_candidates(spark, sf_dir):
    return quality.candidate_times(ranked(spark, sf_dir), ["track"])


cte("ct", "SELECT *, bar * 48.0::DOUBLE + tick AS t FROM cand", "cand")
cte("nn", "SELECT track, bar, pos, res, tick, note, time_s AS t FROM nt WHERE note IN ('1', '2', '3', '4')", "nt")


@plan(
    "tick_error",
    f"""
    SELECT n.track, count(d) AS evaluated_count, {_r("avg(d)", 6)} AS mean_tick_error FROM (
      SELECT n.track, (SELECT min(abs(c.t - n.t)) FROM ct c WHERE c.track = n.track AND c.kind = 'strong-transient' AND abs(c.t - n.t) <= 2) AS d FROM nn n) n GROUP BY n.track
    """,
    ("ct", "nn"),
)
def tick_error(spark, sf_dir):
    strong = timed_candidates(spark, sf_dir).filter(F.col("kind") == "strong-transient")
    notes = timed_notes(spark, sf_dir).select("track", "t")
    return quality.tick_error(notes, strong, ["track"], 2.0, 1.0, CELL)


@plan(
    "unsupported_notes",
    f"""
    WITH d AS (SELECT n.track, n.t, EXISTS (SELECT 1 FROM ct c WHERE c.track = n.track AND c.kind = 'strong-transient' AND abs(c.t - n.t) <= 0.5) OR n.tick % 12 IN (0, 1, 11)
        OR EXISTS (SELECT 1 FROM ct c WHERE c.track = n.track AND c.kind = 'structure-highlight' AND abs(c.t - n.t) <= 1) OR coalesce(e.activity >= 0.95::DOUBLE, false) AS direct
      FROM nn n LEFT JOIN evid e ON e.track = n.track AND e.bar = n.bar AND e.tick = n.tick),
    l AS (SELECT d.*, EXISTS (SELECT 1 FROM d o WHERE o.track = d.track AND o.direct AND abs(o.t - d.t) <= 2) AS linked FROM d)
    SELECT track, count(*) AS evaluated_count, sum(direct::INT)::BIGINT AS direct_count, sum((NOT direct AND NOT linked)::INT)::BIGINT AS unsupported_count,
      {_r("sum((NOT direct AND NOT linked)::INT) / count(*)::DOUBLE", 6)} AS unsupported_rate FROM l GROUP BY track
    """,
    ("ct", "nn", "evid"),
)
def unsupported_notes(spark, sf_dir):
    found = timed_candidates(spark, sf_dir)
    activity = evidence(spark, sf_dir).select("track", "bar", "tick", (F.col("activity") >= 0.95).alias("sustained"))
    notes = timed_notes(spark, sf_dir).join(activity, ["track", "bar", "tick"], "left").fillna(False, ["sustained"])
    beats = bar_context(spark, sf_dir).select(
        "track", F.explode(F.transform(F.sequence(F.lit(0), F.lit(48), F.lit(12)), lambda b: F.col("bar") * 48.0 + b)).alias("t")
    )
    supports = [
        (found.filter(F.col("kind") == "strong-transient"), 0.5),
        (beats, 1.0),
        (found.filter(F.col("kind") == "structure-highlight"), 1.0),
    ]
    return quality.unsupported_notes(notes.select("track", "t", "sustained"), ["track"], supports, 2.0, CELL)


cte(
    "spans",
    """WITH l AS (SELECT track, note, time_s, sum((note = '8')::INT) OVER (PARTITION BY track ORDER BY bar, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM nt WHERE note IN ('5', '7', '8'))
SELECT track, max(time_s) FILTER (note <> '8') AS start_s, max(time_s) FILTER (note = '8') AS end_s FROM l GROUP BY track, coalesce(seg, 0)
HAVING count(*) FILTER (note <> '8') % 2 = 1 AND max(time_s) FILTER (note = '8') > max(time_s) FILTER (note <> '8')""",
    "nt",
)
_resp_l, _resp_q = walk_ctes(
    "rw", "SELECT track, 'ref' AS side, t FROM so WHERE NOT ins UNION ALL SELECT track, 'est', t FROM nn", "track", 1
)


@plan(
    "onset_response",
    f"""
    WITH so AS (SELECT c.track, c.t, EXISTS (SELECT 1 FROM spans s WHERE s.track = c.track AND c.t BETWEEN s.start_s AND s.end_s) AS ins FROM ct c WHERE kind = 'strong-transient'),
    {_resp_l}, a AS (SELECT track, sum(ins::INT)::BIGINT AS span_count, count(*) AS n FROM so GROUP BY track)
    SELECT m.track, coalesce(span_count, 0) + refs AS evaluated_count, coalesce(span_count, 0) AS span_count, coalesce(span_count, 0) + tp AS responded_count,
      CASE WHEN coalesce(span_count, 0) + refs = 0 THEN 1 ELSE {_r("(coalesce(span_count, 0) + tp) / (coalesce(span_count, 0) + refs)::DOUBLE", 6)} END AS response FROM {_resp_q} m LEFT JOIN a USING (track)
    """,
    ("ct", "nn", "spans"),
    recursive=True,
)
def onset_response(spark, sf_dir):
    strong = timed_candidates(spark, sf_dir).filter(F.col("kind") == "strong-transient")
    spans = charts.sustain_spans(charts.sustain_events(chart_bars(spark, sf_dir), ["track"]), ["track"])
    return quality.onset_response(strong, timed_notes(spark, sf_dir), spans, ["track"], 1.0, CELL)


_cov_l, _cov_q = walk_ctes(
    "cw",
    "SELECT track, kind, 'ref' AS side, t FROM kc UNION ALL SELECT track, k.kind, 'est', t FROM nn, (VALUES ('silent'), ('rest'), ('sparse'), ('normal'), ('dense'), ('fill')) k(kind)",
    "track, kind",
    1,
)


@plan(
    "density_coverage",
    f"""
    WITH kc AS (SELECT track, t, CASE WHEN bar % 6 = 0 THEN 'rest' WHEN bar % 6 = 1 THEN 'sparse' WHEN bar % 6 = 5 THEN 'fill' WHEN bar % 6 = 4 THEN 'dense' ELSE 'normal' END AS kind FROM ct WHERE reliable),
    {_cov_l}
    SELECT track, kind, tp AS responded_count, refs AS evaluated_count, CASE WHEN refs = 0 THEN 1 ELSE {_r("tp / refs::DOUBLE", 6)} END AS coverage FROM {_cov_q}
    """,
    ("ct", "nn"),
    recursive=True,
)
def density_coverage(spark, sf_dir):
    b = F.col("bar") % 6
    kind = F.when(b == 0, "rest").when(b == 1, "sparse").when(b == 5, "fill").when(b == 4, "dense").otherwise("normal")
    found = timed_candidates(spark, sf_dir).filter("reliable").select("track", "t", kind.alias("kind"))
    return quality.density_coverage(found, timed_notes(spark, sf_dir), ["track"], targets.HINT_KINDS, 1.0, CELL)


cte(
    "excess",
    """WITH h AS (SELECT b.track, b.bar, count(n.note) AS n, count(n.note) FILTER (n.note IN ('5', '7')) AS sp FROM bars b LEFT JOIN nt n ON n.track = b.track AND n.bar = b.bar GROUP BY ALL),
x AS (SELECT *, lag(n) OVER w AS p, lead(n) OVER w AS f FROM h WINDOW w AS (PARTITION BY track ORDER BY bar))
SELECT track, bar FROM x WHERE sp > 0 OR n >= (coalesce(p, 0) + coalesce(f, 0)) / nullif((p IS NOT NULL)::INT + (f IS NOT NULL)::INT, 0)::DOUBLE + 2""",
    "nt",
    "bars",
)
cte(
    "rbur",
    "SELECT *, bar * 48.0::DOUBLE + start_tick AS start_s, bar * 48.0::DOUBLE + end_tick AS end_s FROM bur WHERE burst_score >= 0.40::DOUBLE AND burst_confidence >= 0.50::DOUBLE",
    "bur",
)


def reliable_bursts(spark, sf_dir):
    """Reliable bursts with their time span, staged."""
    return stage(spark, sf_dir, "bursts", lambda: build_reliable_bursts(spark, sf_dir))


def build_reliable_bursts(spark, sf_dir):
    rows = bursts_of(spark, sf_dir).filter(ev.reliable_burst())
    base = F.col("bar") * 48.0
    return rows.select(
        "track", "bar", "start_tick", "end_tick", (base + F.col("start_tick")).alias("start_s"), (base + F.col("end_tick")).alias("end_s")
    )


@plan(
    "fill_alignment",
    f"""
    WITH s AS (SELECT track, count(*) AS n, sum((EXISTS (SELECT 1 FROM rbur r WHERE r.track = sp.track AND r.end_tick > r.start_tick AND greatest(r.start_s, sp.start_s) <= least(r.end_s, sp.end_s)))::INT) AS h FROM spans sp GROUP BY track),
    o AS (SELECT x.track, x.bar FROM excess x WHERE NOT EXISTS (SELECT 1 FROM nt n WHERE n.track = x.track AND n.bar = x.bar AND n.note IN ('5', '7', '8'))
      AND NOT EXISTS (SELECT 1 FROM spans p WHERE p.track = x.track AND greatest(p.start_s, x.bar * 48) <= least(p.end_s, (x.bar + 1) * 48))),
    f AS (SELECT o.track, count(*) AS n, sum((c.fill_candidate OR EXISTS (SELECT 1 FROM rbur r JOIN nn n ON n.track = r.track AND n.bar = r.bar AND n.tick BETWEEN r.start_tick AND r.end_tick WHERE r.track = o.track AND r.bar = o.bar))::INT) AS h
      FROM o JOIN ctx c ON c.track = o.track AND c.bar = o.bar GROUP BY o.track)
    SELECT t.track, (coalesce(s.h, 0) + coalesce(f.h, 0))::BIGINT AS aligned_count, coalesce(s.n, 0) + coalesce(f.n, 0) AS evaluated_count,
      CASE WHEN coalesce(s.n, 0) + coalesce(f.n, 0) = 0 THEN 1 ELSE {_r("(coalesce(s.h, 0) + coalesce(f.h, 0)) / (coalesce(s.n, 0) + coalesce(f.n, 0))::DOUBLE", 6)} END AS alignment
    FROM (SELECT DISTINCT track FROM bars) t LEFT JOIN s USING (track) LEFT JOIN f USING (track)
    """,
    ("spans", "excess", "rbur", "nn", "ctx", "nt"),
)
def fill_alignment(spark, sf_dir):
    bars = chart_bars(spark, sf_dir)
    spans = charts.sustain_spans(charts.sustain_events(bars, ["track"]), ["track"])
    special = N.count_chars(F.col("notes"), "578") > 0
    context = bar_context(spark, sf_dir).select("track", "bar", "fill_candidate")
    ranges = bars.select("track", "bar", "start_s", "end_s", special.alias("has_special")).join(context, ["track", "bar"])
    excess = charts.local_excess(bars, ["track"])
    return quality.fill_alignment(
        spans, reliable_bursts(spark, sf_dir), ranges, excess, timed_notes(spark, sf_dir), ["track"], CELL
    )


@plan(
    "coverage_report",
    f"""
    WITH k AS (SELECT c.*, EXISTS (SELECT 1 FROM nn n WHERE n.track = c.track AND n.bar = c.bar AND n.tick = c.tick) AS hit_it FROM cand c),
    st AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY bar, rank) - row_number() OVER (PARTITION BY track, hit_it ORDER BY bar, rank) AS g FROM k WHERE kind = 'strong-transient'),
    mr AS (SELECT track, max(n) AS m FROM (SELECT track, g, count(*) AS n FROM st WHERE NOT hit_it GROUP BY ALL) GROUP BY track),
    s AS (SELECT track, sum(reliable::INT)::BIGINT AS rc, sum((reliable AND hit_it)::INT)::BIGINT AS rh, sum((kind = 'strong-transient')::INT)::BIGINT AS sc, sum((kind = 'strong-transient' AND hit_it)::INT)::BIGINT AS sh FROM k GROUP BY track),
    u AS (SELECT track, bar, tick, row_number() OVER (PARTITION BY track ORDER BY bar, tick) AS rn FROM nn n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.track = n.track AND k.bar = n.bar AND k.tick = n.tick)),
    ua AS (SELECT track, count(*) AS n, string_agg(bar || ':' || tick, ' ' ORDER BY bar, tick) FILTER (rn <= 16) AS ex FROM u GROUP BY track), c AS (SELECT track, count(*) AS n FROM nn GROUP BY track)
    SELECT c.track, c.n AS note_count, rc AS reliable_count, {_r("rh / rc::DOUBLE", 6)} AS reliable_coverage, sc AS strong_count, CASE WHEN sc = 0 THEN 1 ELSE {_r("sh / nullif(sc, 0)::DOUBLE", 6)} END AS strong_coverage, coalesce(m, 0) AS longest_miss_run,
      coalesce(ua.n, 0) AS unsupported_count, {_r("coalesce(ua.n, 0) / c.n::DOUBLE", 6)} AS unsupported_ratio, coalesce(ex, '') AS unsupported_examples FROM c LEFT JOIN s USING (track) LEFT JOIN mr USING (track) LEFT JOIN ua USING (track)
    """,
    ("cand", "nn"),
)
def coverage_report(spark, sf_dir):
    return quality.coverage_report(ranked(spark, sf_dir), timed_notes(spark, sf_dir), ["track"])


@plan(
    "accent_coverage",
    f"""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY track, bar ORDER BY accent DESC, priority, score DESC, confidence DESC, tick) AS ar FROM cand WHERE accent >= 0.5 AND (reliable OR list_contains(reasons, 'accent:downbeat') OR list_contains(reasons, 'accent:hint'))),
    w AS (SELECT DISTINCT a.track, a.bar, CAST(least(b.res - 1, round_even(a.tick / 48.0::DOUBLE * b.res, 0)) AS INTEGER) AS pos FROM a JOIN bars b ON b.track = a.track AND b.bar = a.bar WHERE ar <= 4)
    SELECT w.track, count(*) AS accent_candidate_count, count(n.note) AS accent_hit_count, {_r("count(n.note) / count(*)::DOUBLE", 6)} AS accent_coverage
    FROM w LEFT JOIN nn n ON n.track = w.track AND n.bar = w.bar AND n.pos = w.pos GROUP BY w.track
    """,
    ("cand", "nn", "bars"),
)
def accent_coverage(spark, sf_dir):
    accents = ev.accent_candidates(ranked(spark, sf_dir))
    bars = chart_bars(spark, sf_dir).select("track", "bar", F.length("notes").alias("res"))
    return quality.accent_coverage(accents, timed_notes(spark, sf_dir), bars, ["track"])


# Charts against structure and sources ---------------------------------------------------
cte(
    "rhythm",
    """SELECT b.track, b.bar, coalesce(string_agg(n.pos / n.res::DOUBLE, '|' ORDER BY n.pos), '') AS rhythm, coalesce(string_agg((n.pos / n.res::DOUBLE) || ':' || n.note, '|' ORDER BY n.pos), '') AS rn,
  coalesce((SELECT string_agg((z.pos / z.res::DOUBLE) || ':' || z.note, '|' ORDER BY z.pos) FROM nt z WHERE z.track = b.track AND z.bar = b.bar), '') AS pattern, count(n.note) AS n
FROM bars b LEFT JOIN nn n ON n.track = b.track AND n.bar = b.bar GROUP BY b.track, b.bar""",
    "bars",
    "nn",
    "nt",
)
cte(
    "ranked_energy",
    """SELECT track, bar, energy, ((rank() OVER (PARTITION BY track ORDER BY energy)) - 1 + (count(*) OVER (PARTITION BY track, energy)) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY track)) AS energy_percentile FROM ctx""",
    "ctx",
)
cte(
    "sctx",
    """SELECT c.*, e.energy_percentile, r.rhythm, r.pattern, r.n / 48.0::DOUBLE AS nps, (c.bar % 8) / 7.0::DOUBLE AS phrase_progress FROM ctx c
JOIN ranked_energy e ON e.track = c.track AND e.bar = c.bar JOIN rhythm r ON r.track = c.track AND r.bar = c.bar""",
    "ctx",
    "ranked_energy",
    "rhythm",
)


def structured_bars(spark, sf_dir):
    rows = chart_bars(spark, sf_dir).join(bar_context(spark, sf_dir), ["track", "bar"])
    percentile = energy_rank(rows.select("track", "bar", "energy"), ["track"], "bar", "energy").select(
        "track", "bar", "energy_percentile"
    )
    return rows.drop("energy_delta").join(percentile, ["track", "bar"]).select(
        "*", charts.bar_nps().alias("nps"), ((F.col("bar") % 8) / 7.0).alias("phrase_progress")
    )


@plan(
    "energy_rank",
    "SELECT track, bar, energy_percentile, coalesce(energy_percentile - lag(energy_percentile) OVER (PARTITION BY track ORDER BY bar), 0) AS energy_delta FROM ranked_energy",
    ("ranked_energy",),
)
def energy_rank_plan(spark, sf_dir):
    rows = bar_context(spark, sf_dir).select("track", "bar", "energy")
    return energy_rank(rows, ["track"], "bar", "energy").select("track", "bar", "energy_percentile", "energy_delta")


_CORR = "CASE WHEN count(*) < 2 OR min({0}) = max({0}) OR min({1}) = max({1}) THEN 0 ELSE greatest(-1, least(1, corr({0}, {1}))) END"


@plan(
    "structure_quality",
    f"""
    WITH s AS (SELECT *, lag(pattern) OVER (PARTITION BY track ORDER BY bar) AS pv, role IN ('peak', 'drop', 'cadence') OR fill_candidate AS hl FROM sctx),
    p AS (SELECT track, phrase_id, bool_or(role = 'build_up') AS up, count(*) AS n, {_CORR.format('phrase_progress', 'nps')} AS r FROM s GROUP BY ALL),
    b AS (SELECT track, avg(r) AS m FROM p WHERE up AND n >= 2 GROUP BY track)
    SELECT s.track, {_r(_CORR.format('energy_percentile', 'nps'), 6)} AS structure_density_correlation,
      {_r("CASE WHEN count(*) FILTER (role = 'peak') > 0 THEN coalesce(avg(nps) FILTER (role = 'peak'), 0) - coalesce(avg(nps) FILTER (role IN ('stable', 'breakdown')), 0) ELSE 0 END", 6)} AS peak_contrast,
      coalesce({_r("count(*) FILTER (role = 'cadence' AND pv IS NOT NULL AND pattern <> pv) / nullif(count(*) FILTER (role = 'cadence' AND pv IS NOT NULL), 0)::DOUBLE", 6)}, 0) AS cadence_variation_rate,
      {_r("CASE WHEN count(*) FILTER (hl) > 0 THEN coalesce(avg(nps) FILTER (hl), 0) - coalesce(avg(nps) FILTER (NOT hl), 0) ELSE 0 END", 6)} AS highlight_note_contrast,
      {_r("coalesce(any_value(b.m), 0)", 6)} AS build_up_slope_agreement FROM s LEFT JOIN b ON b.track = s.track GROUP BY s.track
    """,
    ("sctx",),
)
def structure_quality(spark, sf_dir):
    return quality.structure_quality(structured_bars(spark, sf_dir), ["track"])


@plan(
    "motif_quality",
    f"""
    WITH c AS (SELECT track, section_id, rhythm, count(*) AS n FROM sctx GROUP BY ALL), s AS (SELECT track, section_id, max(n) AS t, sum(n) AS a FROM c GROUP BY ALL),
    m AS (SELECT track, sum(t) / sum(a)::DOUBLE AS v FROM s WHERE a >= 2 GROUP BY track),
    p AS (SELECT track, section_id, phrase_id, list(rhythm ORDER BY bar) AS l FROM sctx GROUP BY ALL), f AS (SELECT *, first_value(l) OVER (PARTITION BY track, section_id ORDER BY phrase_id) AS fl FROM p),
    r AS (SELECT track, sum((l <> fl)::INT) / nullif(count(*) - count(DISTINCT section_id), 0)::DOUBLE AS v FROM f GROUP BY track)
    SELECT t.track, {_r("coalesce(m.v, 1)", 6)} AS section_motif_consistency, {_r("coalesce(r.v, 0)", 6)} AS section_return_variation FROM (SELECT DISTINCT track FROM sctx) t LEFT JOIN m USING (track) LEFT JOIN r USING (track)
    """,
    ("sctx",),
)
def motif_quality(spark, sf_dir):
    return quality.motif_quality(structured_bars(spark, sf_dir), ["track"])


@plan(
    "resolution_quality",
    f"""
    WITH b AS (SELECT track, bar, res, bar // 8 AS ph, lag(res) OVER w AS pr, lag(bar // 8) OVER w AS pp FROM bars WINDOW w AS (PARTITION BY track ORDER BY bar)),
    m AS (SELECT track, res, row_number() OVER (PARTITION BY track ORDER BY count(*) DESC, min(bar)) AS rn FROM bars GROUP BY track, res)
    SELECT b.track, any_value(m.res) AS base_resolution, sum((pr <> b.res)::INT)::BIGINT AS resolution_change_count, {_r("sum((pr <> b.res)::INT) * 100 / count(*)::DOUBLE", 6)} AS changes_per_100_bars,
      {_r("sum((b.res > 16)::INT) / count(*)::DOUBLE", 6)} AS high_resolution_ratio, sum((pr = b.res AND pp <> ph)::INT)::BIGINT AS avoided_changes FROM b JOIN m ON m.track = b.track AND m.rn = 1 GROUP BY b.track
    """,
    ("bars",),
)
def resolution_quality(spark, sf_dir):
    rows = chart_bars(spark, sf_dir).withColumn("phrase_id", F.floor(F.col("bar") / 8))
    return quality.resolution_quality(rows, ["track"])


cte(
    "dom",
    f"""WITH u AS (SELECT track, bar, unnest([{{'n': 'vocals', 'v': vocal_activity}}, {{'n': 'drums', 'v': drum_activity}}, {{'n': 'bass', 'v': bass_activity}}, {{'n': 'other', 'v': accompaniment_activity}}], recursive := true) FROM ctx),
r AS (SELECT *, row_number() OVER (PARTITION BY track, bar ORDER BY v DESC, n) AS rn, lead(v) OVER (PARTITION BY track, bar ORDER BY v DESC, n) AS s FROM u)
SELECT track, bar, CASE WHEN v >= 0.12::DOUBLE AND v - s >= 0.08::DOUBLE THEN n ELSE '' END AS src, CASE WHEN v >= 0.12::DOUBLE AND v - s >= 0.08::DOUBLE THEN {_r("least(1.0::DOUBLE, v * 0.7::DOUBLE + (v - s) * 0.6::DOUBLE)", 3)} ELSE 0 END AS conf FROM r WHERE rn = 1""",
    "ctx",
)


@plan(
    "stem_quality",
    f"""
    WITH t AS (SELECT e.*, c.phrase_position, c.role, EXISTS (SELECT 1 FROM nn n WHERE n.track = e.track AND n.bar = e.bar AND n.pos = least(b.res - 1, round_even(e.tick / 48.0::DOUBLE * b.res, 0))) AS hit
      FROM evid e JOIN ctx c ON c.track = e.track AND c.bar = e.bar JOIN bars b ON b.track = e.track AND b.bar = e.bar),
    a AS (SELECT track, count(*) FILTER (drum >= 0.35) AS dc, count(*) FILTER (drum >= 0.35 AND hit) AS dh, count(*) FILTER (bass >= 0.35 AND tick % 12 = 0) AS bc, count(*) FILTER (bass >= 0.35 AND tick % 12 = 0 AND hit) AS bh,
      count(*) FILTER (vocal >= 0.35 AND (phrase_position IN ('phrase_start', 'phrase_end', 'song_end') OR role = 'cadence')) AS vc, count(*) FILTER (vocal >= 0.35 AND hit AND (phrase_position IN ('phrase_start', 'phrase_end', 'song_end') OR role = 'cadence')) AS vh FROM t GROUP BY track),
    x AS (SELECT track, bar, max(greatest(drum, accompaniment)) AS f FROM evid GROUP BY ALL),
    s AS (SELECT c.track, c.bar, d.src, d.conf, lag(d.src) OVER w AS ps, lag(d.conf) OVER w AS pc, c.rhythm, lag(c.rhythm) OVER w AS pr, greatest(vocal_activity, drum_activity, bass_activity, accompaniment_activity) > 0 AS loud,
      c.fill_candidate AND coalesce(x.f, 0) >= 0.35 AS fc, EXISTS (SELECT 1 FROM nt n WHERE n.track = c.track AND n.bar = c.bar AND n.note <> '8' AND n.pos >= n.res // 2) AS late
      FROM sctx c JOIN dom d ON d.track = c.track AND d.bar = c.bar LEFT JOIN x ON x.track = c.track AND x.bar = c.bar WINDOW w AS (PARTITION BY c.track ORDER BY c.bar)),
    b AS (SELECT track, count(*) FILTER (conf >= 0.4 AND pc >= 0.4 AND src <> ps) AS cc, count(*) FILTER (conf >= 0.4 AND pc >= 0.4 AND src <> ps AND rhythm <> pr) AS cr, count(*) FILTER (loud) AS eb, count(*) FILTER (loud AND conf >= 0.4) AS cb,
      count(*) FILTER (fc) AS fc, count(*) FILTER (fc AND late) AS fs FROM s GROUP BY track)
    SELECT b.track, coalesce({_r("dh / nullif(dc, 0)::DOUBLE", 6)}, 1) AS drum_onset_hit_coverage, coalesce({_r("bh / nullif(bc, 0)::DOUBLE", 6)}, 1) AS bass_downbeat_alignment, coalesce({_r("vh / nullif(vc, 0)::DOUBLE", 6)}, 1) AS vocal_phrase_response,
      coalesce({_r("cr / nullif(cc, 0)::DOUBLE", 6)}, 1) AS transition_response, coalesce({_r("cb / nullif(eb, 0)::DOUBLE", 6)}, 0) AS confident_bar_ratio, coalesce({_r("fs / nullif(fc, 0)::DOUBLE", 6)}, 1) AS fill_support FROM b LEFT JOIN a USING (track)
    """,
    ("evid", "ctx", "bars", "nn", "nt", "sctx", "dom"),
)
def stem_quality(spark, sf_dir):
    context = bar_context(spark, sf_dir)
    sources = {"vocals": "vocal_activity", "drums": "drum_activity", "bass": "bass_activity", "other": "accompaniment_activity"}
    dominant = binning.dominant_source(context, ["track", "bar"], sources)
    rest = context.select("track", "bar", "phrase_position", "role", "fill_candidate")
    bars = chart_bars(spark, sf_dir).join(dominant, ["track", "bar"]).join(rest, ["track", "bar"])
    return quality.stem_quality(bars, evidence(spark, sf_dir), notes_of(spark, sf_dir), ["track"])


@plan(
    "expected_bars",
    """
    WITH w AS (SELECT DISTINCT s.track, CAST(floor((s.start_s + s.end_s) / 2 / 48) AS INTEGER) AS bar FROM spans s), w2 AS (SELECT w.* FROM w JOIN bars b ON b.track = w.track AND b.bar = w.bar),
    j AS (SELECT coalesce(w2.track, r.track) AS track, w2.bar IS NOT NULL AS want, r.bar IS NOT NULL AS got, coalesce(r.start_tick >= 24 AND r.end_tick > r.start_tick, false) AS late FROM w2 FULL JOIN rbur r ON r.track = w2.track AND r.bar = w2.bar)
    SELECT track, sum(want::INT)::BIGINT AS expected_count, sum(got::INT)::BIGINT AS flagged_count, sum((want AND got)::INT)::BIGINT AS agreed_count, sum(late::INT)::BIGINT AS late_count, bool_and(want = got) AS exact FROM j GROUP BY track
    """,
    ("spans", "rbur", "bars"),
)
def expected_bars(spark, sf_dir):
    bars = chart_bars(spark, sf_dir)
    spans = charts.sustain_spans(charts.sustain_events(bars, ["track"]), ["track"])
    late = (F.col("start_tick") >= TICKS // 2) & (F.col("end_tick") > F.col("start_tick"))
    return quality.expected_bars(spans, bars, reliable_bursts(spark, sf_dir), ["track"], 48.0, late)
