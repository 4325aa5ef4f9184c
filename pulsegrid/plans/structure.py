"""Plans for boundaries, phrases, sections, fills, resolutions and lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.numeric import round_half_even
from pulsegrid.operators import binning, evidence as ev, structure as st
from pulsegrid.operators.sequences import energy_rank
from pulsegrid.plans.bindings import DAY, TICKS, evidence, timeline
from pulsegrid.plans.evidence import _r, bar_context, peaks, ranked, scored
from pulsegrid.plans.registry import cte, plan
from pulsegrid.plans.stages import stage
from pulsegrid.sources import exports

KEYS = ["track"]


def vectors(spark, sf_dir):
    """Structure vectors of the bars, staged."""
    return stage(spark, sf_dir, "vectors", lambda: build_vectors(spark, sf_dir))


def build_vectors(spark, sf_dir):
    context = bar_context(spark, sf_dir)
    found, points = scored(spark, sf_dir)
    percentile = energy_rank(context.select("track", "bar", "energy"), KEYS, "bar", "energy").select(
        "track", "bar", round_half_even(F.col("energy_percentile"), 6).alias("energy_percentile")
    )
    salience = ev.bar_salience(found, points, TICKS).select(
        "track", "bar", round_half_even(F.col("onset_evidence_count") / TICKS, 6).alias("onset_density")
    )
    activity = peaks(spark, sf_dir).groupBy("track", "bar").agg(round_half_even(F.sum("activity") / TICKS, 6).alias("activity_mean"))
    bands = binning.bar_summary(evidence(spark, sf_dir), KEYS, ["low", "mid", "high", "flux"], ["activity"]).select(
        "track", "bar", "low", "mid", "high", "flux"
    )
    profile = points.groupBy("track", "bar").agg(
        *[F.max(F.when(F.floor(F.col("tick") / 4) == i, F.col("hit")).otherwise(0.0)).alias(f"r{i}") for i in range(12)]
    )
    sources = {"vocals": "vocal_activity", "drums": "drum_activity", "bass": "bass_activity", "other": "accompaniment_activity"}
    dominant = binning.dominant_source(context, ["track", "bar"], sources).select("track", "bar", "dominant_source", "source_confidence")
    place = ["track", "bar"]
    joined = (
        context.select(
            *place,
            "brightness",
            "percussive_ratio",
            "vocal_activity",
            "drum_activity",
            "bass_activity",
            F.col("accompaniment_activity").alias("other_activity"),
            F.col("edge").alias("edge_silent"),
            ((F.col("bar") % 6) / 10.0).alias("harmonic_novelty"),
            ((F.col("bar") % 4) / 10.0).alias("texture_novelty"),
        )
        .join(percentile, place)
        .join(salience, place)
        .join(activity, place)
        .join(dominant, place)
        .join(bands, place, "left")
        .join(profile, place, "left")
    )
    return joined.fillna(0.0)


def scores(spark, sf_dir):
    return stage(spark, sf_dir, "boundary", lambda: st.boundary_scores(vectors(spark, sf_dir), KEYS))


def assigned(spark, sf_dir):
    def build():
        found = scores(spark, sf_dir)
        return st.assign_phrases(vectors(spark, sf_dir), st.phrase_bounds(found, KEYS), found, KEYS)

    return stage(spark, sf_dir, "assigned", build)


def phrases_of(spark, sf_dir):
    return stage(spark, sf_dir, "phrases", lambda: st.phrase_table(assigned(spark, sf_dir), KEYS))


_PROF = ", ".join(f"coalesce(max(CASE WHEN tick // 4 = {i} THEN hit ELSE 0 END), 0) AS r{i}" for i in range(12))
cte(
    "vec",
    f"""SELECT c.track, c.bar, brightness, percussive_ratio, vocal_activity, drum_activity, bass_activity, accompaniment_activity AS other_activity, c.edge AS edge_silent, (c.bar % 6) / 10.0::DOUBLE AS harmonic_novelty, (c.bar % 4) / 10.0::DOUBLE AS texture_novelty,
  {_r("e.energy_percentile", 6)} AS energy_percentile, {_r("s.onset_evidence_count / 48.0::DOUBLE", 6)} AS onset_density, a.activity_mean, nullif(d.src, '') AS dominant_source, d.conf AS source_confidence, coalesce(b.low, 0) AS low, coalesce(b.mid, 0) AS mid, coalesce(b.high, 0) AS high, coalesce(b.flux, 0) AS flux,
  {", ".join(f"coalesce(p.r{i}, 0) AS r{i}" for i in range(12))}
FROM ctx c JOIN ranked_energy e ON e.track = c.track AND e.bar = c.bar JOIN sal s ON s.track = c.track AND s.bar = c.bar JOIN dom d ON d.track = c.track AND d.bar = c.bar
JOIN (SELECT track, bar, {_r("avg(activity)", 6)} AS activity_mean FROM pk GROUP BY track, bar) a ON a.track = c.track AND a.bar = c.bar
LEFT JOIN (SELECT track, bar, {_r("max(low)", 3)} AS low, {_r("max(mid)", 3)} AS mid, {_r("max(high)", 3)} AS high, {_r("max(flux)", 3)} AS flux FROM evid GROUP BY track, bar) b ON b.track = c.track AND b.bar = c.bar
LEFT JOIN (SELECT track, bar, {_PROF} FROM hits GROUP BY track, bar) p ON p.track = c.track AND p.bar = c.bar""",
    "ctx",
    "ranked_energy",
    "sal",
    "dom",
    "pk",
    "evid",
    "hits",
)
_SPEC = "(greatest(low, mid, high, flux, brightness, harmonic_novelty, texture_novelty, percussive_ratio) > 0)"
_SRC = "(greatest(vocal_activity, drum_activity, bass_activity, other_activity) > 0)"
_SI = "least(1.0::DOUBLE, drum_activity * 0.35::DOUBLE + bass_activity * 0.25::DOUBLE + other_activity * 0.25::DOUBLE + vocal_activity * 0.15::DOUBLE)"
_SPI = "least(1.0::DOUBLE, flux * 0.35::DOUBLE + percussive_ratio * 0.25::DOUBLE + brightness * 0.15::DOUBLE + greatest(low, mid, high) * 0.25::DOUBLE)"
_DRIVE = "least(1.0::DOUBLE, onset_density * 4)"
_COMB = f"least(1.0::DOUBLE, energy_percentile * 0.45::DOUBLE + {_DRIVE} * 0.35::DOUBLE + activity_mean * 0.20::DOUBLE + (CASE WHEN {_SPEC} THEN (flux * 0.45::DOUBLE + percussive_ratio * 0.30::DOUBLE + greatest(low, mid, high) * 0.25::DOUBLE) * 0.12::DOUBLE ELSE 0 END) + {_SI} * 0.10::DOUBLE)"


def _gap(x):
    return f"abs(avg({x}) OVER l - avg({x}) OVER r)"


def _dist(names):
    return "(" + " + ".join(_gap(n) for n in names) + f") / {len(names)}"


cte(
    "bsc",
    f"""SELECT track, bar, {_r("least(1.0::DOUBLE, CASE WHEN x THEN greatest(s4, 0.9::DOUBLE) ELSE s4 END)", 6)} AS score FROM (
  SELECT *, CASE WHEN ins AND s >= 0.55::DOUBLE THEN greatest(s3, 0.5::DOUBLE + s * 0.15::DOUBLE) ELSE s3 END AS s4 FROM (
  SELECT *, CASE WHEN ins THEN greatest(s2, s2 * 0.8::DOUBLE + least(1.0::DOUBLE, i * 0.55::DOUBLE + v * 0.25::DOUBLE + s * 0.35::DOUBLE) * 0.55::DOUBLE) ELSE s2 END AS s3 FROM (
  SELECT *, CASE WHEN sp THEN greatest(s1, s1 * 0.75::DOUBLE + least(1.0::DOUBLE, t * 0.65::DOUBLE + n * 0.35::DOUBLE) * 0.55::DOUBLE) ELSE s1 END AS s2 FROM (
  SELECT *, e * 0.30::DOUBLE + o * 0.20::DOUBLE + a * 0.15::DOUBLE + rr * 0.25::DOUBLE + d * 0.10::DOUBLE AS s1 FROM (
  SELECT track, bar, {_gap("energy_percentile")} AS e, {_gap("drv")} AS o, {_gap("activity_mean")} AS a, {_dist(st.PROFILE)} AS rr, abs(comb - lag(comb) OVER w) AS d, bool_or(hs) OVER b AS sp, {_dist(st.TIMBRE)} AS t, greatest(harmonic_novelty, texture_novelty) AS n,
    bool_or(hi) OVER b AS ins, {_dist(st.SOURCES)} AS i, abs(vocal_activity - lag(vocal_activity) OVER w) AS v, CASE WHEN dominant_source IS NULL OR lag(dominant_source) OVER w IS NULL OR dominant_source = lag(dominant_source) OVER w THEN 0.0::DOUBLE ELSE least(source_confidence, lag(source_confidence) OVER w) END AS s,
    edge_silent <> lag(edge_silent) OVER w AS x, lag(bar) OVER w AS pb FROM (SELECT *, {_DRIVE} AS drv, {_COMB} AS comb, {_SPEC} AS hs, {_SRC} AS hi FROM vec)
  WINDOW w AS (PARTITION BY track ORDER BY bar), l AS (PARTITION BY track ORDER BY bar ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY track ORDER BY bar ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), b AS (PARTITION BY track ORDER BY bar ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING))
  WHERE pb IS NOT NULL))))""",
    "vec",
)
cte(
    "bcand",
    """SELECT track, list({'b': bar, 's': score} ORDER BY bar) AS l, any_value(n) AS n FROM (SELECT *, coalesce(lag(score) OVER w, -1) AS p, coalesce(lead(score) OVER w, -1) AS f, max(bar) OVER (PARTITION BY track) + 1 AS n FROM bsc WINDOW w AS (PARTITION BY track ORDER BY bar))
WHERE score >= 0.40::DOUBLE AND score >= p AND score >= f AND bar >= 2 AND n - bar >= 2 GROUP BY track""",
    "bsc",
)
cte(
    "bsel",
    """SELECT track, l, n, 1::BIGINT AS i, []::INTEGER[] AS sel, 0.0::DOUBLE AS ls FROM bcand
UNION ALL SELECT track, l, n, i + 1, CASE WHEN len(sel) > 0 AND l[i].b - sel[-1] < 2 THEN CASE WHEN l[i].s > ls THEN list_append(sel[:-2], l[i].b) ELSE sel END ELSE list_append(sel, l[i].b) END,
  CASE WHEN len(sel) > 0 AND l[i].b - sel[-1] < 2 AND l[i].s <= ls THEN ls ELSE l[i].s END FROM bsel WHERE i <= len(l)""",
    "bcand",
)
cte(
    "seg0",
    """SELECT track, s, coalesce(lead(s) OVER (PARTITION BY track ORDER BY s), n) AS e FROM (SELECT t.track, t.n, unnest(list_concat([0], coalesce(b.sel, []::INTEGER[]))) AS s FROM (SELECT track, max(bar) + 1 AS n FROM bsc GROUP BY track) t
  LEFT JOIN (SELECT * FROM bsel WHERE i = len(l) + 1) b ON b.track = t.track)""",
    "bsel",
    "bsc",
)
cte(
    "segs",
    """SELECT track, s, e FROM seg0 UNION ALL SELECT g.track, (SELECT arg_min(k.bar, (-round(k.score + CASE k.bar - g.s WHEN 8 THEN 0.04::DOUBLE WHEN 4 THEN 0.02::DOUBLE ELSE 0 END, 9), abs(k.bar - g.s - 8), k.bar)) FROM bsc k WHERE k.track = g.track AND k.bar BETWEEN g.s + 2 AND least(g.e - 2, g.s + 16)), g.e FROM segs g WHERE g.e - g.s > 16""",
    "seg0",
    "bsc",
)


@plan("boundary_score", "SELECT track, bar, score FROM bsc", ("bsc",))
def boundary_score(spark, sf_dir):
    return scores(spark, sf_dir)


@plan("phrase_bounds", "SELECT DISTINCT track, s AS start_bar FROM segs", ("segs",), recursive=True)
def phrase_bounds(spark, sf_dir):
    return st.phrase_bounds(scores(spark, sf_dir), KEYS)


cte(
    "asg",
    """SELECT v.*, g.ph AS phrase_id, g.s AS ps, g.n AS pn, CASE WHEN g.n = 1 THEN 'single' WHEN v.bar = g.s THEN 'start' WHEN v.bar = g.s + g.n - 1 THEN 'end' ELSE 'middle' END AS phrase_position,
  CASE WHEN g.n = 1 THEN 0 ELSE round_even((v.bar - g.s) / (g.n - 1)::DOUBLE * 1000000, 0) / 1000000 END AS phrase_progress, CASE WHEN v.bar < g.s + g.n - 1 THEN 0.0::DOUBLE WHEN g.last THEN 1.0::DOUBLE ELSE coalesce(b.score, 0) END AS boundary_confidence
FROM vec v JOIN (SELECT track, s, row_number() OVER w - 1 AS ph, coalesce(lead(s) OVER w, mx + 1) - s AS n, lead(s) OVER w IS NULL AS last FROM (SELECT DISTINCT g.track, g.s, m.mx FROM segs g JOIN (SELECT track, max(bar) AS mx FROM vec GROUP BY track) m ON m.track = g.track) WINDOW w AS (PARTITION BY track ORDER BY s)) g
  ON g.track = v.track AND v.bar BETWEEN g.s AND g.s + g.n - 1 LEFT JOIN bsc b ON b.track = v.track AND b.bar = v.bar + 1""",
    "vec",
    "segs",
    "bsc",
)


def _trend(x):
    return f"CASE WHEN count(*) < 2 THEN 0 ELSE greatest(-1, least(1, coalesce(regr_slope({x}, bar), 0))) END"


cte(
    "phr",
    f"""SELECT *, CASE WHEN act >= 0.18 AND ((mean_energy <= 0.4 AND ons <= 0.08) OR (sp AND perc <= 0.25 AND fl <= 0.35 AND ons <= 0.12) OR (ins AND greatest(voc, oth) >= 0.25 AND dru <= 0.22 AND bas <= 0.22)) THEN 'breakdown'
  WHEN energy_trend >= 0.055 OR (energy_trend >= -0.02 AND ((sp AND spt >= 0.055) OR (ins AND it >= 0.055))) THEN 'build_up'
  WHEN mean_energy >= 0.72 OR peak_energy >= 0.88 OR (sp AND mean_energy >= 0.6 AND spm >= 0.7) OR (ins AND dru >= 0.55 AND bas >= 0.35 AND greatest(voc, oth) >= 0.45) THEN 'peak' ELSE 'stable' END AS primary_role
FROM (SELECT track, phrase_id, min(bar) AS start_bar, max(bar) AS end_bar, avg(energy_percentile) AS mean_energy, max(energy_percentile) AS peak_energy, {_trend("energy_percentile")} AS energy_trend, avg(activity_mean) AS act, avg(onset_density) AS ons, bool_or({_SPEC}) AS sp,
  avg(percussive_ratio) AS perc, avg(flux) AS fl, {_trend(_SPI)} AS spt, avg({_SPI}) AS spm, bool_or({_SRC}) AS ins, {_trend(_SI)} AS it, avg(drum_activity) AS dru, avg(bass_activity) AS bas, avg(vocal_activity) AS voc, avg(other_activity) AS oth, max(boundary_confidence) AS ending_confidence,
  [avg(energy_percentile), avg({_DRIVE}), avg(activity_mean), avg(vocal_activity), avg(drum_activity), avg(bass_activity), avg(other_activity), {", ".join(f"avg(r{i})" for i in range(12))}] AS signature FROM asg GROUP BY track, phrase_id)""",
    "asg",
)


@plan(
    "phrases",
    f"SELECT track, phrase_id::BIGINT AS phrase_id, start_bar, end_bar, {_r('mean_energy', 6)} AS mean_energy, {_r('peak_energy', 6)} AS peak_energy, {_r('energy_trend', 6)} AS energy_trend, {_r('ending_confidence', 6)} AS ending_confidence, primary_role, {_r('list_sum(signature)', 6)} AS signature_sum FROM phr",
    ("phr",),
    recursive=True,
)
def phrases(spark, sf_dir):
    rows = phrases_of(spark, sf_dir)
    total = F.aggregate("signature", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "track",
        "phrase_id",
        "start_bar",
        "end_bar",
        *[round_half_even(F.col(n), 6).alias(n) for n in ("mean_energy", "peak_energy", "energy_trend", "ending_confidence")],
        "primary_role",
        round_half_even(total, 6).alias("signature_sum"),
    )


_ROLES = f"""
    WITH a AS (SELECT g.*, p.primary_role AS pr, p.energy_trend AS tr, {_COMB} AS dv FROM asg g JOIN phr p ON p.track = g.track AND p.phrase_id = g.phrase_id),
    n AS (SELECT *, dv - lag(dv) OVER w AS dl, CASE WHEN lag(phrase_id) OVER w <> phrase_id THEN lag(pr) OVER w END AS br, lag(boundary_confidence) OVER w AS bb, greatest(coalesce(lag(energy_percentile) OVER w, 0), coalesce(lead(energy_percentile) OVER w, 0)) AS ar,
      coalesce(least(1.0::DOUBLE, greatest(0, lag(vocal_activity) OVER w - vocal_activity) * 0.55::DOUBLE + greatest(0, drum_activity - lag(drum_activity) OVER w) * 0.45::DOUBLE + greatest(0, other_activity - lag(other_activity) OVER w) * 0.30::DOUBLE + drum_activity * 0.15::DOUBLE), 0) AS cue FROM a WINDOW w AS (PARTITION BY track ORDER BY bar)),
    m AS (SELECT *, CASE WHEN lag(bar) OVER (PARTITION BY track ORDER BY bar) IS NULL THEN 0 ELSE cue END AS cue2 FROM n),
    x AS (SELECT *, CASE WHEN edge_silent THEN 'stable' WHEN dl IS NOT NULL AND phrase_position = 'start' AND abs(dl) >= 0.28 AND (coalesce(br IN ('build_up', 'peak'), false) OR bb >= 0.5) THEN 'drop'
        WHEN (energy_percentile >= 0.82 OR (energy_percentile >= 0.65 AND flux >= 0.75 AND percussive_ratio >= 0.55) OR (drum_activity >= 0.7 AND bass_activity >= 0.45 AND greatest(vocal_activity, other_activity) >= 0.5)) AND energy_percentile >= ar THEN 'peak'
        WHEN pr = 'breakdown' OR (energy_percentile <= 0.4 AND activity_mean >= 0.18 AND (onset_density <= 0.08 OR ({_SPEC} AND percussive_ratio <= 0.25 AND flux <= 0.35) OR ({_SRC} AND greatest(vocal_activity, other_activity) >= 0.25 AND drum_activity <= 0.22 AND bass_activity <= 0.22))) THEN 'breakdown'
        WHEN pr = 'build_up' AND phrase_progress < 1 THEN 'build_up' WHEN phrase_position IN ('end', 'single') AND (boundary_confidence >= 0.46 OR cue2 >= 0.45) THEN 'cadence' ELSE 'stable' END AS role FROM m)"""

cte("rol", _ROLES + "\nSELECT * FROM x", "asg", "phr")


@plan(
    "transition_role",
    f"""
    SELECT track, bar, phrase_id::BIGINT AS phrase_id, role AS transition_role, {_r("CASE WHEN edge_silent THEN 0.2::DOUBLE WHEN role = 'drop' THEN least(1.0::DOUBLE, abs(dl) + 0.35::DOUBLE) WHEN role = 'peak' THEN energy_percentile WHEN role = 'breakdown' THEN least(1.0::DOUBLE, 0.55::DOUBLE + activity_mean) WHEN role = 'build_up' THEN least(1.0::DOUBLE, 0.55::DOUBLE + greatest(0, tr) * 4) WHEN role = 'cadence' THEN greatest(boundary_confidence, cue2) ELSE greatest(0.35::DOUBLE, 1 - abs(coalesce(dl, 0))) END", 6)} AS transition_confidence FROM rol
    """,
    ("rol",),
    recursive=True,
)
def transition_role(spark, sf_dir):
    return roles_of(spark, sf_dir).select("track", "bar", "phrase_id", "transition_role", "transition_confidence")


def roles_of(spark, sf_dir):
    return stage(spark, sf_dir, "roles", lambda: st.transition_roles(assigned(spark, sf_dir), phrases_of(spark, sf_dir), KEYS))


cte("pk_phr", "SELECT track, phrase_id, signature, mean_energy, row_number() OVER (PARTITION BY track ORDER BY phrase_id) AS k FROM phr", "phr")
# Each phrase joins the first of the most similar running centres, or opens one.
cte(
    "secwalk",
    f"""SELECT DISTINCT track, 0::BIGINT AS k, []::STRUCT(total DOUBLE[], members INTEGER)[] AS op, NULL::BIGINT AS phrase_id, NULL::BIGINT AS ix, NULL::DOUBLE AS conf FROM pk_phr
UNION ALL SELECT track, k, CASE WHEN jn THEN list_transform(op, lambda o, i: CASE WHEN i = ps THEN {{'total': list_transform(range(1, 20), lambda j: o.total[j] + sg[j]), 'members': o.members + 1}} ELSE o END) ELSE list_append(op, {{'total': sg, 'members': 1}}) END,
  phrase_id, CASE WHEN jn THEN ps - 1 ELSE len(op) END, CASE WHEN jn THEN lk[ps] ELSE 0.6::DOUBLE END
FROM (SELECT *, coalesce(lk[ps] >= {st.SIMILAR}::DOUBLE, false) AS jn FROM (SELECT *, list_position(lk, list_max(lk)) AS ps FROM (SELECT w.track, p.k, w.op, p.phrase_id, p.signature AS sg, list_transform(w.op, lambda o: 1 - list_sum(list_transform(range(1, 20), lambda j: abs(o.total[j] / o.members - p.signature[j]))) / 19) AS lk
  FROM secwalk w JOIN pk_phr p ON p.track = w.track AND p.k = w.k + 1)))""",
    "pk_phr",
)


_SECTIONS = f"""
    WITH g AS (SELECT track, phrase_id, ix, conf FROM secwalk WHERE k > 0), a AS (SELECT track, phrase_id, avg(activity_mean) AS act, avg(vocal_activity) AS voc, avg(drum_activity) AS dru, avg(bass_activity) AS bas, avg(other_activity) AS oth FROM asg GROUP BY ALL),
    m AS (SELECT g.track, g.ix, count(*) AS n, min(g.phrase_id) AS fp, avg(p.mean_energy) AS e, avg(act) AS act, avg(voc) AS voc, avg(dru) AS dru, avg(bas) AS bas, avg(oth) AS oth FROM g JOIN pk_phr p ON p.track = g.track AND p.phrase_id = g.phrase_id JOIN a ON a.track = g.track AND a.phrase_id = g.phrase_id GROUP BY ALL),
    l AS (SELECT track, max(phrase_id) AS lp FROM pk_phr GROUP BY track),
    t AS (SELECT m.track, ix, CASE WHEN n = 1 AND fp = 0 THEN 'intro' WHEN n = 1 AND fp = lp THEN 'outro' WHEN e <= 0.35::DOUBLE AND act < 0.35::DOUBLE AND voc < 0.15::DOUBLE THEN 'break'
      WHEN e >= 0.65::DOUBLE OR (voc >= 0.35::DOUBLE AND dru >= 0.45::DOUBLE AND bas >= 0.25::DOUBLE AND oth >= 0.35::DOUBLE) THEN 'chorus' ELSE 'verse' END AS section FROM m JOIN l USING (track))
    SELECT g.track, g.phrase_id, 'section-' || (g.ix + 1) AS section_id, section, {_r("conf", 6)} AS section_confidence FROM g JOIN t ON t.track = g.track AND t.ix = g.ix
    """
cte("sect", _SECTIONS, *("secwalk", "pk_phr", "asg"))


@plan("sections", _SECTIONS, ("secwalk", "pk_phr", "asg"), recursive=True)
def sections(spark, sf_dir):
    return st.sections(phrases_of(spark, sf_dir), assigned(spark, sf_dir), KEYS)


_FILL_CANDIDATES = f"""
    WITH h AS (SELECT track, phrase_id, bool_or(role = 'build_up') AS r1, bool_or(role = 'peak') AS r2, bool_or(role = 'drop') AS r3, bool_or(role = 'breakdown') AS r4, bool_or(role = 'cadence') AS r5 FROM rol GROUP BY ALL),
    f AS (SELECT p.*, CASE WHEN r1 THEN 'build_up' WHEN r2 THEN 'peak' WHEN r3 THEN 'drop' WHEN r4 THEN 'breakdown' WHEN r5 THEN 'cadence' ELSE primary_role END AS fr FROM phr p JOIN h ON h.track = p.track AND h.phrase_id = p.phrase_id),
    n AS (SELECT track, end_bar, ending_confidence, abs(lead(mean_energy) OVER w - mean_energy) AS ch, lead(fr) OVER w AS nx, lead(phrase_id) OVER w IS NULL AS fin FROM f WINDOW w AS (PARTITION BY track ORDER BY phrase_id)),
    z AS (SELECT track, count(*) AS bars FROM rol GROUP BY track),
    s AS (SELECT r.track, r.bar, bars, edge_silent, role, n.ending_confidence * 0.30::DOUBLE + {_DRIVE} * 0.15::DOUBLE + coalesce(ch, 0) * 0.20::DOUBLE + CASE WHEN nx IN ('peak', 'drop') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN fin THEN CASE WHEN bars >= 4 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END ELSE 0 END
      + CASE WHEN {_SPEC} THEN least(0.15::DOUBLE, flux * 0.06::DOUBLE + texture_novelty * 0.05::DOUBLE + high * 0.04::DOUBLE) ELSE 0 END + CASE WHEN {_SRC} THEN least(0.15::DOUBLE, cue2 * 0.10::DOUBLE + drum_activity * 0.03::DOUBLE + other_activity * 0.02::DOUBLE) ELSE 0 END
      + CASE WHEN role IN ('cadence', 'peak') THEN 0.10::DOUBLE ELSE 0 END AS sc FROM n JOIN rol r ON r.track = n.track AND r.bar = n.end_bar JOIN z ON z.track = r.track),
    t AS (SELECT *, {_r("least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN edge_silent THEN 0 WHEN role = 'breakdown' THEN sc * 0.55::DOUBLE ELSE sc END))", 6)} AS x FROM s),
    k AS (SELECT *, x >= {st.FILL}::DOUBLE AND row_number() OVER (PARTITION BY track ORDER BY x >= {st.FILL}::DOUBLE DESC, x DESC, bar) <= greatest(1, ceil(bars / 6.0::DOUBLE)) AS kept FROM t)
    SELECT track, bar, {_r(f"CASE WHEN kept THEN x ELSE least(x, {st.FILL - 0.001}::DOUBLE) END", 6)} AS fill_score, kept AS fill_candidate FROM k
    """
cte("fillc", _FILL_CANDIDATES, *("rol", "phr"))


@plan("fill_candidates", _FILL_CANDIDATES, ("rol", "phr"), recursive=True)
def fill_candidates(spark, sf_dir):
    roles = roles_of(spark, sf_dir)
    return st.fill_candidates(roles, st.dominant_roles(roles, phrases_of(spark, sf_dir), KEYS), KEYS)


@plan(
    "structure_confidence",
    f"""
    WITH b AS (SELECT DISTINCT g.track, g.s, k.score FROM segs g LEFT JOIN bsc k ON k.track = g.track AND k.bar = g.s WHERE g.s > 0), m AS (SELECT track, max(score) AS mx FROM bsc GROUP BY track)
    SELECT m.track, count(b.s) AS boundary_count, {_r("CASE WHEN count(b.s) = 0 THEN least(0.45::DOUBLE, any_value(mx) * 0.6::DOUBLE) ELSE least(1, avg(coalesce(b.score, 0))) END", 6)} AS structure_confidence FROM m LEFT JOIN b ON b.track = m.track GROUP BY m.track
    """,
    ("segs", "bsc"),
    recursive=True,
)
def structure_confidence(spark, sf_dir):
    found = scores(spark, sf_dir)
    return st.structure_confidence(found, st.phrase_bounds(found, KEYS), KEYS)


@plan(
    "phrase_similarity",
    f"""
    WITH p AS (SELECT *, lag(signature) OVER w AS a, lead(signature) OVER w AS z FROM phr WINDOW w AS (PARTITION BY track ORDER BY phrase_id))
    SELECT track, phrase_id::BIGINT AS phrase_id, start_bar, end_bar, {_r("1 - list_sum(list_transform(range(1, 20), lambda i: abs(signature[i] - a[i]))) / 19", 6)} AS previous_similarity, {_r("1 - list_sum(list_transform(range(1, 20), lambda i: abs(signature[i] - z[i]))) / 19", 6)} AS next_similarity FROM p
    """,
    ("phr",),
    recursive=True,
)
def phrase_similarity(spark, sf_dir):
    return st.phrase_similarity(phrases_of(spark, sf_dir), KEYS)


@plan(
    "phrase_ranges",
    """
    WITH c AS (SELECT track, bar, CASE WHEN track % 3 = 0 THEN 0 ELSE bar // 8 END AS ph, track % 3 = 1 AND bar % 8 = 4 AS ex FROM bars), s AS (SELECT *, CASE WHEN lag(bar) OVER w IS NOT NULL AND (lag(ph) OVER w <> ph OR ex) THEN 1 ELSE 0 END AS st, row_number() OVER w - 1 AS i FROM c WINDOW w AS (PARTITION BY track ORDER BY bar)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY track ORDER BY bar ROWS UNBOUNDED PRECEDING) AS rg, sum(st) OVER (PARTITION BY track) AS m, count(*) OVER (PARTITION BY track) AS n FROM s)
    SELECT track, (CASE WHEN m = 0 AND n > 4 THEN i // 4 ELSE rg END)::BIGINT AS range_no, min(bar) AS start_bar, max(bar) AS end_bar FROM r GROUP BY ALL
    """,
    ("bars",),
)
def phrase_ranges(spark, sf_dir):
    from pulsegrid.plans.bindings import chart_bars

    t, b = F.col("track"), F.col("bar")
    bars = chart_bars(spark, sf_dir).select(
        "track",
        "bar",
        F.when(t % 3 == 0, 0).otherwise(F.floor(b / 8)).alias("phrase_id"),
        F.when((t % 3 == 1) & (b % 8 == 4), "phrase_start").otherwise("phrase_middle").alias("phrase_position"),
    )
    return st.phrase_ranges(bars, KEYS)


# Resolutions: weighted onsets of the events table on 48 ticks per day ---------------------
cte(
    "smp",
    """SELECT track, t // 86400000000 AS bar, (t % 86400000000) / 86400000000.0::DOUBLE * 48 + (t // 86400000000) * 48 AS p, value / max(value) OVER (PARTITION BY track) AS w FROM ev QUALIFY w >= 0.15::DOUBLE""",
    "ev",
)


def samples(spark, sf_dir):
    events = timeline(spark, sf_dir)
    top = events.groupBy("track").agg(F.max("value").alias("top"))
    day = F.floor(F.col("t") / DAY)
    rows = events.join(top, KEYS).select(
        "track", day.alias("bar"), ((F.col("t") % DAY) / float(DAY) * 48 + day * 48).alias("position"), (F.col("value") / F.col("top")).alias("weight")
    )
    return rows.filter(F.col("weight") >= 0.15)


def _err(n):
    return _r(f"sum(abs(p - round_even(p / {48 / n}::DOUBLE, 0) * {48 / n}::DOUBLE) * w) / sum(w)", 9)


@plan(
    "resolution_choice",
    f"""
    WITH e AS (SELECT track, count(*) AS evidence_count, {_err(16)} AS error_16, {_err(24)} AS error_24, {_err(48)} AS error_48 FROM smp GROUP BY track),
    c AS (SELECT *, CASE WHEN error_16 <= 0.2 THEN 16 WHEN error_24 <= 0.2 THEN 24 WHEN error_48 <= 0.2 THEN 48 WHEN error_16 <= least(error_16, error_24, error_48) + 0.05::DOUBLE THEN 16 WHEN error_24 <= least(error_16, error_24, error_48) + 0.05::DOUBLE THEN 24 ELSE 48 END AS resolution FROM e)
    SELECT *, {_r("CASE resolution WHEN 16 THEN 1 - least(1.0::DOUBLE, error_16 / 0.2::DOUBLE) WHEN 24 THEN least(1.0::DOUBLE, greatest(0, error_16 - error_24) / greatest(0.2::DOUBLE, error_16)) ELSE least(1.0::DOUBLE, greatest(0, error_24 - error_48) / greatest(0.2::DOUBLE, error_24)) END", 6)} AS confidence FROM c
    """,
    ("smp",),
)
def resolution_choice(spark, sf_dir):
    return st.resolution_choice(samples(spark, sf_dir), KEYS)


def _plain_err(n):
    return f"sum(abs(p - round_even(p / {48 / n}::DOUBLE, 0) * {48 / n}::DOUBLE) * w) / sum(w)"


_COARSEST = "CASE WHEN coalesce(e16, 0) <= 0.2::DOUBLE THEN 16 WHEN coalesce(e24, 0) <= 0.2::DOUBLE THEN 24 ELSE 48 END"


@plan(
    "resolution_plan",
    f"""
    WITH d AS (SELECT track, max(bar) AS last FROM smp GROUP BY track), b0 AS (SELECT track, unnest(range(0, last + 1)) AS bar FROM d),
    b AS (SELECT track, bar, bar // 10 AS ph, (bar // 10) % 2 AS sec, lag(CASE WHEN bar % 10 = 9 THEN 0.5 ELSE 0 END) OVER (PARTITION BY track ORDER BY bar) AS before FROM b0),
    e AS (SELECT track, bar // 10 AS ph, count(*) AS n, {_plain_err(16)} AS e16, {_plain_err(24)} AS e24, {_plain_err(48)} AS e48 FROM smp GROUP BY ALL),
    p AS (SELECT b.track, b.ph, any_value(sec) AS sec, count(*) AS bars, list(before ORDER BY bar)[1] AS before FROM b GROUP BY b.track, b.ph),
    q AS (SELECT p.*, e16, e24, e48, CASE WHEN coalesce(n, 0) >= 4 THEN {_COARSEST} ELSE 16 END AS need FROM p LEFT JOIN e ON e.track = p.track AND e.ph = p.ph),
    v AS (SELECT track, need, sum(bars) AS w FROM q GROUP BY ALL), bs AS (SELECT track, arg_max(need, (w, -need)) AS base FROM v GROUP BY track),
    sh AS (SELECT track, count(*) AS phrases, min(bars) AS short FROM q GROUP BY track), sn AS (SELECT track, sec, max(need) AS sneed FROM q GROUP BY ALL),
    j AS (SELECT q.*, base, greatest(need, sneed, base) AS target, phrases >= 2 AND short >= 2 AS usable, coalesce(CASE base WHEN 16 THEN e16 WHEN 24 THEN e24 ELSE e48 END, 0) AS berr FROM q JOIN bs USING (track) JOIN sh USING (track) JOIN sn ON sn.track = q.track AND sn.sec = q.sec),
    k AS (SELECT *, target > base AND berr >= 0.35::DOUBLE AND (before IS NULL OR before >= 0.4::DOUBLE) AS lifted FROM j),
    r AS (SELECT b.track, b.bar, usable, lifted, CASE WHEN lifted THEN target ELSE base END AS res FROM b JOIN k ON k.track = b.track AND k.ph = b.ph),
    c AS (SELECT *, coalesce(lag(res) OVER (PARTITION BY track ORDER BY bar) <> res, false) AS ch FROM r),
    t AS (SELECT track, count(*) FILTER (ch) AS changes, max(res) AS top, bool_or(lifted) AS any_l, count(*) AS n FROM c GROUP BY track),
    g0 AS (SELECT track, {_err(16)} AS x16, {_err(24)} AS x24, {_err(48)} AS x48 FROM smp GROUP BY track),
    g AS (SELECT track, CASE WHEN x16 <= 0.2 THEN 16 WHEN x24 <= 0.2 THEN 24 WHEN x48 <= 0.2 THEN 48 WHEN x16 <= least(x16, x24, x48) + 0.05::DOUBLE THEN 16 WHEN x24 <= least(x16, x24, x48) + 0.05::DOUBLE THEN 24 ELSE 48 END AS whole FROM g0)
    SELECT c.track, c.bar, (CASE WHEN NOT usable THEN coalesce(whole, 16) WHEN changes > greatest(2, t.n // 8) THEN top WHEN NOT any_l THEN coalesce(whole, 16) ELSE res END)::INTEGER AS resolution FROM c JOIN t USING (track) LEFT JOIN g USING (track)
    """,
    ("smp",),
)
def resolution_plan(spark, sf_dir):
    found = samples(spark, sf_dir)
    b = F.col("bar")
    days = found.groupBy("track").agg(F.max("bar").cast("long").alias("last"))
    days = days.select("track", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bar"))
    bars = days.select(
        "track",
        "bar",
        F.floor(b / 10).alias("phrase_id"),
        F.concat(F.lit("section-"), (F.floor(b / 10) % 2).cast("string")).alias("section_id"),
        F.when(b % 10 == 9, 0.5).otherwise(0.0).alias("boundary_confidence"),
    )
    return st.resolution_plan(found, bars, st.resolution_choice(found, KEYS), KEYS)


@plan(
    "resolution_adequacy",
    f"""
    WITH e AS (SELECT n.track, n.bar, n.tick * 1.0::DOUBLE AS ps, CASE WHEN n.bar % 3 = 0 THEN 16 WHEN n.bar % 3 = 1 THEN 24 ELSE 48 END AS res FROM nt n),
    b AS (SELECT track, bar, any_value(res) AS res, count(*) AS n, sum((abs(ps - round_even(ps / (48.0::DOUBLE / res), 0) * (48.0::DOUBLE / res)) <= 1e-6)::INT) AS ok, sum(abs(ps - round_even(ps / (48.0::DOUBLE / res), 0) * (48.0::DOUBLE / res))) AS er, max(abs(ps - round_even(ps / (48.0::DOUBLE / res), 0) * (48.0::DOUBLE / res))) AS mx,
      CASE WHEN bool_and(ps % 3 = 0) THEN 16 WHEN bool_and(ps % 2 = 0) THEN 24 ELSE 48 END AS ls FROM e GROUP BY track, bar)
    SELECT track, count(*) AS evaluated_bar_count, sum(n)::BIGINT AS evaluated_event_count, sum(ok)::BIGINT AS expressible_event_count, {_r("sum(ok) / sum(n)::DOUBLE", 6)} AS expressible_ratio, {_r("sum(er) / sum(n)", 6)} AS mean_error_s, {_r("max(mx)", 6)} AS max_error_s,
      sum((ok < n)::INT)::BIGINT AS under_resolved_bar_count, sum((res > ls)::INT)::BIGINT AS unnecessary_bar_count FROM b GROUP BY track
    """,
    ("nt",),
)
def resolution_adequacy(spark, sf_dir):
    return st.resolution_adequacy(*planned_events(spark, sf_dir), KEYS, 48.0)


def planned_events(spark, sf_dir):
    """Events of the chart slots, and a resolution for every bar."""
    from pulsegrid.plans.bindings import chart_bars, slot_notes

    events = slot_notes(spark, sf_dir).select("track", "bar", F.col("tick").cast("double").alias("position_s"))
    b = F.col("bar") % 3
    return events, chart_bars(spark, sf_dir).select("track", "bar", F.when(b == 0, 16).when(b == 1, 24).otherwise(48).alias("resolution"))


@plan(
    "resolution_histogram",
    """
    WITH b AS (SELECT track, bar, CASE WHEN bar % 3 = 0 THEN 16 WHEN bar % 3 = 1 THEN 24 ELSE 48 END AS r, CASE WHEN bool_and(tick % 3 = 0) THEN 16 WHEN bool_and(tick % 2 = 0) THEN 24 ELSE 48 END AS m FROM nt GROUP BY track, bar),
    x AS (SELECT track, r, NULL::INTEGER AS m FROM b UNION ALL SELECT track, NULL, m FROM b),
    y AS (SELECT track, r, m, count(*) AS n FROM x GROUP BY GROUPING SETS ((track, r, m), (r, m)))
    SELECT track, string_agg(r || ':' || n, ' ' ORDER BY r) FILTER (r IS NOT NULL) AS resolution, string_agg(m || ':' || n, ' ' ORDER BY m) FILTER (m IS NOT NULL) AS minimum_resolution FROM y GROUP BY track
    """,
    ("nt",),
)
def resolution_histogram(spark, sf_dir):
    from pulsegrid.operators.gates import value_counts

    judged = st.judged_bars(*planned_events(spark, sf_dir), KEYS, 48.0)
    return value_counts(judged, KEYS, ["resolution", "minimum_resolution"])


# Phrase ranges of the chart bars: by change of phrase or explicit start, blocks of four in a
# track of one phrase.
cte(
    "prange",
    """SELECT track, bar, (CASE WHEN m = 0 AND n > 4 THEN i // 4 ELSE rg END)::BIGINT AS phrase_id FROM (SELECT *, sum(st) OVER (PARTITION BY track ORDER BY bar ROWS UNBOUNDED PRECEDING) AS rg, sum(st) OVER (PARTITION BY track) AS m, count(*) OVER (PARTITION BY track) AS n
  FROM (SELECT track, bar, CASE WHEN lag(bar) OVER w IS NOT NULL AND (lag(phrase_id) OVER w <> phrase_id OR phrase_position = 'phrase_start') THEN 1 ELSE 0 END AS st, row_number() OVER w - 1 AS i FROM ctx WINDOW w AS (PARTITION BY track ORDER BY bar)))""",
    "ctx",
)
cte(
    "lp",
    "SELECT c.track, p.phrase_id, c.bar, tick, kind, confidence, reasons, priority, reliable, rank, 0.25::DOUBLE + score + confidence * 0.5::DOUBLE + [0.75::DOUBLE, 0.40, 0.20, 0.10, 0.0][priority + 1] AS w FROM cand c JOIN prange p ON p.track = c.track AND p.bar = c.bar",
    "cand",
    "prange",
)


def _cov(cond):
    return _r(f"sum(CASE WHEN {cond} THEN w ELSE 0 END) / sum(w)", 9)


_LATTICE = f"""
    WITH m AS (SELECT *, kind IN ('strong-transient', 'transient') AS mv, sum((kind IN ('strong-transient', 'transient'))::INT) OVER (PARTITION BY track, phrase_id) AS nm FROM lp WHERE kind IN ('strong-transient', 'transient', 'rhythmic-skeleton')), u AS (SELECT * FROM m WHERE mv OR nm = 0),
    s AS (SELECT track, phrase_id, count(*) AS n, {", ".join(f"{_cov(f'tick % {a} = {b}')} AS c{a}{b}" for a, b in st.LATTICES)}, {", ".join(f"{_cov(f'tick % 3 = {a} AND tick % 2 = {b}')} AS b{a}{b}" for a in range(3) for b in range(2))} FROM u GROUP BY ALL),
    k AS (SELECT *, CASE WHEN c30 >= c31 AND c30 >= c32 THEN 0 WHEN c31 >= c32 THEN 1 ELSE 2 END AS sp, greatest(c30, c31, c32) AS sv, CASE WHEN c20 >= c21 THEN 0 ELSE 1 END AS tp, greatest(c20, c21) AS tv FROM s),
    j AS (SELECT *, CASE sp * 2 + tp WHEN 0 THEN b00 WHEN 1 THEN b01 WHEN 2 THEN b10 WHEN 3 THEN b11 WHEN 4 THEN b20 ELSE b21 END AS bo FROM k),
    z AS (SELECT *, CASE WHEN n < 4 THEN 'straight' WHEN sv + tv - bo - greatest(sv, tv) >= 0.25 AND sv - bo >= 0.18 AND tv - bo >= 0.18 THEN 'mixed' WHEN sv >= tv THEN 'straight' ELSE 'triplet' END AS kind FROM j)
    SELECT track, phrase_id::BIGINT AS phrase_id, kind, CASE WHEN kind <> 'triplet' THEN CASE WHEN n < 4 THEN 0 ELSE sp END END AS straight_phase, CASE WHEN kind IN ('triplet', 'mixed') THEN tp END AS triplet_phase,
      {_r("CASE WHEN n < 4 THEN 1 WHEN kind = 'mixed' THEN sv + tv - bo ELSE greatest(sv, tv) END", 6)} AS coverage FROM z
    """
cte("lat", _LATTICE, "lp")


@plan("lattice_choice", _LATTICE, ("lp",))
def lattice_choice(spark, sf_dir):
    return st.lattice_choice(lattice_points(spark, sf_dir), ["track", "phrase_id"])


def lattice_points(spark, sf_dir):
    """Candidates with the phrase range of their bar."""
    ranges = st.phrase_numbers(bar_context(spark, sf_dir).select("track", "bar", "phrase_id", "phrase_position"), KEYS)
    numbered = ranked(spark, sf_dir).join(ranges.select("track", "bar", F.col("range_no").alias("phrase_id")), ["track", "bar"])
    return numbered.withColumn("weight", ev.lattice_weight())


cte(
    "picked",
    """WITH s AS (SELECT *, (tick % 2 = 0 OR tick % 3 = 0) AS st, NOT (tick % 2 = 0 OR tick % 3 = 0) AND confidence >= 0.85::DOUBLE AND list_contains(reasons, 'onset') AS ar FROM lp),
r AS (SELECT *, row_number() OVER (PARTITION BY track, bar, st, ar ORDER BY rank) AS k, least(1, sum(ar::INT) OVER (PARTITION BY track, bar)) AS ex FROM s),
q AS (SELECT * FROM r WHERE (ar AND k <= ex) OR (st AND k <= 8 - ex))
SELECT q.*, coalesce(tick % 3 = straight_phase, false) OR coalesce(tick % 2 = triplet_phase, false) AS on_l FROM q JOIN lat ON lat.track = q.track AND lat.phrase_id = q.phrase_id""",
    "lp",
    "lat",
)
cte(
    "exgroups",
    f"""WITH t AS (SELECT track, phrase_id, tick, count(*) AS times FROM picked GROUP BY ALL), b AS (SELECT track, phrase_id, greatest(1, round_even(count(*) FILTER (on_l) * 0.10::DOUBLE, 0))::BIGINT AS budget FROM picked GROUP BY ALL),
g AS (SELECT p.track, p.phrase_id, p.tick, {_r("sum(w)", 6)} AS gw, count(*) AS n FROM picked p JOIN t ON t.track = p.track AND t.phrase_id = p.phrase_id AND t.tick = p.tick
  WHERE NOT on_l AND kind = 'strong-transient' AND (list_contains(reasons, 'onset') OR list_contains(reasons, 'stem:drum-agreement')) AND confidence >= 0.95::DOUBLE AND times >= 3 GROUP BY ALL)
SELECT g.*, budget, row_number() OVER (PARTITION BY g.track, g.phrase_id ORDER BY gw DESC, n DESC, tick) AS k FROM g JOIN b ON b.track = g.track AND b.phrase_id = g.phrase_id""",
    "picked",
)
# A group is taken whole if it fits what the groups before it have left of the budget.
cte(
    "exwalk",
    """SELECT DISTINCT track, phrase_id, 0::BIGINT AS k, 0::BIGINT AS used, NULL::INTEGER AS tick FROM exgroups
UNION ALL SELECT g.track, g.phrase_id, g.k, CASE WHEN x.used + g.n <= g.budget THEN x.used + g.n ELSE x.used END, CASE WHEN x.used + g.n <= g.budget THEN g.tick::INTEGER END
FROM exwalk x JOIN exgroups g ON g.track = x.track AND g.phrase_id = x.phrase_id AND g.k = x.k + 1""",
    "exgroups",
)


def skeleton_parts(spark, sf_dir):
    """(candidates with phrases, selected ticks, lattices, admitted exceptions)"""
    keys = ["track", "phrase_id"]
    points = lattice_points(spark, sf_dir)
    lattices = st.lattice_choice(points, keys)
    selected = ev.quota_topk(points, size=8, arbitrary=1)
    return points, selected, lattices, st.exception_budget(selected, lattices, keys)


@plan("exception_budget", "SELECT track, phrase_id, tick FROM exwalk WHERE tick IS NOT NULL", ("exwalk",), recursive=True)
def exception_budget(spark, sf_dir):
    return skeleton_parts(spark, sf_dir)[3]


@plan(
    "skeleton_refill",
    """
    WITH k AS (SELECT p.track, p.phrase_id, p.bar, p.tick, CASE WHEN on_l THEN 'lattice' ELSE 'exception' END AS source FROM picked p LEFT JOIN exwalk x ON x.track = p.track AND x.phrase_id = p.phrase_id AND x.tick = p.tick WHERE on_l OR x.tick IS NOT NULL),
    w AS (SELECT track, bar, count(*) AS raw FROM picked GROUP BY ALL), h AS (SELECT track, bar, count(*) AS have FROM k GROUP BY ALL),
    d AS (SELECT w.track, w.bar, least(coalesce(i.min_hits, 0), raw) - coalesce(have, 0) AS need FROM w LEFT JOIN h ON h.track = w.track AND h.bar = w.bar LEFT JOIN chint i ON i.track = w.track AND i.bar = w.bar),
    s AS (SELECT c.track, c.phrase_id, c.bar, c.tick, need, row_number() OVER (PARTITION BY c.track, c.bar ORDER BY priority, w DESC, c.tick) AS n FROM lp c JOIN d ON d.track = c.track AND d.bar = c.bar JOIN lat ON lat.track = c.track AND lat.phrase_id = c.phrase_id
      WHERE reliable AND need > 0 AND (coalesce(c.tick % 3 = straight_phase, false) OR coalesce(c.tick % 2 = triplet_phase, false)) AND NOT EXISTS (SELECT 1 FROM k WHERE k.track = c.track AND k.bar = c.bar AND k.tick = c.tick))
    SELECT track, phrase_id, bar, tick, source FROM k UNION ALL SELECT track, phrase_id, bar, tick, 'refill' FROM s WHERE n <= need
    """,
    ("lp", "lat", "picked", "exwalk", "chint"),
    recursive=True,
)
def skeleton_refill(spark, sf_dir):
    from pulsegrid.plans.quality import chart_hints

    points, selected, lattices, exceptions = skeleton_parts(spark, sf_dir)
    return st.resolved_skeleton(selected, points, lattices, exceptions, chart_hints(spark, sf_dir), ["track", "phrase_id"])


_T = "round_even(coalesce({}, 0) * 1000, 0)::BIGINT"


def _row_sql(names):
    return " || ',' || ".join(_T.format(n) for n in names)


def _text_sql(name):
    return f"coalesce('\"' || {name} || '\"', 'null')"


@plan(
    "compact_document",
    f"""
    WITH t AS (SELECT track, bar, string_agg('[' || tick || ',' || n || ']', ',' ORDER BY tick) AS beats FROM (SELECT track, bar, tick, row_number() OVER (PARTITION BY track, bar ORDER BY tick) AS n FROM pk WHERE beat) GROUP BY ALL),
    b AS (SELECT r.track, r.bar, '[' || r.bar || ',[' || coalesce(beats, '') || '],[' || {_row_sql(exports.STRUCTURE)} || ',' || r.phrase_id || ',' || {_text_sql("r.role")} || ',' || {_text_sql("section_id")} || '],[' || {_row_sql(exports.SOURCES)} || ',' || {_text_sql("dominant_source")} || ']]' AS x
      FROM rol r LEFT JOIN sect s ON s.track = r.track AND s.phrase_id = r.phrase_id LEFT JOIN fillc f ON f.track = r.track AND f.bar = r.bar LEFT JOIN t ON t.track = r.track AND t.bar = r.bar),
    p AS (SELECT p.track, p.phrase_id, '[' || p.phrase_id || ',' || start_bar || ',' || end_bar || ',' || {_text_sql("section_id")} || ',' || {_text_sql("section")} || ',' || {_text_sql("primary_role")} || ',' || {_row_sql(exports.PHRASE)} || ']' AS x FROM phr p JOIN sect s ON s.track = p.track AND s.phrase_id = p.phrase_id)
    SELECT b.track, '{{"bars":[' || string_agg(x, ',' ORDER BY bar) || '],"phrases":[' || coalesce((SELECT string_agg(x, ',' ORDER BY phrase_id) FROM p WHERE p.track = b.track), '') || ']}}' AS document FROM b GROUP BY b.track
    """,
    ("rol", "sect", "fillc", "phr", "pk"),
    recursive=True,
)
def compact_document(spark, sf_dir):
    return exports.compact_document(*document_rows(spark, sf_dir), KEYS)


def document_rows(spark, sf_dir):
    """(bars with the columns of structure and source row, beats, phrases with their section)"""
    roles = roles_of(spark, sf_dir)
    found = phrases_of(spark, sf_dir)
    named = st.sections(found, assigned(spark, sf_dir), KEYS)
    fills = st.fill_candidates(roles, st.dominant_roles(roles, found, KEYS), KEYS).select("track", "bar", "fill_score")
    bars = roles.join(named.select("track", "phrase_id", "section_id", "section_confidence"), ["track", "phrase_id"], "left").join(fills, ["track", "bar"], "left")
    beats = peaks(spark, sf_dir).filter("beat").select("track", "bar", "tick")
    return bars, beats, found.join(named.select("track", "phrase_id", "section_id", "section"), ["track", "phrase_id"])
