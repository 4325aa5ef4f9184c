"""Plans for period detection over the events table; a day counts as one second."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.numeric import round_half_even
from pulsegrid.operators import tempo
from pulsegrid.plans.bindings import DAY, SECOND, of_kind, timeline
from pulsegrid.plans.charts import COURSES
from pulsegrid.plans.evidence import _r
from pulsegrid.plans.registry import cte, plan

FALLBACK_BPM = 120.0


def seconds():
    return F.col("t") / float(DAY)


def weight():
    return F.rint(F.col("value") * 100)


_DIM = ", ".join(f"({r['bpm']}::DOUBLE, {r['bins']}, [{', '.join(repr(w) for w in r['kernel'])}]::DOUBLE[], {r['radius']})" for r in tempo.tempo_dim())
cte("dim_tempo", f"SELECT col0 AS bpm, col1 AS bins, col2 AS kernel, col3 AS radius FROM (VALUES {_DIM})")
cte(
    "ts",
    "SELECT track, t / 86400000000.0::DOUBLE AS s, round_even(value * 100, 0) AS w FROM ev WHERE kind IN ('view', 'click')",
    "ev",
)
cte(
    "scan",
    """WITH h AS (SELECT track, bpm, bins, kernel, radius, least(bins - 1, floor((s % (60.0::DOUBLE / bpm)) / (60.0::DOUBLE / bpm) * bins))::INTEGER AS b, sum(w) AS w FROM ts, dim_tempo GROUP BY ALL),
k AS (SELECT track, bpm, bins, b, w, unnest(kernel) AS g, unnest(range(0, len(kernel))) - radius AS sh FROM h),
m AS (SELECT track, bpm, bins, ((b + sh) % bins + bins) % bins AS b, round_even(sum(w * g) * 1000000000, 0) / 1000000000 AS x FROM k GROUP BY ALL),
p AS (SELECT track, bpm, bins, max(x) AS x, arg_min(b, (-x, b)) AS b FROM m GROUP BY ALL), t AS (SELECT track, sum(w) AS tw, count(*) AS n, max(s) - min(s) AS span FROM ts GROUP BY track)
SELECT p.track, p.bpm, p.bins, p.b, round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (p.x + coalesce(o.x, 0) * 0.5::DOUBLE) / tw)) * 1000000000, 0) / 1000000000 AS support, (p.b + 0.5::DOUBLE) / p.bins * (60.0::DOUBLE / p.bpm) AS center, n, span,
  row_number() OVER (PARTITION BY p.track ORDER BY p.bpm) AS i FROM p JOIN t ON t.track = p.track LEFT JOIN m o ON o.track = p.track AND o.bpm = p.bpm AND o.b = (p.b + p.bins // 2) % p.bins""",
    "ts",
    "dim_tempo",
)
cte(
    "walked",
    """SELECT track, 1::BIGINT AS i, 120.0::DOUBLE AS bpm, -1.0::DOUBLE AS support, 0.0::DOUBLE AS center FROM (SELECT DISTINCT track FROM scan)
UNION ALL SELECT w.track, w.i + 1, CASE WHEN k THEN s.bpm ELSE w.bpm END, CASE WHEN k THEN s.support ELSE w.support END, CASE WHEN k THEN s.center ELSE w.center END
FROM (SELECT w.*, s AS s, s.support > w.support OR (abs(s.support - w.support) <= 1e-8 + 0.01::DOUBLE * abs(w.support) AND abs(s.bpm - 120) < abs(w.bpm - 120)) AS k FROM walked w JOIN scan s ON s.track = w.track AND s.i = w.i) w""",
    "scan",
)
_EVID = "least(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (n - 8) / 56.0::DOUBLE)), least(1.0::DOUBLE, greatest(0.0::DOUBLE, (cov - 0.5::DOUBLE) / (0.9::DOUBLE - 0.5::DOUBLE))))"


@plan(
    "tempo_scan",
    f"""
    WITH b AS (SELECT * FROM walked WHERE i = 264), r AS (SELECT b.track, arg_max(s.bpm, (s.support, -s.bpm)) AS rb, max(s.support) AS rs FROM b JOIN scan s ON s.track = b.track AND abs(s.bpm - b.bpm) >= greatest(3, b.bpm * 0.03::DOUBLE) GROUP BY b.track),
    x AS (SELECT b.*, rb, rs, a.n, a.span, least(1.0::DOUBLE, greatest(0.0::DOUBLE, a.span / 30)) AS cov FROM b JOIN r USING (track) JOIN (SELECT track, any_value(n) AS n, any_value(span) AS span FROM scan GROUP BY track) a USING (track))
    SELECT track, n AS onset_count, {_r("cov", 6)} AS time_coverage, bpm AS best_bpm, center AS phase_center, {_r("support", 6)} AS support, rb AS runner_up_bpm, {_r("rs", 6)} AS runner_up_support,
      CASE WHEN n < 8 THEN 'insufficient_onsets' WHEN span < 4 THEN 'insufficient_time_span' WHEN cov < 0.5 THEN 'insufficient_time_coverage' WHEN support <= 0 THEN 'low_normalized_support'
        WHEN rs / support >= 0.9::DOUBLE AND NOT (abs(greatest(bpm, rb) - least(bpm, rb) * 2) <= 0.5 AND abs(bpm - 120) + 0.5 < abs(rb - 120)) THEN 'ambiguous_candidates'
        WHEN support < 0.75::DOUBLE - (0.75::DOUBLE - 0.68::DOUBLE) * {_EVID} THEN 'low_normalized_support' ELSE 'accepted' END AS reason FROM x
    """,
    ("walked",),
    recursive=True,
)
def tempo_scan(spark, sf_dir):
    onsets = of_kind(timeline(spark, sf_dir), "view", "click")
    return tempo.tempo_scan(onsets, ["track"], seconds(), weight(), 30.0, FALLBACK_BPM)


@plan(
    "tempo_offset",
    f"""
    WITH b AS (SELECT track, bpm, center, 60.0::DOUBLE / bpm AS iv FROM walked WHERE i = 264),
    r AS (SELECT ts.track, s, w, bpm, center, iv, ((s - center + iv * 0.5::DOUBLE) % iv + iv) % iv - iv * 0.5::DOUBLE AS d FROM ts JOIN b USING (track)),
    g AS (SELECT track, bpm, center, iv, coalesce(sum(w * sin(s / iv * 2 * pi())) FILTER (abs(d) <= {tempo.PHASE_WINDOW_S}), 0) AS y, coalesce(sum(w * cos(s / iv * 2 * pi())) FILTER (abs(d) <= {tempo.PHASE_WINDOW_S}), 0) AS x, count(*) FILTER (abs(d) <= {tempo.PHASE_WINDOW_S}) AS n FROM r GROUP BY ALL)
    SELECT track, bpm AS best_bpm, {_r("CASE WHEN n = 0 OR sqrt(x * x + y * y) <= 1e-8 THEN center % iv ELSE ((atan2(y, x) + 2 * pi()) % (2 * pi())) / (2 * pi()) * iv END", 6)} AS offset_s FROM g
    """,
    ("walked", "ts"),
    recursive=True,
)
def tempo_offset(spark, sf_dir):
    onsets = of_kind(timeline(spark, sf_dir), "view", "click")
    best = tempo.tempo_scan(onsets, ["track"], seconds(), weight(), 30.0, FALLBACK_BPM)
    found = tempo.circular_offset(onsets, best, ["track"], seconds(), weight())
    return found.select("track", "best_bpm", round_half_even(F.col("offset"), 6).alias("offset_s"))


@plan(
    "phase_support",
    f"""
    WITH b AS (SELECT track, w, s, unnest([120.0::DOUBLE, 60.0::DOUBLE, 240.0::DOUBLE]) AS bpm FROM ts), p AS (SELECT *, ((s - 0.1::DOUBLE) % (60 / bpm) + 60 / bpm) % (60 / bpm) AS ph, 60 / bpm AS iv FROM b),
    g AS (SELECT track, bpm, {_r("sum(w * greatest(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - least(ph, iv - ph) / 0.045::DOUBLE)), 0.5::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - abs(ph - iv * 0.5::DOUBLE) / 0.045::DOUBLE)))) / sum(w)", 6)} AS x FROM p GROUP BY ALL),
    a AS (SELECT track, max(x) FILTER (bpm = 120) AS support, max(x) FILTER (bpm = 60) AS half_support, max(x) FILTER (bpm = 240) AS double_support FROM g GROUP BY track)
    SELECT *, CASE WHEN support < 0.2 THEN 'none' WHEN half_support >= support * 0.9::DOUBLE AND double_support >= support * 0.9::DOUBLE THEN 'both' WHEN half_support >= support * 0.9::DOUBLE THEN 'half' WHEN double_support >= support * 0.9::DOUBLE THEN 'double' ELSE 'none' END AS tempo_alias FROM a
    """,
    ("ts",),
)
def phase_support(spark, sf_dir):
    onsets = of_kind(timeline(spark, sf_dir), "view", "click")

    def at(bpm):
        return round_half_even(tempo.phase_support(seconds(), weight(), F.lit(bpm), F.lit(0.1)), 6)

    found = onsets.groupBy("track").agg(at(120.0).alias("support"), at(60.0).alias("half_support"), at(240.0).alias("double_support"))
    label = tempo.tempo_alias(F.col("support"), F.col("half_support"), F.col("double_support"), minimum=0.2)
    return found.withColumn("tempo_alias", label)


@plan(
    "anchor_fit",
    f"""
    WITH a AS (SELECT track, t // 86400000000 AS beat, min(t) // 1000000 AS s FROM ev WHERE kind = 'view' GROUP BY ALL), f AS (SELECT track, count(*) AS n, regr_slope(s, beat) AS sl, regr_intercept(s, beat) AS ic FROM a GROUP BY track),
    e AS (SELECT a.track, max(abs(s - (ic + beat * sl))) AS er FROM a JOIN f USING (track) GROUP BY a.track)
    SELECT f.track, n AS anchor_count, n >= 2 AS valid, CASE WHEN n >= 2 THEN {_r("60 / sl", 9)} END AS bpm, CASE WHEN n >= 2 THEN {_r("ic", 3)} END AS offset_s, CASE WHEN n >= 2 THEN {_r("er", 3)} END AS max_error_s,
      n >= 2 AND er <= 36000 AS consistent, n >= 3 AS independently_checked FROM f JOIN e USING (track)
    """,
    ("ev",),
)
def anchor_fit(spark, sf_dir):
    firsts = of_kind(timeline(spark, sf_dir), "view").groupBy("track", F.floor(F.col("t") / DAY).alias("day")).agg(
        F.floor(F.min("t") / SECOND).alias("s")
    )
    anchors = firsts.select("track", F.concat_ws(":", F.col("day").cast("string"), F.col("s").cast("string")).alias("anchor"))
    fit = tempo.anchor_fit(anchors, ["track"], "anchor", 36000.0)
    return fit.select(
        "track",
        "anchor_count",
        "valid",
        round_half_even(F.col("bpm"), 9).alias("bpm"),
        round_half_even(F.col("offset_s"), 3).alias("offset_s"),
        round_half_even(F.col("max_error_s"), 3).alias("max_error_s"),
        "consistent",
        "independently_checked",
    )


cte(
    "vs",
    """SELECT track, n - 1 AS ic, span / 2592000000000.0::DOUBLE AS cov, (si % 80) / 1000.0::DOUBLE AS fit, (n % 13) / 100.0::DOUBLE AS cv, (n % 7) / 20.0::DOUBLE AS o, abs((n % 9 - 4) / 40.0::DOUBLE) AS dr, (n % 5) / 20.0::DOUBLE AS ad
FROM (SELECT track, count(*) AS n, sum(event_id)::BIGINT AS si, max(t) - min(t) AS span FROM ev GROUP BY track)""",
    "ev",
)


@plan(
    "variation_class",
    f"""
    WITH c AS (SELECT *, ic >= 8 AND cov >= 0.5 AS en, fit >= 0.04::DOUBLE AND ad >= 0.12::DOUBLE AND o >= 0.2::DOUBLE * 0.5 AS ch, fit >= 0.04::DOUBLE AND dr >= 0.06::DOUBLE AS ru, fit >= 0.04::DOUBLE * 0.75 AND cv >= 0.06::DOUBLE AND o >= 0.2::DOUBLE AS li FROM vs),
    s AS (SELECT *, least(1.0::DOUBLE, CASE WHEN ch THEN greatest(fit / 0.04::DOUBLE, ad / 0.12::DOUBLE) WHEN ru THEN greatest(fit / 0.04::DOUBLE, dr / 0.06::DOUBLE) WHEN li THEN greatest(fit / (0.04::DOUBLE * 0.75), cv / 0.06::DOUBLE, o / 0.2::DOUBLE) ELSE greatest(fit / 0.04::DOUBLE, cv / 0.06::DOUBLE, o / 0.2::DOUBLE) END) AS sv,
      least(1.0::DOUBLE, ic / 32.0::DOUBLE) * least(1.0::DOUBLE, cov / 0.8::DOUBLE) AS b FROM c)
    SELECT track, CASE WHEN NOT en THEN 'insufficient-evidence' WHEN ch THEN 'possible-tempo-change' WHEN ru THEN 'possible-rubato' WHEN li THEN 'possible-live-performance' ELSE 'stable' END AS variation_class, en AND (ch OR ru OR li) AS suspected,
      {_r("CASE WHEN NOT en THEN 0 WHEN ch OR ru OR li THEN b * sv ELSE b * greatest(0.0::DOUBLE, 1 - sv * 0.5) END", 6)} AS confidence FROM s
    """,
    ("vs",),
)
def variation_class(spark, sf_dir):
    n = F.col("n")
    base = timeline(spark, sf_dir).groupBy("track").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("si"), (F.max("t") - F.min("t")).alias("span")
    )
    rows = base.select(
        "track",
        (n - 1).alias("interval_count"),
        (F.col("span") / float(30 * DAY)).alias("coverage"),
        ((F.col("si") % 80) / 1000.0).alias("error_ratio"),
        ((n % 13) / 100.0).alias("variation"),
        ((n % 7) / 20.0).alias("outlier_ratio"),
        ((n % 9 - 4) / 40.0).alias("drift_ratio"),
        ((n % 5) / 20.0).alias("max_adjacent_change"),
    )
    return tempo.variation_class(rows, ["track"])


cte(
    "tc",
    """SELECT track, CASE kind WHEN 'view' THEN 'librosa' WHEN 'click' THEN 'librosa+onset-grid' ELSE 'beatnet' END AS source, 100.0::DOUBLE + si % 5 AS bpm, (si % 4) / 20.0::DOUBLE AS off, CASE WHEN si % 3 = 0 THEN '3/4' ELSE '4/4' END AS sig,
  0.6::DOUBLE + (si % 30) / 100.0::DOUBLE AS onset_support, 0.7::DOUBLE + (si % 7) / 30.0::DOUBLE AS time_coverage, 0.75::DOUBLE + (si % 9) / 40.0::DOUBLE AS interval_stability, n AS onset_count, (si % 11 - 5) / 20.0::DOUBLE AS support_margin, n - 5 AS interval_count,
  0.6::DOUBLE + (si % 13) / 40.0::DOUBLE AS number_completeness, 0.4::DOUBLE + (si % 6) / 10.0::DOUBLE AS meter_stability, 0.5::DOUBLE + (si % 8) / 16.0::DOUBLE AS meter_length, (si % 10) / 10.0::DOUBLE AS downbeat_support, n // 4 AS downbeat_count, si % 4 <> 0 AS accepted,
  CASE WHEN si % 8 = 0 THEN 'ambiguous_candidates' ELSE 'insufficient_onsets' END AS reason FROM (SELECT track, kind, count(*) AS n, sum(event_id)::BIGINT AS si FROM ev WHERE kind IN ('view', 'click', 'purchase') GROUP BY ALL)""",
    "ev",
)


def _score_sql(kind, many):
    parts = " + ".join(_r(f"{n} * {w}::DOUBLE", 6) for n, w in tempo.SCORE_WEIGHTS[kind, many].items())
    return _r(f"least(1.0::DOUBLE, {parts})", 6)


_DECISION = f"""
    WITH s AS (SELECT *, CASE WHEN source LIKE 'beatnet%' AND onset_count >= 8 THEN {_score_sql("tracker", True)} WHEN source LIKE 'beatnet%' THEN {_score_sql("tracker", False)} WHEN onset_count >= 8 THEN {_score_sql("base", True)} ELSE {_score_sql("base", False)} END AS score
      FROM (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + support_margin)) AS margin, least(1.0::DOUBLE, onset_count / 32.0::DOUBLE) AS volume FROM tc)),
    r AS (SELECT s.*, b.onset_support AS bs, b.onset_count AS bc, CASE WHEN s.source = 'librosa' THEN NULL WHEN s.source LIKE '%+onset-grid' AND NOT s.accepted THEN 'local-rejection:' || s.reason WHEN s.source NOT LIKE 'beatnet%' THEN NULL
        WHEN s.interval_count < CASE s.sig WHEN '3/4' THEN 2 ELSE 3 END THEN 'insufficient-tracker-intervals' WHEN s.interval_stability < 0.8 THEN 'unstable-beat-intervals' WHEN s.number_completeness < 0.7 THEN 'incomplete-beat-numbers' WHEN s.meter_stability < 0.5 THEN 'unstable-meter'
        WHEN s.downbeat_count >= 2 AND s.meter_length < 0.65 THEN 'implausible-meter-length' WHEN s.onset_count >= 8 AND b.onset_count >= 8 AND s.onset_support + 0.08::DOUBLE < b.onset_support THEN 'onset-support-below-baseline' WHEN s.score < 0.45 THEN 'low-candidate-score' END AS rejection
      FROM s LEFT JOIN tc b ON b.track = s.track AND b.source = 'librosa'),
    k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, CASE source WHEN 'librosa' THEN 3 WHEN 'librosa+onset-grid' THEN 2 ELSE 1 END DESC, source) AS rk FROM r WHERE rejection IS NULL),
    p AS (SELECT a.track, a.source, a.score, greatest(a.bpm, b.bpm) AS f, least(a.bpm, b.bpm) AS l, a.sig <> b.sig AS ds, abs(a.off - b.off) AS d, a.score - b.score AS gap FROM k a LEFT JOIN k b ON b.track = a.track AND b.rk = 2 WHERE a.rk = 1),
    q AS (SELECT *, coalesce(((f - l) / f > 0.03::DOUBLE OR ds OR least(d % (60 / f), 60 / f - d % (60 / f)) > 0.08::DOUBLE) AND gap < CASE WHEN abs(f - l * 2) <= 0.5 THEN 0.08::DOUBLE ELSE 0.04::DOUBLE END, false) AS cl FROM p),
    g AS (SELECT track, bool_or(source = 'librosa+onset-grid' AND coalesce(rejection LIKE '%ambiguous_candidates%', false)) AS lo, count(rejection) AS rc, coalesce(string_agg(source || '=' || rejection, ';' ORDER BY source) FILTER (rejection IS NOT NULL), '') AS rj, max(CASE WHEN source = 'librosa' THEN score END) AS fs FROM r GROUP BY track)
    SELECT q.track, CASE WHEN lo OR cl THEN 'librosa' ELSE source END AS selected_source, CASE WHEN lo OR cl THEN fs ELSE score END AS selected_score, lo OR cl AS ambiguous, NOT (lo OR cl) AND source <> 'librosa' AS accepted, rc AS rejected_count, rj AS rejections
    FROM q JOIN g USING (track) WHERE fs IS NOT NULL
    """
cte("decision", _DECISION, "tc")


@plan("candidate_arbitration", _DECISION, ("tc",))
def candidate_arbitration(spark, sf_dir):
    return tempo.candidate_arbitration(tempo_candidates(spark, sf_dir), ["track"], "librosa")


def tempo_candidates(spark, sf_dir):
    """One candidate per track and event kind, with evidence from its events."""
    source = F.when(F.col("kind") == "view", "librosa").when(F.col("kind") == "click", "librosa+onset-grid").otherwise("beatnet")
    base = of_kind(timeline(spark, sf_dir), "view", "click", "purchase").groupBy("track", source.alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("si")
    )
    n, si = F.col("n"), F.col("si")
    return base.select(
        "track",
        "source",
        (100.0 + si % 5).alias("bpm"),
        ((si % 4) / 20.0).alias("offset"),
        F.when(si % 3 == 0, "3/4").otherwise("4/4").alias("time_signature"),
        (0.6 + (si % 30) / 100.0).alias("onset_support"),
        (0.7 + (si % 7) / 30.0).alias("time_coverage"),
        (0.75 + (si % 9) / 40.0).alias("interval_stability"),
        n.alias("onset_count"),
        ((si % 11 - 5) / 20.0).alias("support_margin"),
        (n - 5).alias("interval_count"),
        (0.6 + (si % 13) / 40.0).alias("number_completeness"),
        (0.4 + (si % 6) / 10.0).alias("meter_stability"),
        (0.5 + (si % 8) / 16.0).alias("meter_length"),
        ((si % 10) / 10.0).alias("downbeat_support"),
        F.floor(n / 4).alias("downbeat_count"),
        (si % 4 != 0).alias("accepted"),
        F.when(si % 8 == 0, "ambiguous_candidates").otherwise("insufficient_onsets").alias("reason"),
    )


@plan(
    "meter_adoption",
    f"""
    WITH b AS (SELECT track, bpm AS tb, off AS toff, sig AS tsig FROM tc WHERE source = 'librosa'),
    a AS (SELECT c.*, tb, toff, tsig, off + 0.1::DOUBLE AS fd, abs(off + 0.1::DOUBLE - toff) % (60 / tb) AS d FROM tc c JOIN b USING (track) WHERE source = 'beatnet'),
    r AS (SELECT *, CASE WHEN downbeat_count = 0 THEN 'no-downbeats' WHEN abs(bpm - tb) / greatest(bpm, tb) > 0.03::DOUBLE THEN 'tempo-disagrees' WHEN interval_count < CASE sig WHEN '3/4' THEN 2 ELSE 3 END THEN 'insufficient-tracker-intervals' WHEN interval_stability < 0.8 THEN 'unstable-beat-intervals'
      WHEN number_completeness < 0.7 THEN 'incomplete-beat-numbers' WHEN meter_stability < 0.5 THEN 'unstable-meter' WHEN downbeat_count >= 2 AND meter_length < 0.65 THEN 'implausible-meter-length' WHEN time_coverage < 0.5 THEN 'insufficient-coverage' WHEN downbeat_support < 0.45 THEN 'unsupported-downbeats'
      WHEN sig = tsig AND least(d, 60 / tb - d) <= 0.08::DOUBLE THEN 'same-meter' ELSE 'adopted' END AS why FROM a)
    SELECT d.track, tb AS tempo_bpm, CASE WHEN ok THEN sig ELSE tsig END AS time_signature, CASE WHEN ok THEN fd ELSE toff END AS offset_s, CASE WHEN ok THEN 'beatnet' ELSE 'librosa' END AS meter_source, ok AS partial,
      CASE WHEN ok THEN 'adopted' WHEN ambiguous THEN 'ambiguous-tempo' WHEN selected_source <> 'librosa' THEN 'tempo-not-from-fallback' WHEN why IS NULL THEN 'no-tracker' ELSE why END AS reason
    FROM (SELECT d.*, b.tb, toff0 AS toff, tsig0 AS tsig, r.sig, r.fd, r.why, NOT ambiguous AND selected_source = 'librosa' AND coalesce(why = 'adopted', false) AS ok FROM decision d JOIN (SELECT track, tb, toff AS toff0, tsig AS tsig0 FROM b) b USING (track) LEFT JOIN (SELECT track, sig, fd, why FROM r) r USING (track)) d
    """,
    ("tc", "decision"),
)
def meter_adoption(spark, sf_dir):
    rows = tempo_candidates(spark, sf_dir).withColumn("first_downbeat", F.col("offset") + 0.1)
    return tempo.meter_adoption(rows, tempo.candidate_arbitration(rows.drop("first_downbeat"), ["track"], "librosa"), ["track"], "librosa")


@plan(
    "silent_onsets",
    """
    WITH o AS (SELECT track, t FROM ev WHERE kind = 'click'), r AS (SELECT track, t AS s, t + 7200000000 AS e FROM ev WHERE kind = 'error')
    SELECT o.track, count(*) AS onset_count, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.track = o.track AND o.t >= r.s AND o.t < r.e)) AS false_positive_count FROM o GROUP BY o.track
    """,
    ("ev",),
)
def silent_onsets(spark, sf_dir):
    events = timeline(spark, sf_dir)
    ranges = of_kind(events, "error").select("track", F.col("t").alias("start_t"), (F.col("t") + 7200 * SECOND).alias("end_t"))
    return tempo.silent_onsets(of_kind(events, "click").select("track", "t"), ranges, ["track"], 3600 * SECOND)


@plan(
    "regular_grid",
    f"""
    WITH b AS (SELECT track, bpm, ((center % (60 / bpm)) + 60 / bpm) % (60 / bpm) AS o, 60 / bpm AS iv, CASE track % 3 WHEN 0 THEN 3 ELSE 4 END AS bpb FROM walked WHERE i = 264),
    g AS (SELECT track, o, iv, bpb, unnest(range(0, floor((8 - o) / iv + 1e-9)::BIGINT + 1)) AS step FROM b)
    SELECT track, step, {_r("o + step * iv", 6)} AS time_s, (step % bpb + 1)::INTEGER AS number FROM g
    """,
    ("walked",),
    recursive=True,
)
def regular_grid(spark, sf_dir):
    """Beats of the first eight seconds at the tempo and phase that the scan found."""
    onsets = of_kind(timeline(spark, sf_dir), "view", "click")
    best = tempo.tempo_scan(onsets, ["track"], seconds(), weight(), 30.0, FALLBACK_BPM)
    tracks = best.select(
        "track",
        F.col("best_bpm").alias("bpm"),
        F.pmod(F.col("phase_center"), F.lit(60.0) / F.col("best_bpm")).alias("offset_s"),
        F.lit(8.0).alias("duration_s"),
        F.when(F.col("track") % 3 == 0, 3).otherwise(4).alias("beats_per_bar"),
    )
    return tempo.regular_grid(tracks, ["track"]).withColumn("time_s", round_half_even(F.col("time_s"), 6))


@plan(
    "grid_snap",
    f"""
    WITH g AS (SELECT track, kind, round_even((t / 86400000000.0::DOUBLE - 0.1::DOUBLE) / 0.25::DOUBLE, 0)::BIGINT AS step FROM ev)
    SELECT DISTINCT a.track, a.step, {_r("0.1::DOUBLE + a.step * 0.25::DOUBLE", 6)} AS time_s FROM g a WHERE a.kind = 'purchase' AND EXISTS (SELECT 1 FROM g b WHERE b.kind IN ('view', 'click') AND b.track = a.track AND b.step = a.step)
    """,
    ("ev",),
)
def grid_snap(spark, sf_dir):
    events = timeline(spark, sf_dir)
    return tempo.grid_snap(of_kind(events, "purchase"), of_kind(events, "view", "click"), ["track"], seconds(), 0.1, 0.25)


@plan(
    "event_support",
    f"""
    WITH f AS (SELECT track, t, value, greatest(value, coalesce(lag(value) OVER w, 0), coalesce(lead(value) OVER w, 0)) AS x, t - lag(t) OVER w AS gap FROM ev WHERE kind = 'click' WINDOW w AS (PARTITION BY track ORDER BY t)),
    m AS (SELECT track, greatest(3600000000, 1.5::DOUBLE * quantile_cont(gap, 0.5)) AS tol FROM f GROUP BY track),
    n AS (SELECT e.track, e.event_id, min(abs(f.t - e.t)) AS d, arg_min(f.x, abs(f.t - e.t) * 2 + (f.t > e.t)::INT) AS x FROM ev e LEFT JOIN f ON f.track = e.track WHERE e.kind = 'purchase' GROUP BY ALL)
    SELECT n.track, {_r("avg(x) FILTER (d <= tol)", 6)} AS support, count(*) FILTER (d <= tol) AS supported_count FROM n LEFT JOIN m USING (track) GROUP BY n.track
    """,
    ("ev",),
)
def event_support(spark, sf_dir):
    events = timeline(spark, sf_dir)
    return tempo.event_support(
        of_kind(events, "purchase"), of_kind(events, "click"), ["track"], "t", "value", 4 * DAY, 3600 * SECOND, 3600 * SECOND
    )


@plan(
    "tempo_accuracy",
    f"""
    WITH r AS (SELECT track, 60.0::DOUBLE + (si % 140) AS es, 80.0::DOUBLE + n % 40 AS ex, si % 3 = n % 3 AS mc, CASE WHEN n % 5 <> 0 THEN abs(md - 0.5::DOUBLE) END AS de, ['Easy', 'Normal', 'Hard', 'Oni'][CAST(track % 4 + 1 AS INTEGER)] AS course
      FROM (SELECT track, count(*) AS n, sum(event_id)::BIGINT AS si, min(t) / 86400000000.0::DOUBLE AS md FROM ev GROUP BY track))
    SELECT course, count(*) AS track_count, {_r("avg(abs(es - ex))", 6)} AS mean_bpm_error, {_r("max(abs(es - ex))", 6)} AS max_bpm_error, {_r("avg(abs(es - ex) / ex)", 6)} AS mean_relative_error,
      count(*) FILTER (abs(es - ex * 0.5) / (ex * 0.5) <= 0.05::DOUBLE) AS half_time_count, count(*) FILTER (abs(es - ex * 2) / (ex * 2) <= 0.05::DOUBLE) AS double_time_count, {_r("avg(mc::INT)", 6)} AS meter_accuracy, {_r("avg(de)", 6)} AS mean_downbeat_error FROM r GROUP BY course
    """,
    ("ev",),
)
def tempo_accuracy(spark, sf_dir):
    n, si = F.col("n"), F.col("si")
    base = timeline(spark, sf_dir).groupBy("track").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("si"), (F.min("t") / float(DAY)).alias("first")
    )
    rows = base.select(
        F.element_at(F.array(*[F.lit(c) for c in COURSES]), (F.pmod("track", F.lit(4)) + 1).cast("int")).alias("course"),
        (60.0 + si % 140).alias("estimated_bpm"),
        (80.0 + n % 40).alias("expected_bpm"),
        (si % 3 == n % 3).alias("meter_correct"),
        F.when(n % 5 != 0, F.abs(F.col("first") - 0.5)).alias("downbeat_error_s"),
    )
    return tempo.tempo_accuracy(rows, "course")
