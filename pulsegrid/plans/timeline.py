"""Plans over the events table: matching, ranges, streams, intervals, peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.numeric import ratio, round_half_even
from pulsegrid.operators import matching, sequences
from pulsegrid.operators.scan import ordered_scan, time_cell
from pulsegrid.plans.bindings import DAY, HOUR, SECOND, of_kind, timeline
from pulsegrid.plans.registry import cte, plan

MATCH_TOL = 6 * HOUR
PAIR_TOL = 12 * HOUR
STREAM_GAP = 8 * HOUR
CELL = 4 * DAY


@plan(
    "track_load",
    """
    WITH g AS (SELECT track, t, event_id, CASE WHEN t - lag(t) OVER w <= 28800000000 THEN 0 ELSE 1 END AS o FROM ev
      WINDOW w AS (PARTITION BY track ORDER BY t, event_id)),
    i AS (SELECT *, sum(o) OVER (PARTITION BY track ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g),
    st AS (SELECT track, s, count(*) AS n, max(t) - min(t) AS len FROM i GROUP BY ALL),
    best AS (SELECT track, n, len, row_number() OVER (PARTITION BY track ORDER BY n DESC, len DESC) AS rn FROM st),
    b AS (SELECT track, t // 86400000000 AS bar, count(*) AS n FROM ev GROUP BY ALL),
    l AS (SELECT track, sum(n)::BIGINT AS event_count, count(*) AS active_bars, max(n) AS peak_bar_count FROM b GROUP BY track)
    SELECT l.track, event_count, active_bars, peak_bar_count, event_count / (active_bars * 24.0::DOUBLE) AS active_rate_per_hour,
      best.n AS longest_stream_count, best.len::BIGINT AS longest_stream_length
    FROM l JOIN best ON best.track = l.track AND best.rn = 1
    """,
    ("ev",),
)
def track_load(spark, sf_dir):
    events = timeline(spark, sf_dir)
    bars = events.groupBy("track", F.floor(F.col("t") / DAY).alias("bar")).agg(F.count(F.lit(1)).alias("n"))
    load = bars.groupBy("track").agg(
        F.sum("n").alias("event_count"), F.count(F.lit(1)).alias("active_bars"), F.max("n").alias("peak_bar_count")
    )
    longest = sequences.longest_stream(events, ["track"], ["t", "event_id"], STREAM_GAP, CELL)
    rate = (F.col("event_count") / (F.col("active_bars") * 24.0)).alias("active_rate_per_hour")
    return load.select("*", rate).join(longest, ["track"])


@plan(
    "note_streams",
    """
    WITH g AS (SELECT track, t, event_id, CASE WHEN t - lag(t) OVER w <= 28800000000 THEN 0 ELSE 1 END AS o FROM ev
      WINDOW w AS (PARTITION BY track ORDER BY t, event_id)),
    i AS (SELECT *, sum(o) OVER (PARTITION BY track ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT track, s::BIGINT AS stream, min(t) AS start_t, max(t) AS end_t, count(*) AS event_count FROM i GROUP BY track, s
    """,
    ("ev",),
)
def note_streams(spark, sf_dir):
    return sequences.streams(timeline(spark, sf_dir), ["track"], ["t", "event_id"], STREAM_GAP, CELL)


@plan(
    "nearest_match",
    """
    SELECT l.track, l.event_id, l.t, arg_min(r.t, abs(r.t - l.t) * 2 + CASE WHEN r.t > l.t THEN 1 ELSE 0 END) AS match_t
    FROM ev l LEFT JOIN ev r ON r.track = l.track AND r.kind = 'click' AND abs(r.t - l.t) <= 21600000000
    WHERE l.kind IN ('purchase', 'signup') GROUP BY l.track, l.event_id, l.t
    """,
    ("ev",),
)
def nearest_match(spark, sf_dir):
    events = timeline(spark, sf_dir)
    left = of_kind(events, "purchase", "signup").select("track", "event_id", "t")
    return matching.nearest_within(left, of_kind(events, "click"), ["track"], MATCH_TOL, cell_width=CELL)


@plan(
    "near_exists",
    """
    SELECT l.track, l.event_id, EXISTS (SELECT 1 FROM ev r WHERE r.track = l.track AND r.kind IN ('click', 'error')
      AND r.t BETWEEN l.t - 21600000000 AND l.t + 21600000000) AS near
    FROM ev l WHERE l.kind = 'view'
    """,
    ("ev",),
)
def near_exists(spark, sf_dir):
    events = timeline(spark, sf_dir)
    left = of_kind(events, "view").select("track", "event_id", "t")
    right = of_kind(events, "click", "error")
    return matching.exists_within(left, right, ["track"], MATCH_TOL, cell_width=CELL).drop("t")


# Ordered greedy matching per key, as a recursive walk over the two sorted lists.
cte(
    "sides",
    """SELECT 'onset' AS metric, track, 'ref' AS side, t FROM ev WHERE kind IN ('view', 'click')
UNION ALL SELECT 'onset', track, 'est', t FROM ev WHERE kind IN ('purchase', 'signup')
UNION ALL SELECT 'beat', track, 'ref', t FROM ev WHERE kind = 'error'
UNION ALL SELECT 'beat', track, 'est', t FROM ev WHERE kind = 'view'""",
    "ev",
)
cte(
    "lists",
    """SELECT metric, track, coalesce(list(t ORDER BY t) FILTER (side = 'ref'), []) AS r,
  coalesce(list(t ORDER BY t) FILTER (side = 'est'), []) AS e FROM sides GROUP BY metric, track""",
    "sides",
)
cte(
    "walk",
    """SELECT metric, track, r, e, 1::BIGINT AS i, 1::BIGINT AS j, NULL::BIGINT AS hit FROM lists
UNION ALL
SELECT metric, track, r, e, CASE WHEN e[j] < r[i] - 43200000000 THEN i ELSE i + 1 END,
  CASE WHEN e[j] > r[i] + 43200000000 THEN j ELSE j + 1 END,
  CASE WHEN abs(e[j] - r[i]) <= 43200000000 THEN abs(e[j] - r[i]) END
FROM walk WHERE i <= len(r) AND j <= len(e)""",
    "lists",
)
cte(
    "matched",
    """SELECT metric, track, any_value(len(r)) AS reference_count, any_value(len(e)) AS estimated_count, count(hit) AS true_positive_count,
  avg(hit) / 1000000.0::DOUBLE AS mean_error, max(hit) / 1000000.0::DOUBLE AS max_error FROM walk GROUP BY metric, track""",
    "walk",
)


def _matches(spark, sf_dir):
    """Matched events of two comparisons, keyed by metric and track."""
    events = timeline(spark, sf_dir)

    def side(metric, *kinds):
        return of_kind(events, *kinds).select(F.lit(metric).alias("metric"), "track", "t")

    references = side("onset", "view", "click").unionByName(side("beat", "error"))
    estimates = side("onset", "purchase", "signup").unionByName(side("beat", "view"))
    return matching.match_one_to_one(references, estimates, ["metric", "track"], PAIR_TOL)


@plan(
    "event_match",
    """
    SELECT metric, track, reference_count::BIGINT AS reference_count, estimated_count::BIGINT AS estimated_count, true_positive_count,
      (estimated_count - true_positive_count)::BIGINT AS false_positive_count,
      (reference_count - true_positive_count)::BIGINT AS false_negative_count,
      coalesce(true_positive_count / nullif(estimated_count, 0)::DOUBLE, 0) AS precision,
      coalesce(true_positive_count / nullif(reference_count, 0)::DOUBLE, 0) AS recall,
      coalesce(2 * true_positive_count / nullif(reference_count + estimated_count, 0)::DOUBLE, 0) AS f1, mean_error, max_error
    FROM matched
    """,
    ("matched",),
    recursive=True,
)
def event_match(spark, sf_dir):
    return matching.match_metrics(_matches(spark, sf_dir), ["metric", "track"], scale=float(SECOND))


@plan(
    "match_rollup",
    """
    SELECT metric, CASE WHEN GROUPING(course) = 1 THEN 'all' ELSE course END AS course,
      sum(reference_count)::BIGINT AS reference_count, sum(estimated_count)::BIGINT AS estimated_count,
      sum(true_positive_count)::BIGINT AS true_positive_count,
      coalesce(sum(true_positive_count) / nullif(sum(estimated_count), 0)::DOUBLE, 0) AS precision,
      coalesce(sum(true_positive_count) / nullif(sum(reference_count), 0)::DOUBLE, 0) AS recall,
      coalesce(2 * sum(true_positive_count) / nullif(sum(reference_count) + sum(estimated_count), 0)::DOUBLE, 0) AS f1,
      round_even(round_even((sum(mean_error * true_positive_count) / nullif(sum(true_positive_count), 0)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS mean_error,
      max(max_error) AS max_error, count(*) FILTER (reference_count > 0) AS applicable_count
    FROM (SELECT *, ['Easy', 'Normal', 'Hard', 'Oni'][CAST(track % 4 + 1 AS INTEGER)] AS course FROM matched)
    GROUP BY GROUPING SETS ((metric, course), (metric))
    """,
    ("matched",),
    recursive=True,
)
def match_rollup(spark, sf_dir):
    per_track = matching.match_metrics(_matches(spark, sf_dir), ["metric", "track"], scale=float(SECOND))
    names = F.array(*[F.lit(c) for c in ("Easy", "Normal", "Hard", "Oni")])
    with_course = per_track.withColumn("course", F.element_at(names, (F.pmod(F.col("track"), F.lit(4)) + 1).cast("int")))
    refs, ests, tp = "reference_count", "estimated_count", "true_positive_count"
    rolled = with_course.groupingSets([["metric", "course"], ["metric"]], "metric", "course").agg(
        F.grouping("course").alias("_total"),
        F.sum(refs).alias(refs),
        F.sum(ests).alias(ests),
        F.sum(tp).alias(tp),
        F.sum(F.col("mean_error") * F.col(tp)).alias("_error"),
        F.max("max_error").alias("max_error"),
        F.sum(F.when(F.col(refs) > 0, 1).otherwise(0)).alias("applicable_count"),
    )
    return rolled.select(
        "metric",
        F.when(F.col("_total") == 1, "all").otherwise(F.col("course")).alias("course"),
        refs,
        ests,
        tp,
        ratio(F.col(tp), F.col(ests)).alias("precision"),
        ratio(F.col(tp), F.col(refs)).alias("recall"),
        ratio(2 * F.col(tp), F.col(refs) + F.col(ests)).alias("f1"),
        round_half_even(ratio(F.col("_error"), F.col(tp), empty=None), 6).alias("mean_error"),
        "max_error",
        "applicable_count",
    )


@plan(
    "in_range",
    """
    SELECT p.track, p.event_id,
      EXISTS (SELECT 1 FROM ev r WHERE r.track = p.track AND r.kind = 'signup' AND p.t >= r.t - 3600000000
        AND p.t < r.t + 43200000000 + 3600000000) AS half_open,
      (SELECT count(*) FROM ev r WHERE r.track = p.track AND r.kind = 'signup' AND p.t >= r.t AND p.t <= r.t + 43200000000) AS closed_count
    FROM ev p WHERE p.kind IN ('click', 'purchase')
    """,
    ("ev",),
)
def in_range(spark, sf_dir):
    events = timeline(spark, sf_dir)
    points = of_kind(events, "click", "purchase").select("track", "event_id", "t")
    ranges = of_kind(events, "signup").select(
        "track", F.col("t").alias("start_t"), (F.col("t") + 12 * HOUR).alias("end_t")
    )
    wide = matching.count_covering(
        points, ranges, ["track"], margin=HOUR, cell_width=CELL, out="_open"
    )
    both = matching.count_covering(
        wide, ranges, ["track"], closed=True, cell_width=CELL, out="closed_count"
    )
    return both.select("track", "event_id", (F.col("_open") > 0).alias("half_open"), "closed_count")


@plan(
    "range_overlap",
    """
    SELECT l.track, l.event_id, EXISTS (SELECT 1 FROM ev r WHERE r.track = l.track AND r.kind = 'error'
      AND greatest(l.t, r.t) <= least(l.t + 21600000000, r.t + 43200000000)) AS overlaps
    FROM ev l WHERE l.kind = 'purchase'
    """,
    ("ev",),
)
def range_overlap(spark, sf_dir):
    events = timeline(spark, sf_dir)
    left = of_kind(events, "purchase").select(
        "track", "event_id", F.col("t").alias("start_t"), (F.col("t") + 6 * HOUR).alias("end_t")
    )
    right = of_kind(events, "error").select(
        "track", F.col("t").alias("start_t"), (F.col("t") + 12 * HOUR).alias("end_t")
    )
    flagged = matching.overlaps_any(left, right, ["track"], cell_width=CELL)
    return flagged.select("track", "event_id", "overlaps")


@plan(
    "overlap_mean",
    """
    WITH w AS (SELECT track, t AS s, t + 36000000000 + (event_id % 40) * 3600000000 AS e,
        0.65::DOUBLE * least(1, value / 500) + 0.35::DOUBLE * ((event_id % 100) / 100.0::DOUBLE) AS x FROM ev),
    b AS (SELECT track, s, e, x, unnest(range(s // 86400000000, (e + 86399999999) // 86400000000)) AS bar FROM w),
    o AS (SELECT track, bar, x, (least(e, (bar + 1) * 86400000000) - greatest(s, bar * 86400000000))::DOUBLE AS w FROM b)
    SELECT track, bar, sum(w) AS overlap, round_even(round_even((sum(w * x) / sum(w)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS mean_value
    FROM o WHERE w > 0 GROUP BY track, bar
    """,
    ("ev",),
)
def overlap_mean(spark, sf_dir):
    windows = timeline(spark, sf_dir).select(
        "track",
        F.col("t").alias("start_t"),
        (F.col("t") + 10 * HOUR + (F.col("event_id") % 40) * HOUR).alias("end_t"),
        (F.least(F.lit(1.0), F.col("value") / 500)).alias("other"),
        ((F.col("event_id") % 100) / 100.0).alias("mix"),
    )
    blend = 0.65 * F.col("other") + 0.35 * F.col("mix")
    means = matching.overlap_weighted_mean(windows, ["track"], DAY, blend)
    return means.withColumn("mean_value", round_half_even(F.col("mean_value"), 6))


@plan(
    "frame_lookup",
    """
    WITH f AS (SELECT track, t // 3600000000 AS frame, max(value) AS v FROM ev GROUP BY ALL),
    l AS (SELECT track, max(v) AS mv FROM f GROUP BY track),
    p AS (SELECT track, event_id, round_even(t / 3600000000.0::DOUBLE, 0)::BIGINT AS frame FROM ev WHERE kind = 'click')
    SELECT p.track, p.event_id, coalesce(max(CASE WHEN f.frame = p.frame THEN f.v END) / any_value(mv), 0) AS frame_value,
      coalesce(max(f.v) / any_value(mv), 0) AS near_value
    FROM p JOIN l ON l.track = p.track LEFT JOIN f ON f.track = p.track AND f.frame BETWEEN p.frame - 1 AND p.frame + 1
    GROUP BY p.track, p.event_id
    """,
    ("ev",),
)
def frame_lookup(spark, sf_dir):
    events = timeline(spark, sf_dir)
    frames = events.groupBy("track", F.floor(F.col("t") / HOUR).alias("frame")).agg(F.max("value").alias("value"))
    top = frames.groupBy("track").agg(F.max("value").alias("top"))
    clicks = of_kind(events, "click").select("track", "event_id", "t")
    frame_of = F.rint(F.col("t") / float(HOUR))
    exact = matching.frame_lookup(clicks, frames, ["track"], frame_of, out="exact")
    near = matching.frame_lookup(exact, frames, ["track"], frame_of, radius=1, out="near")
    return near.join(top, ["track"]).select(
        "track",
        "event_id",
        F.coalesce(F.col("exact") / F.col("top"), F.lit(0.0)).alias("frame_value"),
        F.coalesce(F.col("near") / F.col("top"), F.lit(0.0)).alias("near_value"),
    )


@plan(
    "interval_stats",
    """
    WITH d AS (SELECT DISTINCT track, t FROM ev),
    g AS (SELECT track, t, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS gap FROM d),
    m AS (SELECT track, quantile_cont(gap, 0.5) AS med FROM g WHERE gap IS NOT NULL GROUP BY track)
    SELECT g.track, count(gap) AS interval_count, avg(gap) / 1e6::DOUBLE AS mean_gap_s,
      round_even(round_even((stddev_pop(gap) / avg(gap)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS variation,
      round_even(round_even((CASE WHEN count(gap) < 2 THEN 0 ELSE greatest(0, least(1, 1 - avg(abs(gap - med)) / any_value(med))) END) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS stability,
      least(1, sum(gap)::DOUBLE / 2592000000000.0::DOUBLE) AS coverage
    FROM g JOIN m USING (track) WHERE gap IS NOT NULL GROUP BY g.track
    """,
    ("ev",),
)
def interval_stats(spark, sf_dir):
    stats = sequences.interval_stats(timeline(spark, sf_dir), ["track"], "t", 30 * DAY, CELL, HOUR)
    return stats.select(
        "track",
        "interval_count",
        (F.col("mean_gap") / float(SECOND)).alias("mean_gap_s"),
        round_half_even(F.col("variation"), 6).alias("variation"),
        round_half_even(F.col("stability"), 6).alias("stability"),
        "coverage",
    )


@plan(
    "period_fit",
    """
    WITH d AS (SELECT DISTINCT track, t FROM ev),
    n AS (SELECT track, t, row_number() OVER w - 2 AS ix, t - lag(t) OVER w AS gap, min(t) OVER (PARTITION BY track) AS t0,
      count(*) OVER (PARTITION BY track) - 1 AS cnt FROM d WINDOW w AS (PARTITION BY track ORDER BY t)),
    g AS (SELECT *, lag(gap) OVER (PARTITION BY track ORDER BY t) AS pg,
      abs((t - t0) - round_even((t - t0) / 36000000000.0::DOUBLE, 0) * 36000000000.0::DOUBLE) AS err,
      greatest(1, cnt // 3) AS size FROM n)
    SELECT track, round_even(avg(err), 0) AS mean_error, round_even(quantile_cont(err, 0.95), 0) AS p95_error, max(err) AS max_error,
      round_even(round_even((avg(err) / 36000000000.0::DOUBLE) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS error_ratio,
      avg(CASE WHEN abs(gap - 36000000000.0::DOUBLE) / 36000000000.0::DOUBLE >= 0.08::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS outlier_ratio,
      (quantile_cont(gap, 0.5) FILTER (ix >= cnt - size) - quantile_cont(gap, 0.5) FILTER (ix < size)) / 36000000000.0::DOUBLE AS drift_ratio,
      coalesce(max(abs(gap - pg) / 36000000000.0::DOUBLE), 0) AS max_adjacent_change
    FROM g WHERE gap IS NOT NULL GROUP BY track
    """,
    ("ev",),
)
def period_fit(spark, sf_dir):
    fit = sequences.period_fit(timeline(spark, sf_dir), ["track"], "t", 10 * HOUR, CELL)
    return fit.select(
        "track",
        F.rint("mean_error").alias("mean_error"),
        F.rint("p95_error").alias("p95_error"),
        "max_error",
        round_half_even(F.col("error_ratio"), 6).alias("error_ratio"),
        "outlier_ratio",
        "drift_ratio",
        "max_adjacent_change",
    )


cte(
    "kept",
    """SELECT track, min(t) AS t FROM ev GROUP BY track
UNION ALL
SELECT k.track, (SELECT min(e.t) FROM ev e WHERE e.track = k.track AND e.t > k.t + 18000000000) FROM kept k
WHERE EXISTS (SELECT 1 FROM ev e WHERE e.track = k.track AND e.t > k.t + 18000000000)""",
    "ev",
)


@plan(
    "beat_index",
    """
    SELECT track, t, (round_even(min(t) OVER (PARTITION BY track) / 36000000000.0::DOUBLE, 0)
      + coalesce(sum(step) OVER (PARTITION BY track ORDER BY t ROWS UNBOUNDED PRECEDING), 0))::BIGINT AS beat
    FROM (SELECT track, t, round_even((t - lag(t) OVER (PARTITION BY track ORDER BY t)) / 36000000000.0::DOUBLE, 0) AS step FROM kept)
    """,
    ("kept",),
    recursive=True,
)
def beat_index(spark, sf_dir):
    return _beat_index(timeline(spark, sf_dir))


def _beat_index(events, interval=10 * HOUR):
    """Beat number of every kept time: duplicates inside half an interval are ignored."""
    kept = sequences.spaced_picks(events, ["track"], "t", interval // 2, CELL)
    cell = time_cell(F.col("t"), CELL)
    stepped = ordered_scan(kept, ["track"], ["t"], cell, lag={"_prev": F.col("t")})
    step = F.coalesce(
        F.rint((F.col("t") - F.col("_prev")) / float(interval)), F.rint(F.col("t") / float(interval))
    ).cast("long")
    return ordered_scan(stepped, ["track"], ["t"], cell, cumsum={"beat": step}).select("track", "t", "beat")


@plan(
    "residual_regions",
    """
    WITH b AS (SELECT track, t, (round_even(min(t) OVER (PARTITION BY track) / 36000000000.0::DOUBLE, 0)
      + coalesce(sum(step) OVER (PARTITION BY track ORDER BY t ROWS UNBOUNDED PRECEDING), 0))::BIGINT AS beat
      FROM (SELECT track, t, round_even((t - lag(t) OVER (PARTITION BY track ORDER BY t)) / 36000000000.0::DOUBLE, 0) AS step FROM kept)),
    r AS (SELECT *, t - beat * 36000000000 AS res, CASE WHEN t < 864000000000 THEN 0 WHEN t < 1728000000000 THEN 1 ELSE 2 END AS reg FROM b),
    f AS (SELECT track, regr_slope(t, beat) AS sl, regr_intercept(t, beat) AS ic, count(*) AS n, max(t) - min(t) AS span FROM b GROUP BY track),
    q AS (SELECT r.track, list_sort(list(abs(r.res))) AS a, list_sort(list(abs(r.t - (f.ic + r.beat * f.sl)))) AS fe,
      quantile_cont(res, 0.5) AS med, quantile_cont(res, 0.5) FILTER (reg = 0) AS m0, quantile_cont(res, 0.5) FILTER (reg = 1) AS m1,
      quantile_cont(res, 0.5) FILTER (reg = 2) AS m2, any_value(f.n) AS n, any_value(f.span) AS span FROM r JOIN f USING (track) GROUP BY r.track)
    SELECT track, n AS point_count, m0 AS start_median, m1 AS middle_median, m2 AS end_median, med AS median_error,
      a[(least(n - 1, (n * 0.95::DOUBLE)::DOUBLE.floor()) + 1)::BIGINT]::DOUBLE AS p95_error,
      CASE WHEN n < 8 OR span / 2592000000000.0::DOUBLE < 0.5 OR m0 IS NULL OR m2 IS NULL THEN 'insufficient-evidence'
        WHEN fe[(least(n - 1, floor(n * 0.95::DOUBLE)) + 1)::BIGINT] > 10800000000 THEN 'irregular-tracker'
        WHEN abs(m2 - m0) > 10800000000 THEN 'possible-bpm-drift' WHEN abs(med) > 10800000000 THEN 'possible-offset-shift'
        ELSE 'aligned-to-tracker' END AS tracker_class
    FROM q
    """.replace("(n * 0.95::DOUBLE)::DOUBLE.floor()", "floor(n * 0.95::DOUBLE)"),
    ("kept",),
    recursive=True,
)
def residual_regions(spark, sf_dir):
    from pulsegrid.operators.tempo import residual_regions as regions

    return regions(
        _beat_index(timeline(spark, sf_dir)),
        ["track"],
        interval=10 * HOUR,
        duration=30 * DAY,
        tolerance=3 * HOUR,
        cell_width=HOUR,
    )


@plan(
    "cycle_stats",
    """
    WITH n AS (SELECT track, t, event_id, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS num FROM ev),
    s AS (SELECT *, lag(num) OVER w AS prev, sum(CASE WHEN num = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cyc
      FROM n WINDOW w AS (PARTITION BY track ORDER BY t, event_id)),
    o AS (SELECT track, count(*) AS n, sum((num BETWEEN 1 AND 4)::INT) AS v, sum((prev BETWEEN 1 AND 4 AND num = prev % 4 + 1)::INT) AS f, max(num) AS m, max(cyc) AS lc FROM s GROUP BY track),
    c AS (SELECT s.track, cyc, list(num ORDER BY t, event_id) AS l FROM s WHERE cyc > 0 GROUP BY ALL),
    w AS (SELECT c.track, count(*) AS cycles, sum((l = [1, 2, 3, 4])::INT) AS whole FROM c JOIN o USING (track) WHERE cyc < lc OR len(l) = 4 GROUP BY c.track),
    d AS (SELECT track, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS gap FROM (SELECT DISTINCT track, t FROM n WHERE num = 1)),
    ml AS (SELECT track, avg(greatest(0, 1 - abs(gap - 172800000000.0::DOUBLE) / 172800000000.0::DOUBLE)) AS s FROM d WHERE gap IS NOT NULL GROUP BY track)
    SELECT o.track, CASE WHEN n < 2 THEN 0 ELSE (v / n::DOUBLE) * (coalesce(f, 0) / (n - 1)::DOUBLE) END AS number_completeness,
      coalesce(whole / cycles::DOUBLE, 0) AS cycle_stability, CASE m WHEN 3 THEN '3/4' WHEN 6 THEN '6/8' ELSE '4/4' END AS meter,
      round_even(round_even((coalesce(ml.s, 0)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS meter_length_score
    FROM o LEFT JOIN w USING (track) LEFT JOIN ml USING (track)
    """,
    ("ev",),
)
def cycle_stats(spark, sf_dir):
    from pulsegrid.operators.tempo import length_score

    events = timeline(spark, sf_dir)
    kinds = ("view", "click", "purchase", "signup")
    number = F.lit(5)
    for i, kind in enumerate(kinds, start=1):
        number = F.when(F.col("kind") == kind, i).otherwise(number)
    cell = time_cell(F.col("t"), CELL)
    stats = sequences.cycle_stats(events, ["track"], ["t", "event_id"], cell, number, 4)
    lengths = length_score(of_kind(events, "view"), ["track"], "t", 2 * DAY, CELL)
    return stats.join(lengths, ["track"], "left").select(
        "track",
        "number_completeness",
        "cycle_stability",
        "meter",
        round_half_even(F.coalesce("length_score", F.lit(0.0)), 6).alias("meter_length_score"),
    )


@plan(
    "peak_pick",
    """
    WITH f AS (SELECT track, t // 21600000000 AS frame, max(value) AS v FROM ev GROUP BY ALL),
    n AS (SELECT *, lag(struct_pack(f := frame, v := v)) OVER w AS l, lead(struct_pack(f := frame, v := v)) OVER w AS r FROM f
      WINDOW w AS (PARTITION BY track ORDER BY frame)),
    p AS (SELECT track, frame, v, row_number() OVER (PARTITION BY track ORDER BY v DESC, frame DESC) AS k FROM n WHERE v >= 20
      AND v >= CASE WHEN l.f = frame - 1 THEN l.v ELSE 0 END AND v > CASE WHEN r.f = frame + 1 THEN r.v ELSE 0 END),
    a AS (SELECT track, list({'frame': frame, 'v': v} ORDER BY k) AS items FROM p GROUP BY track),
    sel AS (SELECT track, items, 1::BIGINT AS k, []::BIGINT[] AS kept FROM a
      UNION ALL SELECT track, items, k + 1, CASE WHEN len(list_filter(kept, lambda x: abs(x - items[k].frame) < 6)) = 0
        THEN list_append(kept, items[k].frame) ELSE kept END FROM sel WHERE k <= len(items)),
    fin AS (SELECT track, unnest(kept) AS frame FROM sel WHERE k = len(items) + 1)
    SELECT fin.track, fin.frame, p.v AS value FROM fin JOIN p ON p.track = fin.track AND p.frame = fin.frame
    """,
    ("ev",),
    recursive=True,
)
def peak_pick(spark, sf_dir):
    events = timeline(spark, sf_dir)
    frames = events.groupBy("track", F.floor(F.col("t") / (6 * HOUR)).alias("frame")).agg(F.max("value").alias("value"))
    peaks = sequences.local_peaks(frames, ["track"], "frame", "value", 20.0)
    return sequences.strongest_apart(peaks, ["track"], "frame", "value", 6)
