"""Plans over charts built from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import notes as N
from pulsegrid.functions.numeric import round_half_even
from pulsegrid.operators import charts
from pulsegrid.plans.bindings import TICKS, chart_bars
from pulsegrid.plans.registry import cte, plan

COURSES = ("Easy", "Normal", "Hard", "Oni")

cte(
    "marks",
    "SELECT track, list({'n': note, 't': time_s, 'b': bar, 'p': pos} ORDER BY bar, pos) AS l FROM nt WHERE note IN ('5', '7', '8') GROUP BY track",
    "nt",
)
cte(
    "corpus",
    """SELECT CAST(track // 4 AS BIGINT) AS source_id, ['Easy', 'Normal', 'Hard', 'Oni'][CAST(track % 4 + 1 AS INTEGER)] AS course,
  CAST(track % 10 + 1 AS INTEGER) AS level, track, bar, notes, res, start_s, end_s, bar % 8 >= 6 AS gogo FROM chart""",
    "chart",
)


def notes_of(spark, sf_dir):
    return charts.explode_notes(chart_bars(spark, sf_dir))


def corpus_bars(spark, sf_dir):
    """Chart bars as a corpus: four courses per source."""
    names = F.array(*[F.lit(c) for c in COURSES])
    return chart_bars(spark, sf_dir).select(
        F.floor(F.col("track") / 4).alias("source_id"),
        F.element_at(names, (F.pmod(F.col("track"), F.lit(4)) + 1).cast("int")).alias("course"),
        (F.pmod(F.col("track"), F.lit(10)) + 1).cast("int").alias("level"),
        "bar",
        "notes",
        "start_s",
        "end_s",
        "balloon_counts",
        (F.col("bar") % 8 >= 6).alias("gogo"),
    )


@plan(
    "note_counts",
    """
    SELECT track, bar, CAST(res - length(translate(notes, '1234', '')) AS INTEGER) AS normal_count,
      CAST(res - length(notes) + length(replace(notes, '0', '')) AS INTEGER) AS nonrest_count,
      CAST(res - length(translate(notes, '123457', '')) AS INTEGER) AS activity_count,
      CAST(res - length(translate(notes, '5679', '')) AS INTEGER) AS special_count,
      CAST(res - length(translate(notes, '1234579', '')) AS INTEGER) AS start_count
    FROM chart
    """,
    ("chart",),
)
def note_counts(spark, sf_dir):
    return charts.note_counts(chart_bars(spark, sf_dir), ["track", "bar"])


@plan("note_times", "SELECT track, bar, pos, res, note, time_s FROM nt", ("nt",))
def note_times(spark, sf_dir):
    return notes_of(spark, sf_dir)


@plan(
    "bar_duration",
    """
    WITH c AS (SELECT track, bar, res, 60 + (bar % 5) * 12.0::DOUBLE AS bpm FROM bars),
    ch AS (SELECT track, bar, pos, 60 + q * 2.0::DOUBLE AS nb, lead(pos) OVER (PARTITION BY track, bar ORDER BY pos) AS nx FROM nt WHERE note IN ('3', '4')),
    s AS (SELECT c.track, c.bar, c.res, c.bpm, min(ch.pos) AS first_pos, sum((coalesce(ch.nx, c.res) - ch.pos) / c.res::DOUBLE * 240.0::DOUBLE / ch.nb) AS rest
      FROM c LEFT JOIN ch ON ch.track = c.track AND ch.bar = c.bar GROUP BY ALL)
    SELECT track, bar, round_even(round_even(((coalesce(first_pos, res) / res::DOUBLE * 240.0::DOUBLE / bpm + coalesce(rest, 0))) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS duration_s FROM s
    """,
    ("nt", "bars"),
)
def bar_duration(spark, sf_dir):
    from pulsegrid.plans.bindings import slot_notes
    from pulsegrid.sources.chart_text import piecewise_duration

    bars = chart_bars(spark, sf_dir).withColumn("res", F.length("notes"))
    changes = (
        slot_notes(spark, sf_dir)
        .filter(F.col("note").isin("3", "4"))
        .groupBy("track", "bar")
        .agg(F.array_sort(F.collect_list(F.struct("tick", (60.0 + F.col("q") * 2.0).alias("bpm")))).alias("c"))
    )
    joined = bars.join(changes, ["track", "bar"], "left")
    scaled = F.transform(
        F.coalesce("c", F.array().cast("array<struct<tick:int,bpm:double>>")),
        lambda x: F.struct((x["tick"] * F.col("res") / TICKS).cast("int").alias("position"), x["bpm"].alias("bpm")),
    )
    duration = piecewise_duration(F.col("res"), F.lit(4.0), 60.0 + (F.col("bar") % 5) * 12.0, scaled)
    return joined.select("track", "bar", round_half_even(duration, 6).alias("duration_s"))


@plan(
    "pattern_key",
    """
    SELECT c.track, c.bar, coalesce(string_agg(f || ':' || note, '|' ORDER BY pos), '') AS pattern,
      coalesce(string_agg(CASE WHEN note IN ('1', '2', '3', '4') THEN f END, '|' ORDER BY pos), '') AS rhythm
    FROM chart c LEFT JOIN (SELECT *, CASE WHEN pos = 0 THEN '0' ELSE (pos // gcd(pos, res)) || '/' || (res // gcd(pos, res)) END AS f FROM nt) n
      ON n.track = c.track AND n.bar = c.bar GROUP BY c.track, c.bar
    """,
    ("chart", "nt"),
)
def pattern_key(spark, sf_dir):
    return chart_bars(spark, sf_dir).select(
        "track",
        "bar",
        N.pattern_key(F.col("notes")).alias("pattern"),
        N.pattern_key(F.col("notes"), N.NORMAL_NOTES, with_note=False).alias("rhythm"),
    )


@plan(
    "tick_project",
    """
    SELECT track, bar, pos, res, CAST(least(35, round_even(pos / res::DOUBLE * 36, 0)) AS INTEGER) AS tick36,
      CAST(least(res - 1, round_even(tick / 48.0::DOUBLE * res, 0)) AS INTEGER) AS slot_back,
      CAST(least(15, (tick + 1) // 3) AS INTEGER) AS slot16
    FROM nt
    """,
    ("nt",),
)
def tick_project(spark, sf_dir):
    tick = N.project_slot(F.col("pos"), F.col("res"), F.lit(TICKS))
    return notes_of(spark, sf_dir).select(
        "track",
        "bar",
        "pos",
        "res",
        N.project_slot(F.col("pos"), F.col("res"), F.lit(36)).alias("tick36"),
        N.project_slot(tick, F.lit(TICKS), F.col("res")).alias("slot_back"),
        F.least(F.lit(15), F.floor((tick + 1) / 3)).cast("int").alias("slot16"),
    )


@plan(
    "timeline_hash",
    """
    SELECT track, count(*) AS note_count, substr(sha256(string_agg(format('{:.9f}', time_s), ',' ORDER BY time_s)), 1, 16) AS times_hash
    FROM nt WHERE note IN ('1', '2', '3', '4', '5', '7', '9') GROUP BY track
    """,
    ("nt",),
)
def timeline_hash(spark, sf_dir):
    from pulsegrid.operators.gates import timeline_hash as hashed

    starts = notes_of(spark, sf_dir).filter(N.in_class(F.col("note"), N.NOTE_STARTS))
    return hashed(starts, ["track"], "bar", "time_s")


@plan(
    "chart_load",
    """
    SELECT track, sum(n)::BIGINT AS playable_note_count, sum(48.0::DOUBLE) AS playable_seconds, max(n) / 48.0::DOUBLE AS peak_bar_nps,
      sum(CASE WHEN n > 0 THEN 48.0::DOUBLE ELSE 0 END) AS active_seconds, coalesce(sum(n) / nullif(sum(48.0::DOUBLE), 0), 0) AS average_nps,
      coalesce(sum(n) / nullif(sum(CASE WHEN n > 0 THEN 48.0::DOUBLE ELSE 0 END), 0), 0) AS active_nps
    FROM (SELECT b.track, b.bar, count(n.note) FILTER (n.note IN ('1', '2', '3', '4')) AS n FROM bars b
      LEFT JOIN nt n ON n.track = b.track AND n.bar = b.bar GROUP BY ALL) GROUP BY track
    """,
    ("bars", "nt"),
)
def chart_load(spark, sf_dir):
    return charts.chart_load(chart_bars(spark, sf_dir), ["track"])


@plan(
    "color_balance",
    """
    WITH g AS (SELECT *, CASE WHEN note IN ('1', '2') THEN note END AS v, lag(note) OVER (PARTITION BY track ORDER BY bar, pos) AS pv FROM nt),
    r AS (SELECT *, sum(CASE WHEN v IS NULL OR pv IS DISTINCT FROM note THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY bar, pos) AS run FROM g),
    l AS (SELECT track, run, v, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY ALL),
    m AS (SELECT track, max(n) AS lr, max(n) FILTER (v = '1') AS ld FROM l GROUP BY track),
    c AS (SELECT track, sum((note = '1')::INT)::BIGINT AS don_count, sum((note = '2')::INT)::BIGINT AS ka_count FROM nt GROUP BY track)
    SELECT c.track, don_count, ka_count, coalesce(ka_count / nullif(don_count + ka_count, 0)::DOUBLE, 0) AS ka_ratio, coalesce(lr, 0) AS longest_run,
      CASE WHEN don_count + ka_count < 32 THEN NULL WHEN ka_count < 4 AND ka_count / (don_count + ka_count)::DOUBLE < 0.03 THEN 'nearly-all-don'
        WHEN coalesce(ld, 0) > 32 AND ka_count / (don_count + ka_count)::DOUBLE < 0.08 THEN 'overlong-don-run' END AS balance_issue
    FROM c LEFT JOIN m USING (track)
    """,
    ("nt",),
)
def color_balance(spark, sf_dir):
    return charts.color_balance(notes_of(spark, sf_dir), ["track"])


@plan(
    "color_runs",
    """
    WITH g AS (SELECT *, CASE WHEN note IN ('1', '2') THEN note END AS v, lag(note) OVER (PARTITION BY track ORDER BY bar, pos) AS pv FROM nt),
    r AS (SELECT *, sum(CASE WHEN v IS NULL OR pv IS DISTINCT FROM note THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY bar, pos) AS run FROM g),
    l AS (SELECT track, run, v, count(*) AS n FROM r WHERE v IS NOT NULL GROUP BY ALL)
    SELECT track, v AS color, n AS run_length, count(*) AS run_count FROM l GROUP BY ALL
    """,
    ("nt",),
)
def color_runs(spark, sf_dir):
    return charts.color_runs(notes_of(spark, sf_dir), ["track"])


@plan(
    "pattern_repeat",
    """
    WITH p AS (SELECT track, bar, string_agg((pos / res::DOUBLE) || ':' || note, '|' ORDER BY pos) AS pattern,
        count(*) FILTER (note IN ('1', '2', '3', '4', '5', '7')) AS act FROM nt GROUP BY ALL),
    c AS (SELECT track, pattern, count(*) AS n FROM p WHERE act > 0 GROUP BY ALL), s AS (SELECT track, count(*) AS bar_count FROM bars GROUP BY track)
    SELECT s.track, any_value(bar_count) AS bar_count, coalesce(sum(n - 1), 0)::BIGINT AS repeated_bar_count,
      coalesce(sum(n - 1) / nullif(sum(n), 0)::DOUBLE, 0) AS repeated_bar_rate,
      coalesce(sum((n > greatest(4, bar_count // 12))::INT), 0)::BIGINT AS overused_pattern_count
    FROM s LEFT JOIN c USING (track) GROUP BY s.track
    """,
    ("nt", "bars"),
)
def pattern_repeat(spark, sf_dir):
    return charts.pattern_repeat(chart_bars(spark, sf_dir), ["track"])


@plan(
    "empty_runs",
    """
    WITH e AS (SELECT b.track, b.bar FROM bars b WHERE NOT EXISTS (SELECT 1 FROM nt n WHERE n.track = b.track AND n.bar = b.bar AND n.note <> '8')),
    g AS (SELECT *, bar - row_number() OVER (PARTITION BY track ORDER BY bar) AS g FROM e)
    SELECT track, min(bar) AS run_start, max(bar) AS run_end, count(*) AS run_length FROM g GROUP BY track, g
    """,
    ("nt", "bars"),
)
def empty_runs(spark, sf_dir):
    return charts.empty_runs(chart_bars(spark, sf_dir), ["track"])


@plan(
    "sustain_spans",
    """
    WITH w AS (SELECT track, l, 1::BIGINT AS i, NULL::DOUBLE AS a, NULL::VARCHAR AS an, NULL::DOUBLE AS s, NULL::DOUBLE AS e, NULL::VARCHAR AS sn FROM marks
      UNION ALL SELECT track, l, i + 1, CASE WHEN l[i].n = '8' THEN NULL WHEN a IS NULL THEN l[i].t ELSE NULL END,
        CASE WHEN l[i].n = '8' THEN NULL WHEN a IS NULL THEN l[i].n ELSE NULL END,
        CASE WHEN l[i].n = '8' AND l[i].t > a THEN a END, CASE WHEN l[i].n = '8' AND l[i].t > a THEN l[i].t END,
        CASE WHEN l[i].n = '8' AND l[i].t > a THEN an END FROM w WHERE i <= len(l))
    SELECT track, s AS start_s, e AS end_s, sn AS note FROM w WHERE s IS NOT NULL
    """,
    ("marks",),
    recursive=True,
)
def sustain_spans(spark, sf_dir):
    return charts.sustain_spans(charts.sustain_events(chart_bars(spark, sf_dir), ["track"]), ["track"])


@plan(
    "span_issues",
    """
    WITH w AS (SELECT track, l, 1::BIGINT AS i, NULL::INTEGER AS ab, NULL::INTEGER AS ap, NULL::VARCHAR AS code, NULL::INTEGER AS bar, NULL::INTEGER AS pos FROM marks
      UNION ALL SELECT track, l, i + 1,
        CASE WHEN i > len(l) THEN NULL WHEN l[i].n = '8' THEN NULL WHEN ab IS NULL THEN l[i].b ELSE ab END,
        CASE WHEN i > len(l) THEN NULL WHEN l[i].n = '8' THEN NULL WHEN ab IS NULL THEN l[i].p ELSE ap END,
        CASE WHEN i > len(l) THEN CASE WHEN ab IS NOT NULL THEN 'unclosed-roll' END
          WHEN l[i].n = '8' AND ab IS NULL THEN 'orphan-roll-end' WHEN l[i].n <> '8' AND ab IS NOT NULL THEN 'overlapping-roll-start' END,
        CASE WHEN i > len(l) THEN ab ELSE l[i].b END, CASE WHEN i > len(l) THEN ap ELSE l[i].p END FROM w WHERE i <= len(l) + 1)
    SELECT track, bar, pos, code FROM w WHERE code IS NOT NULL
    """,
    ("marks",),
    recursive=True,
)
def span_issues(spark, sf_dir):
    return charts.span_issues(charts.sustain_events(chart_bars(spark, sf_dir), ["track"]), ["track"])


@plan(
    "sustain_metrics",
    """
    WITH s AS (SELECT n.track, n.bar, n.note, n.q, n.tick, (SELECT min(e.tick) FROM nt e WHERE e.track = n.track AND e.bar = n.bar AND e.note = '8' AND e.tick > n.tick) AS et
      FROM nt n WHERE n.note IN ('5', '7'))
    SELECT t.track, sum((note = '5')::INT)::BIGINT AS drumroll_count, sum((note = '7')::INT)::BIGINT AS balloon_count,
      coalesce(sum(CASE WHEN note = '5' THEN et - s.tick END), 0)::DOUBLE AS drumroll_seconds, coalesce(sum(CASE WHEN note = '7' THEN et - s.tick END), 0)::DOUBLE AS balloon_seconds,
      coalesce(sum(CASE WHEN note = '7' THEN (s.tick + q) % 7 + 1 END), 0)::BIGINT AS balloon_required_hits,
      coalesce(sum(CASE WHEN note = '7' THEN (s.tick + q) % 7 + 1 END) / nullif(sum(CASE WHEN note = '7' THEN et - s.tick END), 0)::DOUBLE, 0) AS balloon_hits_per_second
    FROM (SELECT DISTINCT track FROM bars) t LEFT JOIN s ON s.track = t.track GROUP BY t.track
    """,
    ("nt", "bars"),
)
def sustain_metrics(spark, sf_dir):
    return charts.sustain_metrics(chart_bars(spark, sf_dir), ["track"])


@plan(
    "isolation",
    """
    WITH n AS (SELECT *, time_s - lag(time_s) OVER w AS b, lead(time_s) OVER w - time_s AS a FROM nt WHERE note IN ('1', '2', '3', '4')
      WINDOW w AS (PARTITION BY track ORDER BY time_s))
    SELECT track, bar, pos, note, greatest(0, least(a, b)) AS nearest_s FROM n WHERE note IN ('3', '4') AND least(a, b) <= 1
    """,
    ("nt",),
)
def isolation(spark, sf_dir):
    return charts.isolation_violations(notes_of(spark, sf_dir), ["track"], 1.0)


@plan(
    "local_excess",
    """
    WITH h AS (SELECT b.track, b.bar, count(n.note) AS n, count(n.note) FILTER (n.note IN ('5', '7')) AS sp FROM bars b LEFT JOIN nt n ON n.track = b.track AND n.bar = b.bar GROUP BY ALL),
    x AS (SELECT *, lag(n) OVER w AS p, lead(n) OVER w AS f FROM h WINDOW w AS (PARTITION BY track ORDER BY bar))
    SELECT track, bar, sp > 0 AS special FROM x
    WHERE sp > 0 OR n >= (coalesce(p, 0) + coalesce(f, 0)) / nullif((p IS NOT NULL)::INT + (f IS NOT NULL)::INT, 0)::DOUBLE + 2
    """,
    ("nt", "bars"),
)
def local_excess(spark, sf_dir):
    return charts.local_excess(chart_bars(spark, sf_dir), ["track"])


@plan(
    "course_metrics",
    """
    WITH b AS (SELECT *, res - length(translate(notes, '1234', '')) AS n, res - length(translate(notes, '5679', '')) AS sp,
        lag(res) OVER (PARTITION BY source_id, course ORDER BY bar) AS pr FROM corpus),
    h AS (SELECT source_id, course, string_agg(res || ':' || c, ',' ORDER BY res) AS resolution_counts FROM (SELECT source_id, course, res, count(*) AS c FROM b GROUP BY ALL) GROUP BY ALL)
    SELECT b.source_id, b.course, any_value(level) AS level, count(*) AS bar_count, any_value(resolution_counts) AS resolution_counts,
      sum((pr <> res)::INT)::BIGINT AS resolution_change_count, sum(n)::BIGINT AS normal_note_count, sum(sp)::BIGINT AS special_note_count,
      sum(48.0::DOUBLE) AS playable_seconds, round_even(round_even((sum(n) / sum(48.0::DOUBLE)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS average_nps,
      round_even(round_even((max(n / 48.0::DOUBLE)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS peak_bar_nps, sum(gogo::INT)::BIGINT AS gogo_bar_count,
      coalesce(round_even(round_even((sum(CASE WHEN gogo THEN n END) / sum(CASE WHEN gogo THEN 48.0::DOUBLE END)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000, 0) AS gogo_average_nps
    FROM b JOIN h ON h.source_id = b.source_id AND h.course = b.course GROUP BY b.source_id, b.course
    """,
    ("corpus",),
)
def course_metrics(spark, sf_dir):
    return charts.course_metrics(corpus_bars(spark, sf_dir), ["source_id", "course", "level"])


@plan(
    "corpus_rollup",
    """
    SELECT 'total' AS kind, '' AS group_key, count(*) AS bar_count, sum(gogo::INT)::BIGINT AS gogo_bar_count, count(DISTINCT track) AS chart_count, count(DISTINCT source_id) AS source_count FROM corpus
    UNION ALL SELECT 'resolution', res::VARCHAR, count(*), sum(gogo::INT)::BIGINT, count(DISTINCT track), count(DISTINCT source_id) FROM corpus GROUP BY res
    UNION ALL SELECT 'course_level', course || ':' || level, count(*), sum(gogo::INT)::BIGINT, count(DISTINCT track), count(DISTINCT source_id) FROM corpus GROUP BY course, level
    """,
    ("corpus",),
)
def corpus_rollup(spark, sf_dir):
    return charts.corpus_rollup(corpus_bars(spark, sf_dir))


cte(
    "rolled",
    """SELECT *, avg(nps) OVER w AS m, row_number() OVER (PARTITION BY track ORDER BY bar) AS rn, count(*) OVER (PARTITION BY track) AS nb
FROM (SELECT *, (res - length(translate(notes, '1234', ''))) / 48.0::DOUBLE AS nps FROM corpus)
WINDOW w AS (PARTITION BY track ORDER BY bar ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)""",
    "corpus",
)
cte(
    "peaks",
    """SELECT track, arg_min(bar, (-round(m, 9), bar)) AS window_start, round_even(max(m) * 1000000000, 0) / 1000000000 AS window_mean FROM rolled
WHERE rn + 7 <= nb OR (nb < 8 AND rn = 1) GROUP BY track""",
    "rolled",
)
cte(
    "windows",
    """SELECT source_id, course, level, track, start_bar, arg_min(role, o) AS role, any_value(width) AS width FROM (
  SELECT e.*, unnest([{'o': 0, 'role': 'intro', 'start_bar': 0}, {'o': 1, 'role': 'cadence', 'start_bar': nb - width},
    {'o': 2, 'role': 'peak', 'start_bar': least(nb - width, window_start)}], recursive := true)
  FROM (SELECT track, any_value(source_id) AS source_id, any_value(course) AS course, any_value(level) AS level, count(*) AS nb, least(8, count(*)) AS width FROM corpus GROUP BY track) e
  JOIN peaks USING (track)) GROUP BY ALL""",
    "corpus",
    "peaks",
)
cte(
    "ref_windows",
    """SELECT w.source_id, w.course, w.level, w.role, w.start_bar::INTEGER AS start_bar, (w.start_bar + any_value(width) - 1)::INTEGER AS end_bar,
  round_even(round_even((sum(nps * 48) / sum(48.0::DOUBLE)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS average_nps, round_even(round_even((avg(gogo::INT)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS gogo_ratio,
  string_agg((r.bar - w.start_bar) || '|' || r.res || '|' || gogo::INT || '|' || (nps * 48)::INTEGER || '|' || coalesce(ev, '') || '|' || coalesce(bc, ''), ';' ORDER BY r.bar) AS bars
FROM windows w JOIN rolled r ON r.track = w.track AND r.bar BETWEEN w.start_bar AND w.start_bar + w.width - 1
LEFT JOIN (SELECT track, bar, string_agg(pos || ':' || note, ' ' ORDER BY pos) AS ev, string_agg(CASE WHEN note = '7' THEN ((tick + q) % 7 + 1)::VARCHAR END, ',' ORDER BY pos) AS bc FROM nt GROUP BY ALL) x
  ON x.track = r.track AND x.bar = r.bar
GROUP BY w.source_id, w.course, w.level, w.role, w.start_bar""",
    "windows",
    "rolled",
    "nt",
)


@plan("peak_window", "SELECT track, window_start, window_mean FROM peaks", ("peaks",))
def peak_window(spark, sf_dir):
    rated = chart_bars(spark, sf_dir).withColumn("nps", charts.bar_nps())
    return charts.rolling_best(rated, ["track"], "bar", "nps", 8)


@plan("reference_windows", "SELECT * FROM ref_windows", ("ref_windows",))
def reference_windows(spark, sf_dir):
    return charts.reference_windows(corpus_bars(spark, sf_dir), ["source_id", "course", "level"], 8)


@plan(
    "window_retrieval",
    """
    WITH rq AS (SELECT DISTINCT course AS want_course, level AS want_level FROM corpus UNION ALL SELECT 'Edit', level FROM (SELECT DISTINCT level FROM corpus)),
    c AS (SELECT want_course, want_level, abs(w.level - want_level) AS d, w.role, w.source_id, w.course, w.level, w.start_bar, average_nps FROM rq
      JOIN ref_windows w ON w.course = want_course OR NOT EXISTS (SELECT 1 FROM corpus k WHERE k.course = want_course)),
    p0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY want_course, want_level ORDER BY d, start_bar, source_id, course) AS rn FROM c WHERE role = 'intro') WHERE rn = 1),
    p1 AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.want_course, c.want_level ORDER BY c.d, (c.source_id = p0.source_id)::INT, -c.average_nps, c.source_id, c.course) AS rn
      FROM c LEFT JOIN p0 ON p0.want_course = c.want_course AND p0.want_level = c.want_level WHERE c.role = 'peak') WHERE rn = 1),
    p2 AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.want_course, c.want_level ORDER BY c.d, coalesce(c.source_id IN (p0.source_id, p1.source_id), false)::INT, c.start_bar, c.source_id, c.course) AS rn
      FROM c LEFT JOIN p0 ON p0.want_course = c.want_course AND p0.want_level = c.want_level LEFT JOIN p1 ON p1.want_course = c.want_course AND p1.want_level = c.want_level WHERE c.role = 'cadence') WHERE rn = 1),
    t AS (SELECT *, 0 AS o FROM p0 UNION ALL SELECT *, 1 FROM p1 UNION ALL SELECT *, 2 FROM p2),
    f AS (SELECT c.*, 0 AS rn, 3 + row_number() OVER (PARTITION BY c.want_course, c.want_level ORDER BY c.d,
        EXISTS (SELECT 1 FROM t WHERE t.want_course = c.want_course AND t.want_level = c.want_level AND t.source_id = c.source_id)::INT, c.source_id, c.start_bar, c.course, c.role) AS o
      FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.want_course = c.want_course AND t.want_level = c.want_level AND t.source_id = c.source_id AND t.course = c.course AND t.start_bar = c.start_bar)),
    a AS (SELECT *, row_number() OVER (PARTITION BY want_course, want_level ORDER BY o) - 1 AS pick FROM (SELECT * FROM t UNION ALL SELECT * FROM f))
    SELECT want_course, want_level, pick::INTEGER AS pick, role, source_id, course, level, start_bar FROM a WHERE pick < 5
    """,
    ("ref_windows",),
)
def window_retrieval(spark, sf_dir):
    corpus = corpus_bars(spark, sf_dir)
    windows = charts.reference_windows(corpus, ["source_id", "course", "level"], 8).drop("bars")
    asked = corpus.select("course", "level").distinct()
    unknown = corpus.select(F.lit("Edit").alias("course"), "level").distinct()
    return charts.retrieve_windows(windows, asked.unionByName(unknown), per_request=5)
