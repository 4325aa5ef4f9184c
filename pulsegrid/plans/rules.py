"""Plans for rule validation, repairs, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.functions import notes as N
from pulsegrid.functions.numeric import flag_sum, ratio, round_half_even
from pulsegrid.operators import binning, charts, evidence as ev, gates, matching, rules
from pulsegrid.plans.bindings import HOUR, SECOND, TICKS, bar_spine, chart_bars, evidence, lines, of_kind, table, timeline
from pulsegrid.plans.charts import COURSES, corpus_bars, notes_of
from pulsegrid.plans.evidence import _EDGE, _r, bar_context, bursts_of, event_bars, ranked, scored
from pulsegrid.plans.quality import load_rows, timed_notes
from pulsegrid.plans.registry import SQL, cte, plan
from pulsegrid.plans.structure import _text_sql, document_rows
from pulsegrid.sources.exports import PHRASE, SOURCES, STRUCTURE, compact_bars


@plan(
    "chart_issues",
    """
    WITH m AS (SELECT c.track, c.bar, CASE WHEN c.bar % 11 = 3 THEN left(c.notes, c.res - 1) || '9' WHEN c.bar % 13 = 5 THEN '' ELSE c.notes END AS notes,
        CASE WHEN c.bar % 5 = 0 THEN [] ELSE coalesce((SELECT list((n.tick + n.q) % 7 + 1 ORDER BY n.pos) FROM nt n WHERE n.track = c.track AND n.bar = c.bar AND n.note = '7'), []) END AS b0 FROM chart c),
    k AS (SELECT track, bar, notes, list_concat(list_concat(b0, CASE WHEN bar % 7 = 0 THEN [3] ELSE [] END), CASE WHEN bar % 9 = 0 THEN [-1] ELSE [] END) AS counts, list_filter(range(0, length(notes)), lambda i: substr(notes, i + 1, 1) = '7') AS bl FROM m)
    SELECT track, bar, NULL::INTEGER AS pos, 'invalid-note-count' AS code FROM k WHERE notes = ''
    UNION ALL SELECT track, bar, i::INTEGER, 'unsupported-note-character' FROM k, range(0, 48) t(i) WHERE i < length(notes) AND substr(notes, i + 1, 1) = '9'
    UNION ALL SELECT track, bar, bl[i]::INTEGER, 'missing-balloon-count' FROM k, range(1, 49) t(i) WHERE i > len(counts) AND i <= len(bl)
    UNION ALL SELECT track, bar, NULL, 'extra-balloon-count' FROM k, range(1, 49) t(i) WHERE i > len(bl) AND i <= len(counts)
    UNION ALL SELECT track, bar, NULL, 'invalid-balloon-count' FROM k, range(1, 49) t(i) WHERE i <= len(counts) AND counts[i] <= 0
    """,
    ("chart", "nt"),
)
def chart_issues(spark, sf_dir):
    b = F.col("bar")
    none = F.array().cast("array<int>")
    notes = (
        F.when(b % 11 == 3, F.concat(F.expr("left(notes, length(notes) - 1)"), F.lit("9")))
        .when(b % 13 == 5, "")
        .otherwise(F.col("notes"))
    )
    counts = F.concat(
        F.when(b % 5 == 0, none).otherwise(F.col("balloon_counts")),
        F.when(b % 7 == 0, F.array(F.lit(3))).otherwise(none),
        F.when(b % 9 == 0, F.array(F.lit(-1))).otherwise(none),
    )
    bars = chart_bars(spark, sf_dir).select("track", "bar", notes.alias("notes"), counts.alias("balloon_counts"))
    return rules.chart_issues(bars, ["track"])


cte(
    "eh",
    """SELECT track, bar, CASE WHEN q = 47 THEN tick + 48 ELSE tick END AS tick, CASE flag WHEN 'N' THEN '1' WHEN 'R' THEN '2' ELSE CASE WHEN q = 46 THEN '6' ELSE '3' END END AS note FROM ln WHERE status = 'O' AND q BETWEEN 40 AND 47""",
    "ln",
)
cte(
    "el",
    """SELECT DISTINCT track, bar, tick AS s, tick + disc AS e, CASE WHEN tax % 3 = 1 THEN 'balloon' WHEN tax = 2 THEN 'slide' ELSE 'drumroll' END AS kind, CASE WHEN tax % 3 = 1 THEN disc WHEN tax = 3 THEN 5 END AS bc FROM ln WHERE status = 'F' AND q >= 48""",
    "ln",
)
cte(
    "enc",
    """WITH h AS (SELECT DISTINCT *, CASE WHEN bar % 3 = 1 THEN 2 ELSE 1 END AS st FROM eh),
hj AS (SELECT *, CASE WHEN tick < 0 OR tick >= 48 THEN 'tick-out-of-range' WHEN tick % st <> 0 THEN 'tick-not-representable' WHEN note NOT IN ('1', '2', '3', '4') THEN 'unsupported-hit-note' END AS code FROM h),
lj AS (SELECT *, list_filter([CASE WHEN kind NOT IN ('drumroll', 'balloon') THEN 'unsupported-long-note-kind' END, CASE WHEN e >= 48 THEN 'tick-out-of-range' END, CASE WHEN e < 48 AND (s % st <> 0 OR e % st <> 0) THEN 'tick-not-representable' END,
    CASE WHEN e <= s THEN 'invalid-long-note-range' END, CASE WHEN kind = 'balloon' AND coalesce(bc, 0) <= 0 THEN 'invalid-balloon-count' END, CASE WHEN kind <> 'balloon' AND bc IS NOT NULL THEN 'unexpected-balloon-count' END], lambda x: x IS NOT NULL) AS codes
  FROM (SELECT *, CASE WHEN bar % 3 = 1 THEN 2 ELSE 1 END AS st FROM el)),
gh AS (SELECT * FROM hj WHERE code IS NULL), gl AS (SELECT * FROM lj WHERE len(codes) = 0)
SELECT track, bar, 'i' AS what, tick, code, NULL AS note FROM hj WHERE code IS NOT NULL
UNION ALL SELECT track, bar, 'i', s, unnest(codes), NULL FROM lj
UNION ALL SELECT track, bar, 'i', tick, 'conflicting-hit', NULL FROM gh GROUP BY track, bar, tick HAVING count(DISTINCT note) > 1
UNION ALL SELECT track, bar, 'i', s, 'overlapping-long-notes', NULL FROM (SELECT *, lag(e) OVER (PARTITION BY track, bar ORDER BY s, e) AS pe FROM gl) WHERE s <= pe
UNION ALL SELECT track, bar, 'i', tick, 'hit-inside-long-note', NULL FROM (SELECT DISTINCT track, bar, tick FROM gh) g WHERE EXISTS (SELECT 1 FROM gl WHERE gl.track = g.track AND gl.bar = g.bar AND g.tick BETWEEN gl.s AND gl.e)
UNION ALL SELECT track, bar, 's', tick // st, NULL, note FROM gh
UNION ALL SELECT track, bar, 's', s // st, NULL, CASE kind WHEN 'balloon' THEN '7' ELSE '5' END FROM gl UNION ALL SELECT track, bar, 's', e // st, NULL, '8' FROM gl""",
    "eh",
    "el",
)


def _event_inputs(spark, sf_dir):
    rows = lines(spark, sf_dir)
    q, tax = F.col("q"), F.col("tax")
    note = F.when(F.col("flag") == "N", "1").when(F.col("flag") == "R", "2").when(q == 46, "6").otherwise("3")
    tick = F.when(q == 47, F.col("tick") + TICKS).otherwise(F.col("tick"))
    hits = rows.filter((F.col("status") == "O") & q.between(40, 47)).select("track", "bar", tick.alias("tick"), note.alias("note"))
    kind = F.when(tax % 3 == 1, "balloon").when(tax == 2, "slide").otherwise("drumroll")
    count = F.when(tax % 3 == 1, F.col("disc")).when(tax == 3, 5)
    longs = rows.filter((F.col("status") == "F") & (q >= 48)).select(
        "track",
        "bar",
        F.col("tick").alias("start_tick"),
        (F.col("tick") + F.col("disc")).alias("end_tick"),
        kind.alias("kind"),
        count.alias("balloon_count"),
    )
    bars = rows.select("track", "bar").distinct().withColumn(
        "resolution", F.when(F.col("bar") % 3 == 1, 24).otherwise(48)
    )
    return hits, longs.distinct(), bars


@plan(
    "event_encode",
    """
    WITH b AS (SELECT DISTINCT track, bar, CASE WHEN bar % 3 = 1 THEN 24 ELSE 48 END AS res FROM ln), c AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM enc WHERE enc.track = b.track AND enc.bar = b.bar AND what = 'i'))
    SELECT c.track, c.bar, string_agg(coalesce(e.note, '0'), '' ORDER BY p.i) AS notes FROM c JOIN range(0, 48) p(i) ON p.i < c.res
    LEFT JOIN (SELECT DISTINCT * FROM enc WHERE what = 's') e ON e.track = c.track AND e.bar = c.bar AND e.tick = p.i GROUP BY c.track, c.bar
    """,
    ("enc", "ln"),
)
def event_encode(spark, sf_dir):
    return rules.encode_events(*_event_inputs(spark, sf_dir), ["track", "bar"], TICKS)[1]


@plan("encode_issues", "SELECT track, bar, tick, code FROM enc WHERE what = 'i'", ("enc",))
def encode_issues(spark, sf_dir):
    return rules.encode_events(*_event_inputs(spark, sf_dir), ["track", "bar"], TICKS)[0]


@plan(
    "event_conflicts",
    """
    SELECT track, bar, tick, 'conflicting-hit' AS code FROM eh GROUP BY ALL HAVING count(DISTINCT note) > 1
    UNION ALL SELECT track, bar, s, 'overlapping-long-notes' FROM (SELECT *, lag(e) OVER (PARTITION BY track, bar ORDER BY s, e) AS pe FROM el) WHERE s <= pe
    UNION ALL SELECT track, bar, tick, 'hit-inside-long-note' FROM (SELECT DISTINCT track, bar, tick FROM eh) g WHERE EXISTS (SELECT 1 FROM el WHERE el.track = g.track AND el.bar = g.bar AND g.tick BETWEEN el.s AND el.e)
    """,
    ("eh", "el"),
)
def event_conflicts(spark, sf_dir):
    hits, longs, _ = _event_inputs(spark, sf_dir)
    return rules.event_conflicts(hits, longs, ["track", "bar"])


@plan(
    "sustain_issues",
    f"""
    WITH sp AS (SELECT track, bar, CASE WHEN burst_score >= 0.40::DOUBLE AND burst_confidence >= 0.50::DOUBLE AND end_tick > greatest(24, start_tick) AND s0 < 47 AND e1 > s0 THEN s0 END AS a, e1 AS z
      FROM (SELECT *, CASE WHEN e0 <= s0 THEN least(47, s0 + 1) ELSE e0 END AS e1 FROM (SELECT *, greatest(24, start_tick) AS s0, least(47, end_tick) AS e0 FROM bur))),
    j AS (SELECT el.*, sp.a, sp.z FROM el LEFT JOIN sp ON sp.track = el.track AND sp.bar = el.bar)
    SELECT track, bar, code, count(*) AS issue_count FROM (SELECT track, bar, 'too-many-long-notes' AS code FROM el GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT track, bar, 'no-reliable-burst' FROM j WHERE a IS NULL
      UNION ALL SELECT track, bar, 'outside-burst' FROM j WHERE s < a OR (a IS NOT NULL AND e > z) UNION ALL SELECT track, bar, 'too-short' FROM j WHERE a IS NOT NULL AND e - s < 3) GROUP BY ALL
    """,
    ("el", "bur"),
)
def sustain_issues(spark, sf_dir):
    _, longs, _ = _event_inputs(spark, sf_dir)
    start, end = ev.burst_span(TICKS, TICKS)
    spans = bursts_of(spark, sf_dir).select("track", "bar", start.alias("span_start"), end.alias("span_end"))
    return rules.sustain_issues(longs, spans, ["track", "bar"], 1.0, 3.0)


@plan(
    "nearest_tick",
    """
    SELECT c.track, c.bar, c.tick, arg_min(n.tick, abs(n.tick - c.tick) * 100 + n.tick) AS hit_tick FROM cand c LEFT JOIN nn n ON n.track = c.track AND n.bar = c.bar WHERE c.kind = 'strong-transient' GROUP BY ALL
    """,
    ("cand", "nn"),
)
def nearest_tick(spark, sf_dir):
    strong = ranked(spark, sf_dir).filter(F.col("kind") == "strong-transient").select("track", "bar", "tick")
    return rules.nearest_tick(strong, timed_notes(spark, sf_dir), ["track", "bar"], TICKS)


cte(
    "bspan",
    """WITH l AS (SELECT track, bar, note, tick, coalesce(sum((note = '8')::INT) OVER (PARTITION BY track, bar ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM nt WHERE note IN ('5', '7', '8'))
SELECT track, bar, max(tick) FILTER (note <> '8') AS s, max(tick) FILTER (note = '8') AS e FROM l GROUP BY track, bar, seg HAVING count(*) FILTER (note = '8') > 0 AND count(*) FILTER (note <> '8') > 0""",
    "nt",
)


@plan(
    "skeleton_compare",
    """
    WITH w AS (SELECT DISTINCT track, bar, tick FROM cand WHERE reliable), h AS (SELECT DISTINCT track, bar, tick FROM nn),
    b AS (SELECT coalesce(w.track, h.track) AS track, coalesce(w.bar, h.bar) AS bar, coalesce(w.tick, h.tick) AS tick, w.tick IS NOT NULL AS w, h.tick IS NOT NULL AS h FROM w FULL JOIN h ON h.track = w.track AND h.bar = w.bar AND h.tick = w.tick),
    c AS (SELECT *, w AND NOT h AND EXISTS (SELECT 1 FROM bspan s WHERE s.track = b.track AND s.bar = b.bar AND b.tick BETWEEN s.s AND s.e) AS u FROM b),
    s AS (SELECT track, sum(w::INT)::BIGINT AS ex, sum(h::INT)::BIGINT AS ac, sum(((w AND h) OR u)::INT)::BIGINT AS ma, sum((h AND NOT w)::INT)::BIGINT AS xt FROM c GROUP BY track), z AS (SELECT track, count(*) AS n FROM bars GROUP BY track)
    SELECT s.track, ex AS expected_count, ac AS actual_count, ma AS matched_count, xt AS extra_count, coalesce(ma / nullif(ex, 0)::DOUBLE, 1) AS coverage, coalesce(xt / nullif(ac, 0)::DOUBLE, 0) AS extra_rate,
      n >= 16 AND ex >= 32 AND coalesce(ma / nullif(ex, 0)::DOUBLE, 1) < 0.85 AS misses_too_much, n >= 16 AND ex >= 32 AND coalesce(xt / nullif(ac, 0)::DOUBLE, 0) > 0.15 AS adds_too_much FROM s JOIN z USING (track)
    """,
    ("cand", "nn", "bspan", "bars"),
)
def skeleton_compare(spark, sf_dir):
    expected = ranked(spark, sf_dir).filter("reliable")
    tick = N.project_slot(F.col("pos"), F.col("res"), F.lit(TICKS))
    marks = notes_of(spark, sf_dir).filter(F.col("note").isin("5", "7", "8")).withColumn("tick", tick)
    closed = F.when(F.col("note") == "8", 1).otherwise(0)
    order = Window.partitionBy("track", "bar").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        marks.withColumn("seg", F.coalesce(F.sum(closed).over(order), F.lit(0)))
        .groupBy("track", "bar", "seg")
        .agg(
            F.max(F.when(F.col("note") != "8", F.col("tick"))).alias("start_tick"),
            F.max(F.when(F.col("note") == "8", F.col("tick"))).alias("end_tick"),
        )
        .dropna()
        .drop("seg")
    )
    return rules.skeleton_compare(expected, timed_notes(spark, sf_dir), spans, ["track"], chart_bars(spark, sf_dir))


@plan(
    "issue_groups",
    r"""
    WITH m AS (SELECT track, bar, 'bars[' || bar || '].notes is too ' || CASE WHEN notes > max_hits THEN 'dense' ELSE 'sparse' END || ' for ' || kind || ': ' || notes AS message FROM hint WHERE notes > max_hits OR (NOT allow_empty AND notes < min_hits)),
    g AS (SELECT *, regexp_replace(message, '\[\d+\]', '[*]', 'g') AS template FROM m), n AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY track, bar) AS rn FROM g)
    SELECT template, count(*) AS occurrences, string_agg(message, '; ' ORDER BY rn) FILTER (rn <= 3) AS examples FROM n GROUP BY template
    """,
    ("hint",),
)
def issue_groups(spark, sf_dir):
    from pulsegrid.plans.quality import hinted_bars

    c = F.col
    too_dense = c("notes") > c("max_hits")
    bad = hinted_bars(spark, sf_dir).filter(too_dense | (~c("allow_empty") & (c("notes") < c("min_hits"))))
    text = F.concat(
        F.lit("bars["), c("bar").cast("string"), F.lit("].notes is too "), F.when(too_dense, "dense").otherwise("sparse"),
        F.lit(" for "), c("kind"), F.lit(": "), c("notes").cast("string"),
    )
    return rules.issue_groups(bad.select("track", "bar", text.alias("message")), ["track", "bar"])


@plan(
    "apply_repairs",
    """
    WITH n AS (SELECT *, least(time_s - lag(time_s) OVER w, lead(time_s) OVER w - time_s) AS d FROM nn2 WINDOW w AS (PARTITION BY track ORDER BY time_s)),
    r AS (SELECT track, bar, pos, CASE WHEN d <= 1 AND note = '3' THEN '1' WHEN d <= 1 AND note = '4' THEN '2' ELSE note END AS note FROM n UNION ALL SELECT track, bar, pos, note FROM nt WHERE note NOT IN ('1', '2', '3', '4'))
    SELECT b.track, b.bar, CASE WHEN b.bar % 17 = 0 THEN repeat('0', b.res) ELSE string_agg(coalesce(r.note, '0'), '' ORDER BY p.i) END AS notes,
      CASE WHEN b.bar % 17 = 0 THEN 0 ELSE count(*) FILTER (r.note = '7') END::INTEGER AS balloon_count
    FROM bars b JOIN range(0, 48) p(i) ON p.i < b.res LEFT JOIN r ON r.track = b.track AND r.bar = b.bar AND r.pos = p.i GROUP BY b.track, b.bar, b.res
    """.replace("nn2", "(SELECT * FROM nt WHERE note IN ('1', '2', '3', '4'))"),
    ("nt", "bars"),
)
def apply_repairs(spark, sf_dir):
    bars = chart_bars(spark, sf_dir)
    violations = charts.isolation_violations(notes_of(spark, sf_dir), ["track"], 1.0)
    fixed = rules.apply_repairs(bars, violations, bars.filter(F.col("bar") % 17 == 0), ["track"])
    return fixed.select("track", "bar", "notes", F.size("balloon_counts").alias("balloon_count"))


@plan(
    "metric_gate",
    """
    WITH o AS (SELECT *, o_orderdate < TIMESTAMP '1998-01-01' AS old FROM orders),
    m AS (SELECT old, 'orders:' || o_orderpriority AS metric, count(*)::DOUBLE AS value FROM o GROUP BY ALL UNION ALL SELECT old, 'open-share:' || o_orderpriority, round_even(avg((o_orderstatus = 'O')::INT) * 1000000, 0) / 1000000 FROM o GROUP BY ALL
      UNION ALL SELECT old, 'top-price:' || o_orderpriority, max(o_totalprice) FROM o GROUP BY ALL),
    r AS (SELECT DISTINCT metric, CASE split_part(metric, ':', 1) WHEN 'orders' THEN 'below' WHEN 'open-share' THEN 'at_least' ELSE 'minimum' END AS rule FROM m UNION ALL SELECT 'missing', 'equal')
    SELECT r.metric, r.rule, b.value AS baseline, c.value AS current, round_even((c.value - b.value) * 1000000, 0) / 1000000 AS delta,
      coalesce(CASE rule WHEN 'below' THEN c.value < b.value WHEN 'at_least' THEN c.value >= b.value WHEN 'minimum' THEN c.value >= 499000 ELSE c.value = b.value END, false) AS passed
    FROM r LEFT JOIN (SELECT * FROM m WHERE old) b ON b.metric = r.metric LEFT JOIN (SELECT * FROM m WHERE NOT old) c ON c.metric = r.metric
    """,
)
def metric_gate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("old", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    sums = orders.groupBy("old", "o_orderpriority").agg(
        F.count(F.lit(1)).cast("double").alias("orders"),
        round_half_even(F.avg((F.col("o_orderstatus") == "O").cast("double")), 6).alias("open-share"),
        F.max("o_totalprice").alias("top-price"),
    )
    entries = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).alias("value")) for n in ("orders", "open-share", "top-price")])
    metrics = sums.select("old", "o_orderpriority", F.inline(entries)).select(
        "old", F.concat_ws(":", "n", "o_orderpriority").alias("metric"), "value"
    )
    head = F.substring_index("metric", ":", 1)
    rule = F.when(head == "orders", "below").when(head == "open-share", "at_least").otherwise("minimum")
    names = metrics.select("metric").distinct().select("metric", rule.alias("rule"), F.lit(499000.0).alias("threshold"))
    extra = spark.range(1).select(F.lit("missing").alias("metric"), F.lit("equal").alias("rule"), F.lit(0.0).alias("threshold"))
    return gates.metric_gate(
        metrics.filter("old").drop("old"), metrics.filter("NOT old").drop("old"), names.unionByName(extra)
    )


@plan(
    "determinism",
    """
    SELECT count(*) AS first_rows, count(*) AS second_rows, 0::BIGINT AS different_rows, true AS identical FROM (SELECT DISTINCT track, round_even(t / 450000000.0::DOUBLE, 0) AS a FROM ev)
    """,
    ("ev",),
)
def determinism(spark, sf_dir):
    def run(events):
        return binning.bar_grid(events, ["track"], F.col("t"), F.col("value"), start=0, tick=450 * SECOND, ticks=48)

    events = timeline(spark, sf_dir)
    return gates.determinism(run(events), run(events.repartition(13, "event_id")))


@plan(
    "artifact_mismatches",
    "SELECT doc_id AS name, CASE WHEN doc_id % 17 = 0 THEN 'missing-rebuild' ELSE 'content-mismatch' END AS code FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0",
)
def artifact_mismatches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    expected = docs.select(F.col("doc_id").alias("name"), F.sha2("text", 256).alias("hash"))
    rebuilt = docs.filter("doc_id % 17 <> 0").select(F.col("doc_id").alias("name"), F.sha2(body, 256).alias("hash"))
    return gates.artifact_mismatches(expected, rebuilt)


@plan(
    "monotonic_check",
    """
    WITH c AS (SELECT source_id, list_position(['Easy', 'Normal', 'Hard', 'Oni'], course) AS o, sum(res - length(translate(notes, '1234', ''))) AS n FROM corpus GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY source_id ORDER BY o) AS p FROM c)
    SELECT source_id, bool_and(p IS NULL OR n >= p) AS monotonic, count(*) AS steps FROM l GROUP BY source_id
    """,
    ("corpus",),
)
def monotonic_check(spark, sf_dir):
    order = F.array_position(F.array(*[F.lit(c) for c in COURSES]), F.col("course"))
    counts = corpus_bars(spark, sf_dir).groupBy("source_id", order.alias("o")).agg(F.sum(N.normal_count(F.col("notes"))).alias("n"))
    return gates.monotonic_check(counts, ["source_id"], "o", "n")


@plan(
    "plan_mismatch",
    """
    WITH p AS (SELECT track, bar + 1 AS bar, CASE WHEN bar % 2 = 0 THEN 48 ELSE 24 END AS expected FROM bars)
    SELECT coalesce(b.track, p.track) AS track, coalesce(b.bar, p.bar) AS bar, b.res AS actual, p.expected FROM bars b FULL JOIN p ON p.track = b.track AND p.bar = b.bar WHERE b.res IS DISTINCT FROM p.expected
    """,
    ("bars",),
)
def plan_mismatch(spark, sf_dir):
    bars = chart_bars(spark, sf_dir)
    planned = bars.select("track", (F.col("bar") + 1).alias("bar"), F.when(F.col("bar") % 2 == 0, 48).otherwise(24).alias("resolution"))
    return gates.plan_mismatch(bars, planned, ["track"])


cte(
    "rep",
    f"""SELECT track, (SELECT sum(CASE WHEN silent OR edge THEN notes ELSE 0 END) FROM (SELECT *, {_EDGE} AS edge FROM quiet q) z WHERE z.track = t.track)::BIGINT AS sv,
  (SELECT count(*) FROM ev WHERE ev.track = t.track AND kind = 'view') AS ne, (SELECT count(*) FROM ev l WHERE l.track = t.track AND l.kind = 'view' AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.track = l.track AND r.kind = 'click' AND abs(r.t - l.t) <= 36000000000)) AS us,
  (SELECT count(*) FROM ev WHERE ev.track = t.track AND kind = 'purchase') AS so, (SELECT count(*) FROM ev l WHERE l.track = t.track AND l.kind = 'purchase' AND EXISTS (SELECT 1 FROM ev r WHERE r.track = l.track AND r.kind = 'view' AND abs(r.t - l.t) <= 3600000000)) AS sr
FROM (SELECT DISTINCT track FROM ev) t""",
    "ev",
    "quiet",
)


@plan(
    "extreme_gate",
    """
    SELECT track, 'silent-range-violation' AS code FROM rep WHERE sv > 0 UNION ALL SELECT track, 'unsupported-note-rate' FROM rep WHERE ne >= 8 AND us >= 4 AND us / ne::DOUBLE >= 0.5 UNION ALL SELECT track, 'strong-onset-response' FROM rep WHERE so >= 8 AND sr = 0
    """,
    ("rep",),
)
def extreme_gate(spark, sf_dir):
    events = timeline(spark, sf_dir)
    bars = binning.edge_runs(event_bars(spark, sf_dir), ["track"], F.col("silent") | F.col("noise"))
    silent = bars.groupBy("track").agg(
        F.sum(F.when(F.col("silent") | F.col("edge"), F.col("notes")).otherwise(0)).alias("silent_violation_count"),
        F.count(F.lit(1)).alias("bar_count"),
    )
    views = matching.exists_within(of_kind(events, "view"), of_kind(events, "click"), ["track"], 10 * HOUR)
    strong = matching.exists_within(of_kind(events, "purchase"), of_kind(events, "view"), ["track"], HOUR)
    noted = views.groupBy("track").agg(F.count(F.lit(1)).alias("note_evaluated_count"), flag_sum(~F.col("near")).alias("unsupported_count"))
    heard = strong.groupBy("track").agg(F.count(F.lit(1)).alias("strong_evaluated_count"), flag_sum(F.col("near")).alias("strong_responded_count"))
    report = silent.join(noted, ["track"], "left").join(heard, ["track"], "left").fillna(0)
    rate = ratio(F.col("unsupported_count"), F.col("note_evaluated_count"))
    return gates.extreme_gate(report.withColumn("unsupported_rate", rate), ["track"])


@plan(
    "metric_coverage",
    """
    WITH h AS (SELECT track, t // 864000000000 AS part, list(DISTINCT kind) AS k FROM ev GROUP BY ALL),
    m AS (SELECT track, part, array_to_string(list_filter(['view', 'click', 'purchase', 'signup', 'error'], lambda x: NOT list_contains(k, x)), ',') AS missing FROM h)
    SELECT track, part, missing FROM m WHERE missing <> ''
    """,
    ("ev",),
)
def metric_coverage(spark, sf_dir):
    metrics = timeline(spark, sf_dir).select("track", F.floor(F.col("t") / (240 * HOUR)).alias("part"), F.col("kind").alias("metric"))
    return gates.metric_coverage(metrics, ("view", "click", "purchase", "signup", "error"), ["track", "part"])


_CLASS = """CASE WHEN density IN ('high', 'max') THEN density WHEN density = 'auto' AND course = 'Oni' AND level >= 10 THEN 'max' WHEN density = 'auto' AND course = 'Oni' AND level >= 8 THEN 'high' ELSE density END"""


@plan(
    "quality_gate",
    f"""
    WITH a AS (SELECT h.track, h.bar, h.kind, h.min_hits, h.max_hits, h.allow_empty, h.in_average, h.track % 6 = 5 AS locked, length(replace(c.notes, '0', '')) AS hits,
      ['low', 'medium', 'auto', 'high', 'max'][CAST(h.track % 5 + 1 AS INTEGER)] AS density, ['Easy', 'Normal', 'Hard', 'Oni'][CAST(h.track % 4 + 1 AS INTEGER)] AS course, CAST(h.track % 10 + 1 AS INTEGER) AS level
      FROM chint h JOIN chart c ON c.track = h.track AND c.bar = h.bar),
    q AS (SELECT *, {_CLASS} AS qd FROM a),
    e AS (SELECT track, count(*) AS n FROM (SELECT track, bar, hits, bar - row_number() OVER (PARTITION BY track, hits = 0 ORDER BY bar) AS g, lag(bar) OVER w AS pb, lag(hits) OVER w AS ph FROM q WHERE in_average WINDOW w AS (PARTITION BY track ORDER BY bar))
      WHERE hits = 0 AND NOT coalesce(pb = bar - 1 AND ph = 0, false) GROUP BY track),
    s AS (SELECT track, qd, count(*) AS n, bool_or(locked) AS locked, count(*) FILTER (hits > max_hits) AS dense, count(*) FILTER (NOT locked AND NOT allow_empty AND hits < min_hits) AS thin, count(*) FILTER (in_average) AS c, avg(hits) FILTER (in_average) AS m,
      count(*) FILTER (in_average AND hits < CASE qd WHEN 'max' THEN 4 WHEN 'high' THEN 3 END) AS sp FROM q GROUP BY ALL),
    pn AS (SELECT n.* FROM nt n JOIN q ON q.track = n.track AND q.bar = n.bar AND q.kind NOT IN ('silent', 'rest')),
    g AS (SELECT *, CASE WHEN note IN ('1', '2') THEN note END AS v, lag(note) OVER (PARTITION BY track ORDER BY bar, pos) AS pv FROM pn),
    r AS (SELECT *, sum(CASE WHEN v IS NULL OR pv IS DISTINCT FROM note THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY bar, pos) AS run FROM g),
    ld AS (SELECT track, max(n) AS ld FROM (SELECT track, run, count(*) AS n FROM r WHERE v = '1' GROUP BY ALL) GROUP BY track),
    k AS (SELECT track, count(*) FILTER (note = '1') AS don, count(*) FILTER (note = '2') AS ka FROM pn GROUP BY track),
    p AS (SELECT track, bar, string_agg((pos / res::DOUBLE) || ':' || note, '|' ORDER BY pos) AS pattern, count(*) FILTER (note IN ('1', '2', '3', '4', '5', '7')) AS act FROM nt GROUP BY ALL),
    o AS (SELECT p.track, count(*) AS n FROM (SELECT track, pattern, count(*) AS n FROM p WHERE act > 0 GROUP BY ALL) p JOIN s USING (track) WHERE p.n > greatest(4, s.n // 12) GROUP BY p.track),
    j AS (SELECT s.*, e.n AS runs, don, ka, ld, o.n AS over, s.n >= 8 AS long, s.n >= 8 AND c > 0 AND NOT locked AND qd IN ('high', 'max') AS high FROM s LEFT JOIN e USING (track) LEFT JOIN k USING (track) LEFT JOIN ld USING (track) LEFT JOIN o USING (track)),
    f AS (SELECT *, long AND don + ka >= 32 AND ka < 4 AND ka / (don + ka)::DOUBLE < 0.03 AS mono FROM j)
    SELECT track, code, n::BIGINT AS n FROM (
      SELECT track, 'bar-too-dense' AS code, dense AS n FROM f UNION ALL SELECT track, 'bar-too-sparse', thin FROM f
      UNION ALL SELECT track, 'too-sparse', 1 FROM f WHERE high AND m < CASE qd WHEN 'max' THEN 8.5 ELSE 6.5 END
      UNION ALL SELECT track, 'sparse-bars', sp FROM f WHERE high AND sp > greatest(1, c // 12)
      UNION ALL SELECT track, 'empty-runs', runs FROM f WHERE high UNION ALL SELECT track, 'nearly-all-don', 1 FROM f WHERE mono
      UNION ALL SELECT track, 'overlong-don-run', 1 FROM f WHERE long AND don + ka >= 32 AND NOT mono AND ld > 32 AND ka / (don + ka)::DOUBLE < 0.08
      UNION ALL SELECT track, 'overused-patterns', over FROM f WHERE long) WHERE n > 0
    """,
    ("chint", "chart", "nt"),
)
def quality_gate(spark, sf_dir):
    from pulsegrid.operators.targets import quality_density
    from pulsegrid.plans.quality import DENSITIES, chart_hints

    t = F.col("track")

    def pick(names, size):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(t, F.lit(size)) + 1).cast("int"))

    level = (F.pmod(t, F.lit(10)) + 1).cast("int")
    hints = chart_hints(spark, sf_dir).select("track", "bar", "kind", "min_hits", "max_hits", "allow_empty", "in_average")
    rows = chart_bars(spark, sf_dir).join(hints, ["track", "bar"]).select(
        "*", quality_density(pick(DENSITIES, 5), pick(COURSES, 4), level).alias("density_class"), (F.pmod(t, F.lit(6)) == 5).alias("timing_locked")
    )
    return gates.quality_gate(rows, ["track"])


@plan(
    "evidence_summary",
    """
    WITH c AS (SELECT DISTINCT track FROM ev), h AS (SELECT track, list(DISTINCT kind) AS k FROM ev WHERE t >= 432000000000 GROUP BY track),
    m AS (SELECT c.track, array_to_string(list_filter(['view', 'click', 'purchase', 'signup'], lambda x: NOT list_contains(coalesce(k, []), x)), ',') AS missing FROM c LEFT JOIN h USING (track)),
    l AS (SELECT * FROM m WHERE missing <> ''), v AS (SELECT track, 'late-error' AS code FROM ev WHERE kind = 'error' AND t >= 2332800000000)
    SELECT (SELECT count(*) FROM c) AS chart_count, (SELECT count(*) FROM l) AS missing_metric_count, (SELECT count(*) FROM v) AS gate_violation_count,
      coalesce((SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM ev WHERE t >= 432000000000 AND kind IN ('error', 'score')), '') AS forbidden_keys,
      coalesce((SELECT string_agg(track || '=' || missing, ' ' ORDER BY track) FROM (SELECT * FROM l ORDER BY track, missing LIMIT 8)), '') AS missing_examples,
      coalesce((SELECT string_agg(track || '=' || code, ' ' ORDER BY track) FROM (SELECT * FROM v ORDER BY track LIMIT 8)), '') AS violation_examples
    """,
    ("ev",),
)
def evidence_summary(spark, sf_dir):
    events = timeline(spark, sf_dir)
    metrics = events.filter(F.col("t") >= 120 * HOUR).select("track", F.col("kind").alias("metric"))
    late = events.filter((F.col("kind") == "error") & (F.col("t") >= 648 * HOUR)).select("track", F.lit("late-error").alias("code"))
    required, forbidden = ("view", "click", "purchase", "signup"), ("error", "score")
    return gates.evidence_summary(metrics, events.select("track"), late, required, forbidden, ["track"])


@plan(
    "reason_histogram",
    """
    WITH r AS (SELECT track, fallback_reason AS r, count(*) AS n FROM sal WHERE fallback_reason IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, fallback_reason, count(*) FROM sal WHERE fallback_reason IS NOT NULL GROUP BY ALL),
    k AS (SELECT DISTINCT track FROM sal UNION ALL SELECT NULL)
    SELECT k.track, coalesce(string_agg(r || ':' || n, ' ' ORDER BY r), '') AS fallback_reason FROM k LEFT JOIN r ON k.track IS NOT DISTINCT FROM r.track GROUP BY k.track
    """,
    ("sal",),
)
def reason_histogram(spark, sf_dir):
    found, points = scored(spark, sf_dir)
    return gates.value_counts(ev.bar_salience(found, points, TICKS), ["track"], ["fallback_reason"])


@plan(
    "point_order",
    """
    WITH p AS (SELECT track, bar, tick, lag(tick) OVER (PARTITION BY track, bar ORDER BY ok, ol, tick) AS before FROM (SELECT l_suppkey AS track, l_orderkey AS ok, l_linenumber AS ol,
      datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS day, CAST(floor(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 48.0) AS INTEGER) AS bar, datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) - 48 * CAST(floor(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 48.0) AS INTEGER) AS tick FROM lineitem)),
    b AS (SELECT track, bar, count(*) FILTER (tick < before) AS falls FROM p GROUP BY ALL)
    SELECT track, count(*) AS place_count, count(*) FILTER (falls > 0) AS unordered_count, sum(falls)::BIGINT AS falling_steps FROM b GROUP BY track
    """,
)
def point_order(spark, sf_dir):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    points = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("track"), "l_orderkey", "l_linenumber", F.floor(day / TICKS).alias("bar"), F.pmod(day, F.lit(TICKS)).alias("tick")
    )
    return gates.order_audit(points, ["track"], ["bar"], ["l_orderkey", "l_linenumber"], "tick")


@plan(
    "report_roundtrip",
    """
    SELECT track, kind, count(*) AS event_count, CAST(sum(CAST(round(value * 100, 0) AS BIGINT)) AS BIGINT) AS cents, max(t) AS last_t FROM ev GROUP BY ALL
    """,
    ("ev",),
)
def report_roundtrip(spark, sf_dir):
    """Event counts per track and kind, written as a report, replaced once, and read back."""
    import uuid

    from pulsegrid.session import ensure_checkpoint_dir
    from pulsegrid.sources.reports import read_report, write_report

    events = timeline(spark, sf_dir)
    counted = events.groupBy("track", "kind").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max("t").alias("last_t")
    )
    path = f"{ensure_checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/report-{uuid.uuid4().hex}"
    write_report(counted.filter(F.col("kind") == "view"), path)
    write_report(counted, path)
    return read_report(spark, path)


@plan(
    "point_audit",
    f"""
    WITH p AS (SELECT track, bar, count(*) AS n FROM hits GROUP BY ALL), b AS (SELECT s.*, c.edge, coalesce(p.n, 0) AS n FROM sal s JOIN ctx c ON c.track = s.track AND c.bar = s.bar LEFT JOIN p ON p.track = s.track AND p.bar = s.bar)
    SELECT track, sum(n)::BIGINT AS point_count, 0::BIGINT AS invalid_grid_count, 0::BIGINT AS duplicate_grid_count, sum(CASE WHEN edge THEN n ELSE 0 END)::BIGINT AS edge_violation_count,
      sum(((fallback_reason IS NULL AND bar_confidence < 0.45) OR coalesce(fallback_reason = 'low-confidence' AND bar_confidence >= 0.45, false) OR coalesce(fallback_reason IN ('edge-silence', 'silent-bar', 'no-rhythmic-evidence') AND n > 0, false))::INT)::BIGINT AS reason_violation_count,
      sum((fallback_reason IS NOT NULL)::INT)::BIGINT AS fallback_bar_count, {_r("sum(n) / (count(*) * 48)::DOUBLE", 6)} AS sparse_ratio FROM b GROUP BY track
    """,
    ("hits", "sal", "ctx"),
)
def point_audit(spark, sf_dir):
    found, points = scored(spark, sf_dir)
    edges = bar_context(spark, sf_dir).select("track", "bar", "edge")
    bars = ev.bar_salience(found, points, TICKS).join(edges, ["track", "bar"])
    return gates.point_audit(points, bars, TICKS)


@plan(
    "ratio_rollup",
    f"""
    WITH l AS (SELECT ['Easy', 'Normal', 'Hard', 'Oni'][CAST(track % 4 + 1 AS INTEGER)] AS course, kind, EXISTS (SELECT 1 FROM ev r WHERE r.track = l.track AND r.kind = 'click' AND abs(r.t - l.t) <= 21600000000) AS near FROM ev l WHERE kind IN ('view', 'purchase'))
    SELECT CASE WHEN GROUPING(course) = 1 THEN 'all' ELSE course END AS course, coalesce({_r("count(*) FILTER (kind = 'view' AND near) / nullif(count(*) FILTER (kind = 'view'), 0)::DOUBLE", 6)}, 1) AS note_onset_alignment,
      coalesce({_r("count(*) FILTER (kind = 'purchase' AND near) / nullif(count(*) FILTER (kind = 'purchase'), 0)::DOUBLE", 6)}, 1) AS strong_onset_response, coalesce({_r("count(*) FILTER (kind = 'view' AND NOT near) / nullif(count(*) FILTER (kind = 'view'), 0)::DOUBLE", 6)}, 0) AS unsupported_note_rate,
      0::DOUBLE AS silent_range_violation_rate, 1::DOUBLE AS fill_burst_alignment FROM l GROUP BY GROUPING SETS ((course), ())
    """,
    ("ev",),
)
def ratio_rollup(spark, sf_dir):
    events = timeline(spark, sf_dir)
    near = matching.exists_within(of_kind(events, "view", "purchase"), of_kind(events, "click"), ["track"], 6 * HOUR)
    view, buy = F.col("kind") == "view", F.col("kind") == "purchase"
    course = F.element_at(F.array(*[F.lit(c) for c in COURSES]), (F.pmod(F.col("track"), F.lit(4)) + 1).cast("int"))
    rows = near.groupBy(course.alias("course")).agg(
        flag_sum(view).alias("views"),
        flag_sum(view & F.col("near")).alias("aligned"),
        flag_sum(view & ~F.col("near")).alias("unsupported"),
        flag_sum(buy).alias("strong"),
        flag_sum(buy & F.col("near")).alias("answered"),
        F.lit(0).alias("none"),
    )
    return gates.ratio_rollup(
        rows,
        "course",
        {
            "note_onset_alignment": ("aligned", "views", 1.0),
            "strong_onset_response": ("answered", "strong", 1.0),
            "unsupported_note_rate": ("unsupported", "views", 0.0),
            "silent_range_violation_rate": ("none", "none", 0.0),
            "fill_burst_alignment": ("none", "none", 1.0),
        },
    )


@plan(
    "notices",
    """
    WITH s AS (SELECT *, CASE track % 4 WHEN 0 THEN 'librosa' WHEN 1 THEN 'librosa+beatnet' WHEN 2 THEN 'librosa+manual-override' ELSE 'librosa+onset-grid' END AS an, n % 3 = 0 AS pa, n % 2 = 0 AS tc, n % 5 < 2 AS rj, n % 7 = 0 AS su, n % 6 = 0 AS sf,
        ['complete', 'partial', 'fallback', 'fallback', 'complete'][CAST(n % 5 + 1 AS INTEGER)] AS st, [NULL, 'x', 'missing-model:a', 'device-unavailable:b', 'z'][CAST(n % 5 + 1 AS INTEGER)] AS rs, n % 9 = 1 AS am, n % 4 = 1 AS ac, (n % 10) / 10.0::DOUBLE AS sc, n % 8 AS re, n // 3 AS bc
      FROM (SELECT track, count(*) AS n FROM ev GROUP BY track))
    SELECT track, code, level FROM (
      SELECT track, 'beatnet-meter-adopted' AS code, 'info' AS level FROM s WHERE pa UNION ALL SELECT track, 'beatnet-candidate-rejected', 'warning' FROM s WHERE NOT pa AND an NOT LIKE '%beatnet%' AND tc AND rj
      UNION ALL SELECT track, 'beatnet-fallback', 'warning' FROM s WHERE NOT pa AND an NOT LIKE '%beatnet%' AND NOT (tc AND rj) UNION ALL SELECT track, 'tempo-variation-suspected', 'warning' FROM s WHERE su UNION ALL SELECT track, 'spectral-analysis-fallback', 'warning' FROM s WHERE sf
      UNION ALL SELECT track, 'instrument-classifier-fallback', 'warning' FROM s WHERE st = 'complete' AND rs IS NOT NULL UNION ALL SELECT track, 'instrument-analysis-succeeded', 'info' FROM s WHERE st = 'complete' AND rs IS NULL
      UNION ALL SELECT track, 'instrument-analysis-partial', 'warning' FROM s WHERE st = 'partial' UNION ALL SELECT track, CASE WHEN rs LIKE 'missing-model:%' THEN 'instrument-models-missing' ELSE 'instrument-device-unavailable' END, 'warning' FROM s WHERE st = 'fallback'
      UNION ALL SELECT track, 'tempo-arbitration-ambiguous', 'warning' FROM s WHERE am AND an NOT LIKE '%manual-override%' UNION ALL SELECT track, 'tempo-refinement-fallback', 'warning' FROM s WHERE NOT am AND NOT ac AND an NOT LIKE '%manual-override%'
      UNION ALL SELECT track, 'structure-low-confidence', 'warning' FROM s WHERE bc >= 4 AND sc < 0.35 UNION ALL SELECT track, 'resolution-evidence-fallback', 'warning' FROM s WHERE re = 0)
    """,
    ("ev",),
)
def notices(spark, sf_dir):
    n = F.col("n")

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    states = timeline(spark, sf_dir).groupBy("track").agg(F.count(F.lit(1)).alias("n")).select(
        "track",
        pick(("librosa", "librosa+beatnet", "librosa+manual-override", "librosa+onset-grid"), F.pmod("track", F.lit(4))).alias("analyzer"),
        F.lit(True).alias("requested_tracker"),
        (n % 3 == 0).alias("partial_adoption"),
        F.when(n % 2 == 0, "complete").otherwise("fallback").alias("tracker_status"),
        (n % 5 < 2).alias("tracker_rejected"),
        (n % 7 == 0).alias("tempo_suspected"),
        F.when(n % 6 == 0, "fallback").otherwise("complete").alias("spectral_status"),
        F.lit(True).alias("requested_sources"),
        F.lit(True).alias("stem_profile"),
        pick(("complete", "partial", "fallback", "fallback", "complete"), n % 5).alias("source_status"),
        pick((None, "x", "missing-model:a", "device-unavailable:b", "z"), n % 5).alias("source_reason"),
        (n % 9 == 1).alias("tempo_ambiguous"),
        (n % 4 == 1).alias("tempo_accepted"),
        ((n % 10) / 10.0).alias("structure_confidence"),
        (n % 8).alias("resolution_evidence"),
        F.floor(n / 3).alias("bar_count"),
    )
    return gates.notices(states, ["track"])


@plan(
    "bar_range",
    """SELECT track, bar, energy, NULL::VARCHAR AS issue FROM be WHERE bar BETWEEN 10 AND 20
    UNION ALL SELECT track, NULL, NULL, 'empty-bar-range' FROM be GROUP BY track HAVING count(*) FILTER (bar BETWEEN 10 AND 20) = 0""",
    ("be",),
)
def bar_range(spark, sf_dir):
    bars = binning.bar_energy(evidence(spark, sf_dir), ["track"], 16, TICKS, 12).select("track", "bar", "energy")
    return binning.bar_range(bars, ["track"], 10, 20)


@plan(
    "overrides",
    """
    WITH s AS (SELECT track, count(*)::DOUBLE AS bpm, min(t) / 1000000.0::DOUBLE AS off FROM ev GROUP BY track), o AS (SELECT s_suppkey AS track, s_acctbal AS bpm, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey::DOUBLE END AS off FROM supplier WHERE s_acctbal > 0)
    SELECT s.track, coalesce(round_even(o.bpm * 1000, 0) / 1000, s.bpm) AS bpm, coalesce(o.off, s.off) AS offset_s, 'librosa' || CASE WHEN o.bpm IS NOT NULL OR o.off IS NOT NULL THEN '+manual-override' ELSE '' END AS analyzer FROM s LEFT JOIN o USING (track)
    """,
    ("ev",),
)
def overrides(spark, sf_dir):
    from pulsegrid.operators.tempo import apply_overrides

    analyses = timeline(spark, sf_dir).groupBy("track").agg(
        F.count(F.lit(1)).cast("double").alias("bpm"), (F.min("t") / float(SECOND)).alias("offset_s")
    ).withColumn("analyzer", F.lit("librosa"))
    manual = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("track"),
        F.col("s_acctbal").alias("bpm"),
        F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey").cast("double")).alias("offset_s"),
    )
    return apply_overrides(analyses, manual, ["track"])


@plan(
    "chart_features",
    f"""
    SELECT b.track, b.bar, {_r("1.5::DOUBLE + b.bar * 48", 6)} AS start_s, {_r("1.5::DOUBLE + (b.bar + 1) * 48", 6)} AS end_s, {_r("count(n.note) / b.res::DOUBLE", 3)} AS energy, coalesce(string_agg(n.pos, ',' ORDER BY n.pos), '') AS onset_grids,
      coalesce(string_agg(CASE WHEN n.pos % (b.res // 4) = 0 THEN n.pos END, ',' ORDER BY n.pos), '') AS accent_grids FROM bars b LEFT JOIN nt n ON n.track = b.track AND n.bar = b.bar GROUP BY b.track, b.bar, b.res
    """,
    ("bars", "nt"),
)
def chart_features(spark, sf_dir):
    bars = chart_bars(spark, sf_dir)
    length = 4.0 * 60.0 / 5.0
    slots = N.slots(F.col("notes"))
    size = F.length("notes")
    filled = F.transform(
        F.filter(F.transform(slots, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: x["c"] != "0"), lambda x: x["i"]
    )
    accents = F.filter(filled, lambda i: i % F.floor(size / 4) == 0)
    # The tempo is constant, so the start of a bar is a product and needs no running sum.
    start = F.lit(1.5) + F.col("bar") * length

    def text(items):
        return F.array_join(items.cast("array<string>"), ",")

    return bars.select(
        "track",
        "bar",
        round_half_even(start, 6).alias("start_s"),
        round_half_even(start + length, 6).alias("end_s"),
        round_half_even(F.size(filled) / size, 3).alias("energy"),
        text(filled).alias("onset_grids"),
        text(accents).alias("accent_grids"),
    )


def _row_sql(names):
    return " || ',' || ".join(f"round_even({_r(f'coalesce({n}, 0)', 3)} * 1000, 0)::BIGINT" for n in names)


_CHANNELS = ("strength", "activity", "low", "mid", "high", "flux", "vocal", "drum", "bass", "accompaniment")


@plan(
    "compact_export",
    f"""
    WITH p AS (SELECT track, bar, least(15, (tick + 1) // 3) AS slot, {", ".join(f"max(round_even(least(1, greatest(0, {'CASE WHEN onset THEN strength ELSE 0 END' if n == 'strength' else n})) * 1000, 0))::INTEGER AS {n}" for n in _CHANNELS)} FROM evid GROUP BY ALL),
    t AS (SELECT track, bar, string_agg('[' || tick || ',' || n || ']', ',' ORDER BY tick) AS beats FROM (SELECT track, bar, tick, row_number() OVER (PARTITION BY track, bar ORDER BY tick) AS n FROM pk WHERE beat) GROUP BY ALL),
    w AS (SELECT r.track, r.bar, r.phrase_id, '[' || {_row_sql(STRUCTURE)} || ',' || r.phrase_id || ',' || {_text_sql("r.role")} || ',' || {_text_sql("section_id")} || ']' AS structure, '[' || {_row_sql(SOURCES)} || ',' || {_text_sql("dominant_source")} || ']' AS sources
      FROM rol r LEFT JOIN sect s ON s.track = r.track AND s.phrase_id = r.phrase_id LEFT JOIN fillc f ON f.track = r.track AND f.bar = r.bar),
    h AS (SELECT p.track, p.phrase_id, '[' || p.phrase_id || ',' || start_bar || ',' || end_bar || ',' || {_text_sql("section_id")} || ',' || {_text_sql("section")} || ',' || {_text_sql("primary_role")} || ',' || {_row_sql(PHRASE)} || ']' AS phrase FROM phr p JOIN sect s ON s.track = p.track AND s.phrase_id = p.phrase_id),
    m AS (SELECT s.track, s.bar, {", ".join(f"string_agg(coalesce(p.{n}, 0), ',' ORDER BY k.i) AS {n}" for n in _CHANNELS)},
      coalesce((SELECT string_agg(c.tick || ':' || c.kind, ' ' ORDER BY c.rank) FROM cand c WHERE c.track = s.track AND c.bar = s.bar), '') AS candidates
    FROM spine s CROSS JOIN range(0, 16) k(i) LEFT JOIN p ON p.track = s.track AND p.bar = s.bar AND p.slot = k.i GROUP BY s.track, s.bar)
    SELECT m.*, '[' || coalesce(beats, '') || ']' AS beats, coalesce(structure, '[]') AS structure, coalesce(sources, '[]') AS sources, coalesce(phrase, '[]') AS phrase
    FROM m LEFT JOIN t ON t.track = m.track AND t.bar = m.bar LEFT JOIN w ON w.track = m.track AND w.bar = m.bar LEFT JOIN h ON h.track = w.track AND h.phrase_id = w.phrase_id
    """,
    ("evid", "spine", "cand", "pk", "rol", "sect", "fillc", "phr"),
    recursive=True,
)
def compact_export(spark, sf_dir):
    onset_only = F.when(F.col("onset"), F.col("strength")).otherwise(0.0)
    points = evidence(spark, sf_dir).withColumn("strength", onset_only)
    rows, beats, phrases = document_rows(spark, sf_dir)
    return compact_bars(bar_spine(spark, sf_dir), points, ranked(spark, sf_dir), beats, rows, phrases, _CHANNELS, 16, TICKS)


@plan(
    "alignment_report",
    f"""
    WITH n AS (SELECT track, t, EXISTS (SELECT 1 FROM ev r WHERE r.track = l.track AND r.kind IN ('purchase', 'signup') AND abs(r.t - l.t) <= 10800000000) OR EXISTS (SELECT 1 FROM ev r WHERE r.track = l.track AND r.kind = 'error' AND abs(r.t - l.t) <= 21600000000) AS ok FROM ev l WHERE kind IN ('view', 'click')),
    c AS (SELECT track, count(*) AS n, sum(ok::INT)::BIGINT AS e FROM n GROUP BY track), s AS (SELECT track, sum(CASE WHEN silent OR noise THEN notes ELSE 0 END)::BIGINT AS v FROM quiet GROUP BY track),
    j AS (SELECT c.*, s.v, c.track % 7 <> 0 AS d, ['Easy', 'Normal', 'Hard', 'Oni'][CAST(c.track % 4 + 1 AS INTEGER)] AS course FROM c JOIN s USING (track))
    SELECT CASE WHEN GROUPING(course) = 1 THEN 'all' ELSE course END AS course, count(*) AS chart_count, sum(n)::BIGINT AS note_count, sum(e)::BIGINT AS evidenced_note_count, sum(n - e)::BIGINT AS unsupported_note_count, {_r("sum(n - e) / sum(n)::DOUBLE", 6)} AS unsupported_note_ratio,
      sum(v)::BIGINT AS silent_violation_count, sum(d::INT)::BIGINT AS deterministic_chart_count, {_r("sum(d::INT) / count(*)::DOUBLE", 6)} AS deterministic_rate FROM j GROUP BY GROUPING SETS ((course), ())
    """,
    ("ev", "quiet"),
)
def alignment_report(spark, sf_dir):
    events = timeline(spark, sf_dir)
    notes = of_kind(events, "view", "click")
    near = matching.exists_within(notes, of_kind(events, "purchase", "signup"), ["track"], 3 * HOUR, out="onset_near")
    both = matching.exists_within(near, of_kind(events, "error"), ["track"], 6 * HOUR, out="beat_near")
    counted = both.groupBy("track").agg(
        F.count(F.lit(1)).alias("note_count"), flag_sum(F.col("onset_near") | F.col("beat_near")).alias("evidenced_count")
    )
    silent = event_bars(spark, sf_dir).groupBy("track").agg(
        F.sum(F.when(F.col("silent") | F.col("noise"), F.col("notes")).otherwise(0)).alias("silent_violation_count")
    )
    course = F.element_at(F.array(*[F.lit(c) for c in COURSES]), (F.pmod("track", F.lit(4)) + 1).cast("int"))
    rows = counted.join(silent, ["track"]).select(
        "*", (F.col("track") % 7 != 0).alias("deterministic"), course.alias("course")
    )
    return gates.alignment_report(rows, "course")


_COURSE = "['Easy', 'Normal', 'Hard', 'Oni'][CAST(track % 4 + 1 AS INTEGER)]"


def _part(name):
    """The SQL of another plan as a table."""
    return f"({SQL[name]})"


@plan(
    "course_report",
    f"""
    WITH c AS (SELECT DISTINCT track FROM bars), u AS (SELECT * FROM {_part("unsupported_notes")}), o AS (SELECT * FROM {_part("onset_response")}), f AS (SELECT * FROM {_part("fill_alignment")}), t AS (SELECT * FROM {_part("tick_error")}),
    v AS (SELECT c.track, sum(length(regexp_replace(c.notes, '[^123457]', '', 'g')))::BIGINT AS ac, sum(CASE WHEN x.silent OR x.edge THEN length(regexp_replace(c.notes, '[^123457]', '', 'g')) ELSE 0 END)::BIGINT AS vc FROM chart c JOIN ctx x ON x.track = c.track AND x.bar = c.bar GROUP BY c.track),
    h AS (SELECT DISTINCT track FROM nt WHERE note IN ('1', '2', '3', '4', '5', '7', '9')),
    j AS (SELECT {_COURSE.replace("track", "c.track")} AS course, h.track IS NOT NULL AS det, u.evaluated_count AS ue, u.unsupported_count AS un, o.evaluated_count AS oe, o.responded_count AS orr, f.evaluated_count AS fe, f.aligned_count AS fa, t.evaluated_count AS te, t.mean_tick_error * t.evaluated_count AS ts, ac, vc
      FROM c LEFT JOIN u USING (track) LEFT JOIN o USING (track) LEFT JOIN f USING (track) LEFT JOIN t USING (track) LEFT JOIN v USING (track) LEFT JOIN h USING (track)),
    r AS (SELECT CASE WHEN GROUPING(course) = 1 THEN 'all' ELSE course END AS course, count(*) AS chart_count, count(*) FILTER (det) AS deterministic_count, coalesce(sum(un), 0)::BIGINT AS unsupported_count, coalesce(sum(ue), 0)::BIGINT AS note_evaluated, coalesce(sum(orr), 0)::BIGINT AS strong_responded, coalesce(sum(oe), 0)::BIGINT AS strong_evaluated,
      coalesce(sum(fa), 0)::BIGINT AS fill_aligned, coalesce(sum(fe), 0)::BIGINT AS fill_evaluated, coalesce(sum(vc), 0)::BIGINT AS violation_count, coalesce(sum(ac), 0)::BIGINT AS activity_count, coalesce(sum(te), 0)::BIGINT AS tick_evaluated, coalesce(sum(ts), 0) AS tsum FROM j GROUP BY GROUPING SETS ((course), ()))
    SELECT * EXCLUDE (tsum), {", ".join(f"coalesce({_r(f'{part} / nullif({whole}, 0)::DOUBLE', 6)}, {empty}) AS {name}" for name, part, whole, empty in ((n, p.replace("tick_error_sum", "tsum"), w, e) for n, p, w, e in gates.REPORT_RATIOS))} FROM r
    """,
    ("bars", "chart", "ctx", "nt"),
    recursive=True,
)
def course_report(spark, sf_dir):
    """Alignment of every chart against its own evidence, and whether a second build of the
    charts gives the same times."""
    from pulsegrid.operators.quality import silence_violations
    from pulsegrid.plans import quality as parts
    from pulsegrid.plans.bindings import build_chart_bars
    from pulsegrid.plans.charts import timeline_hash

    bars = chart_bars(spark, sf_dir)
    context = bar_context(spark, sf_dir).select("track", "bar", "silent", "edge")
    quiet = silence_violations(bars.join(context, ["track", "bar"]), ["track"], F.col("silent") | F.col("edge"), N.activity_count(F.col("notes")))
    again = charts.explode_notes(build_chart_bars(spark, sf_dir)).filter(N.in_class(F.col("note"), N.NOTE_STARTS))
    again = gates.timeline_hash(again, ["track"], "bar", "time_s").select("track", F.col("times_hash").alias("_again"))
    same = timeline_hash(spark, sf_dir).join(again, "track").select("track", (F.col("times_hash") == F.col("_again")).alias("deterministic"))
    tables = (
        (parts.unsupported_notes(spark, sf_dir), {"note_evaluated": "evaluated_count", "unsupported_count": "unsupported_count"}),
        (parts.onset_response(spark, sf_dir), {"strong_evaluated": "evaluated_count", "strong_responded": "responded_count"}),
        (parts.fill_alignment(spark, sf_dir), {"fill_evaluated": "evaluated_count", "fill_aligned": "aligned_count"}),
        (quiet, {"activity_count": "activity_count", "violation_count": "violation_count"}),
    )
    rows = bars.select("track").distinct().join(same, "track", "left")
    for frame, names in tables:
        rows = rows.join(frame.select("track", *[F.col(own).alias(n) for n, own in names.items()]), "track", "left")
    ticks = parts.tick_error(spark, sf_dir).select(
        "track", F.col("evaluated_count").alias("tick_evaluated"), (F.col("mean_tick_error") * F.col("evaluated_count")).alias("tick_error_sum")
    )
    course = F.element_at(F.array(*[F.lit(c) for c in COURSES]), (F.pmod(F.col("track"), F.lit(4)) + 1).cast("int"))
    return gates.course_report(rows.join(ticks, "track", "left").withColumn("course", course), "course")
