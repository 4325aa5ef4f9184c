"""Gates and comparisons: metric tables, determinism, hashes, monotonic order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import notes as N
from pulsegrid.functions.numeric import flag_sum, ratio
from pulsegrid.operators.charts import color_balance, explode_notes, pattern_repeat, true_runs


def timeline_hash(notes: DataFrame, keys: Sequence[str], bar: str, time: str) -> DataFrame:
    """First 16 hex digits of the SHA-256 of a chart's ordered times at nine digits.

    Times are joined per bar before the shuffle by chart, so only one string per bar of a
    chart comes together.
    """
    text = F.transform(F.array_sort(F.collect_list(time)), lambda t: F.format_string("%.9f", t))
    per_bar = notes.groupBy(*keys, bar).agg(F.array_join(text, ",").alias("_text"), F.count(F.lit(1)).alias("_n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(bar, "_text"))), lambda x: x["_text"])
    return per_bar.groupBy(*keys).agg(
        F.sum("_n").alias("note_count"),
        F.substring(F.sha2(F.array_join(ordered, ","), 256), 1, 16).alias("times_hash"),
    )


def metric_gate(baseline: DataFrame, current: DataFrame, rules: DataFrame) -> DataFrame:
    """Baseline against current metrics by name with the rule of each metric.

    Rules: ``above``, ``below``, ``at_least``, ``at_most``, ``equal`` against the baseline;
    ``minimum`` and ``maximum`` against a fixed limit. A missing side fails.
    """
    joined = baseline.withColumnRenamed("value", "baseline").join(
        current.withColumnRenamed("value", "current"), "metric", "full"
    )
    b, c, rule = F.col("baseline"), F.col("current"), F.col("rule")
    passed = (
        F.when(rule == "above", c > b)
        .when(rule == "below", c < b)
        .when(rule == "at_least", c >= b)
        .when(rule == "at_most", c <= b)
        .when(rule == "equal", c == b)
        .when(rule == "minimum", c >= F.col("threshold"))
        .when(rule == "maximum", c <= F.col("threshold"))
    )
    delta = F.rint((c - b) * 1e6) / 1e6
    return rules.join(joined, "metric", "left").select(
        "metric", "rule", "baseline", "current", delta.alias("delta"), F.coalesce(passed, F.lit(False)).alias("passed")
    )


def determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two result sets hold the same rows, copies included; one row."""
    names = first.columns
    both = first.withColumn("_d", F.lit(1)).unionByName(second.select(*names).withColumn("_d", F.lit(-1)))
    balance = both.groupBy(*names).agg(
        F.sum("_d").alias("_b"),
        F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).alias("_f"),
        F.sum(F.when(F.col("_d") < 0, 1).otherwise(0)).alias("_s"),
    )
    return balance.agg(
        F.coalesce(F.sum("_f"), F.lit(0)).alias("first_rows"),
        F.coalesce(F.sum("_s"), F.lit(0)).alias("second_rows"),
        F.coalesce(F.sum(F.abs("_b")), F.lit(0)).alias("different_rows"),
        F.coalesce(F.bool_and(F.col("_b") == 0), F.lit(True)).alias("identical"),
    )


def artifact_mismatches(expected: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Artifacts missing from a rebuild, not expected, or with another hash."""
    both = expected.withColumnRenamed("hash", "_e").join(rebuilt.withColumnRenamed("hash", "_r"), "name", "full")
    code = (
        F.when(F.col("_r").isNull(), "missing-rebuild")
        .when(F.col("_e").isNull(), "missing-committed")
        .when(F.col("_e") != F.col("_r"), "content-mismatch")
    )
    return both.select("name", code.alias("code")).filter(F.col("code").isNotNull())


def monotonic_check(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Whether values never fall along a short fixed order, such as the courses of a source."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    stepped = rows.select(*keys, (before.isNull() | (F.col(value) >= before)).alias("_ok"))
    return stepped.groupBy(*keys).agg(F.bool_and("_ok").alias("monotonic"), F.count(F.lit(1)).alias("steps"))


def plan_mismatch(bars: DataFrame, plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bars on one side only, or with another slot count than planned."""
    keys = list(keys)
    have = bars.select(*keys, "bar", F.length("notes").alias("actual"))
    both = have.join(plan.select(*keys, "bar", F.col("resolution").alias("expected")), [*keys, "bar"], "full")
    return both.filter(~F.col("actual").eqNullSafe(F.col("expected")))


def extreme_gate(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Charts that fail an extreme rule: silent activity, unsupported notes, strong onsets ignored."""
    c = F.col
    codes = F.array_compact(
        F.array(
            F.when(c("silent_violation_count") > 0, "silent-range-violation"),
            F.when(
                (c("note_evaluated_count") >= 8) & (c("unsupported_count") >= 4) & (c("unsupported_rate") >= 0.5),
                "unsupported-note-rate",
            ),
            F.when(
                (c("bar_count") >= 4) & (c("strong_evaluated_count") >= 8) & (c("strong_responded_count") == 0),
                "strong-onset-response",
            ),
        )
    )
    return report.select(*keys, F.explode(codes).alias("code"))


def metric_coverage(metrics: DataFrame, required: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Every chart that lacks a required metric, with the missing names."""
    keys = list(keys)
    names = F.array(*[F.lit(r) for r in required])
    have = metrics.groupBy(*keys).agg(F.collect_set(F.when(F.col("metric").isin(*required), F.col("metric"))).alias("_have"))
    return have.select(*keys, F.array_join(F.array_except(names, F.col("_have")), ",").alias("missing")).filter("missing != ''")


def quality_gate(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quality findings of charts: a row for each chart and code, with how many bars, runs or
    patterns it concerns.

    ``bars`` carry notes, density_class, the density hint (kind, min_hits, max_hits,
    allow_empty, in_average) and timing_locked. Hints hold for charts of any length and class:
    a bar may have too many hits, or too few unless the chart's timing is locked. From 8 bars
    on, colours must be mixed over the bars that are played and no pattern may return too
    often; charts of a high class that are not locked must also reach a mean, have few sparse
    bars, and no run of empty ones among the bars that count for the mean.
    """
    keys, c = list(keys), F.col
    rows = bars.withColumn("hits", N.nonrest_count(c("notes")))
    average = F.when(c("density_class") == "max", 8.5).when(c("density_class") == "high", 6.5)
    lowest = F.when(c("density_class") == "max", 4.0).when(c("density_class") == "high", 3.0)
    counted, free = c("in_average"), ~c("timing_locked")
    sums = rows.groupBy(*keys, "density_class").agg(
        F.count(F.lit(1)).alias("_bars"),
        F.bool_or("timing_locked").alias("_locked"),
        flag_sum(c("hits") > c("max_hits")).alias("bar-too-dense"),
        flag_sum(free & ~c("allow_empty") & (c("hits") < c("min_hits"))).alias("bar-too-sparse"),
        flag_sum(counted).alias("_counted"),
        F.avg(F.when(counted, c("hits"))).alias("_mean"),
        flag_sum(F.coalesce(counted & (c("hits") < lowest), F.lit(False))).alias("_sparse"),
    )
    high = average.isNotNull() & (c("_bars") >= 8) & (c("_counted") > 0) & ~c("_locked")
    few = F.greatest(F.lit(1), F.floor(c("_counted") / 12))
    empty = true_runs(rows.filter(counted), keys, "bar", c("hits") == 0)
    runs = empty.groupBy(*keys).agg(F.count(F.lit(1)).alias("_runs"))
    played = rows.filter(~c("kind").isin("silent", "rest"))
    colours = color_balance(explode_notes(played, [*keys, "bar"]), keys).select(*keys, "balance_issue")
    patterns = pattern_repeat(rows, keys).select(*keys, "overused_pattern_count")
    judged = sums.join(runs, keys, "left").join(colours, keys, "left").join(patterns, keys, "left")
    long = c("_bars") >= 8
    found = {
        "bar-too-dense": c("bar-too-dense"),
        "bar-too-sparse": c("bar-too-sparse"),
        "too-sparse": F.when(high & (c("_mean") < average), 1),
        "sparse-bars": F.when(high & (c("_sparse") > few), c("_sparse")),
        "empty-runs": F.when(high, c("_runs")),
        "nearly-all-don": F.when(long & (c("balance_issue") == "nearly-all-don"), 1),
        "overlong-don-run": F.when(long & (c("balance_issue") == "overlong-don-run"), 1),
        "overused-patterns": F.when(long, c("overused_pattern_count")),
    }
    items = F.array(*[F.struct(F.lit(k).alias("code"), F.coalesce(v, F.lit(0)).cast("long").alias("n")) for k, v in found.items()])
    return judged.select(*keys, F.inline(items)).filter("n > 0")


def evidence_summary(
    metrics: DataFrame, charts: DataFrame, violations: DataFrame, required: Sequence[str], forbidden: Sequence[str], keys: Sequence[str], examples: int = 8
) -> DataFrame:
    """One row on all charts: how many there are, how many lack a required metric, how many
    gate violations they have, which forbidden score names occur, and the first examples of
    each in the order of the keys. Only counts, names and the examples come together."""
    keys = list(keys)
    lacking = metric_coverage(charts.select(*keys).distinct().join(metrics, keys, "left"), required, keys)
    label = F.concat_ws(":", *keys)

    def first(rows: DataFrame, text: Column, name: str) -> DataFrame:
        shown = rows.select(*keys, text.alias("_t")).orderBy(*keys, "_t").limit(examples)
        ordered = F.array_sort(F.collect_list(F.struct(*keys, "_t")))
        return shown.agg(F.array_join(F.transform(ordered, lambda x: x["_t"]), " ").alias(name))

    sums = charts.select(*keys).distinct().agg(F.count(F.lit(1)).alias("chart_count"))
    parts = [
        lacking.agg(F.count(F.lit(1)).alias("missing_metric_count")),
        violations.agg(F.count(F.lit(1)).alias("gate_violation_count")),
        metrics.filter(F.col("metric").isin(*forbidden)).agg(
            F.coalesce(F.array_join(F.array_sort(F.collect_set("metric")), ","), F.lit("")).alias("forbidden_keys")
        ),
        first(lacking, F.concat(label, F.lit("="), F.col("missing")), "missing_examples"),
        first(violations, F.concat(label, F.lit("="), F.col("code")), "violation_examples"),
    ]
    for part in parts:
        # Every part has one row.
        sums = sums.crossJoin(F.broadcast(part))
    return sums


def value_counts(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Counted values of some columns per key and over all keys (null keys), as texts
    "value:count value:count" in the order of the values; nulls are not counted.

    Counts are mergeable: rows are counted by key and value before they meet, and what is
    counted is rolled up once more for all keys.
    """
    keys = list(keys)
    values = F.array(*[F.struct(F.lit(n).alias("_name"), F.col(n).cast("string").alias("_text"), F.col(n).try_cast("double").alias("_size")) for n in names])
    counted = rows.select(*keys, F.inline(values)).groupBy(*keys, "_name", "_text", "_size").agg(F.count("_text").alias("_n"))
    dims = ["_name", "_text", "_size"]
    rolled = counted.groupingSets([[*keys, *dims], dims], *keys, *dims).agg(F.sum("_n").alias("_n"), F.grouping(keys[0]).alias("_all"))
    own = lambda name: F.when((F.col("_name") == name) & (F.col("_n") > 0), F.struct("_size", "_text", "_n"))
    out = rolled.groupBy("_all", *keys).agg(
        *[F.array_join(F.transform(F.array_sort(F.collect_list(own(n))), lambda x: F.concat_ws(":", x["_text"], x["_n"])), " ").alias(n) for n in names]
    )
    return out.select(*keys, *names)


def order_audit(points: DataFrame, keys: Sequence[str], place: Sequence[str], position: Sequence[str], value: str) -> DataFrame:
    """How many places of a key hold their values out of order, in the order of the input
    positions, which travel with the rows; and how many steps go down.

    A place holds the points of one bar.
    """
    keys, place = list(keys), list(place)
    own = F.transform(F.array_sort(F.collect_list(F.struct(*position, value))), lambda x: x[value])
    lists = points.groupBy(*keys, *place).agg(own.alias("_v"))
    falls = F.size(F.filter(F.transform("_v", lambda v, i: F.get("_v", i + 1) < v), lambda down: F.coalesce(down, F.lit(False))))
    steps = lists.withColumn("_falls", falls)
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("place_count"), flag_sum(F.col("_falls") > 0).alias("unordered_count"), F.sum("_falls").cast("long").alias("falling_steps")
    )


def ratio_rollup(rows: DataFrame, group: str, metrics: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Ratio of sums per group and overall, with the default of each metric for an empty denominator."""
    rolled = rows.groupingSets([[group], []], group).agg(
        F.grouping(group).alias("_all"),
        *[F.sum(n).alias(f"_n_{m}") for m, (n, _d, _e) in metrics.items()],
        *[F.sum(d).alias(f"_d_{m}") for m, (_n, d, _e) in metrics.items()],
    )
    return rolled.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col(group)).alias(group),
        *[
            ratio(F.col(f"_n_{m}"), F.col(f"_d_{m}"), empty=e, digits=6).alias(m)
            for m, (_n, _d, e) in metrics.items()
        ],
    )


def point_audit(points: DataFrame, bars: DataFrame, ticks: int = 48) -> DataFrame:
    """Contract of scored points: ticks in range and unique, silence empty, confidence and reason agree."""
    place = ["track", "bar"]
    per_tick = points.groupBy(*place, "tick").agg(F.count(F.lit(1)).alias("_n"))
    per_bar = per_tick.groupBy(*place).agg(
        F.sum("_n").alias("_points"),
        flag_sum(F.col("_n") > 1).alias("_twice"),
        flag_sum((F.col("tick") < 0) | (F.col("tick") >= ticks)).alias("_outside"),
    )
    reason, trust = F.col("fallback_reason"), F.col("bar_confidence")
    joined = bars.join(per_bar, place, "left").fillna(0, ["_points", "_twice", "_outside"])
    empty_kind = reason.isin("edge-silence", "silent-bar", "no-rhythmic-evidence")
    wrong = (
        (reason.isNull() & (trust < 0.45))
        | ((reason == "low-confidence") & (trust >= 0.45))
        | (empty_kind & (F.col("_points") > 0))
    )
    return joined.groupBy("track").agg(
        F.sum("_points").alias("point_count"),
        F.sum("_outside").alias("invalid_grid_count"),
        F.sum("_twice").alias("duplicate_grid_count"),
        F.sum(F.when(F.col("edge"), F.col("_points")).otherwise(0)).alias("edge_violation_count"),
        flag_sum(F.coalesce(wrong, F.lit(False))).alias("reason_violation_count"),
        flag_sum(reason.isNotNull()).alias("fallback_bar_count"),
        ratio(F.sum("_points"), F.count(F.lit(1)) * ticks, digits=6).alias("sparse_ratio"),
    )


def notices(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Notices of an analysis: one row per code that applies, with its level."""
    c = F.col

    def note(condition: Column, code: str | Column, level: str = "warning") -> Column:
        name = code if isinstance(code, Column) else F.lit(code)
        return F.when(condition, F.struct(name.alias("code"), F.lit(level).alias("level")))

    manual = F.contains(F.lower("analyzer"), F.lit("manual-override"))
    asked = c("requested_tracker")
    adopted = asked & c("partial_adoption")
    lost = asked & ~c("partial_adoption") & ~F.contains(F.lower("analyzer"), F.lit("beatnet"))
    rejected = lost & (c("tracker_status") == "complete") & c("tracker_rejected")
    reason = F.coalesce("source_reason", F.lit("unknown"))
    fallback = (
        F.when(reason.startswith("missing-dependency:"), "instrument-dependencies-unavailable")
        .when(reason.startswith("missing-model:") | reason.startswith("invalid-model-manifest"), "instrument-models-missing")
        .when(reason.startswith("device-unavailable:"), "instrument-device-unavailable")
        .otherwise("instrument-analysis-fallback")
    )
    sources, status = c("requested_sources"), c("source_status")
    classifier = (status == "complete") & c("stem_profile") & c("source_reason").isNotNull()
    found = F.array_compact(
        F.array(
            note(adopted, "beatnet-meter-adopted", "info"),
            note(rejected, "beatnet-candidate-rejected"),
            note(lost & ~rejected, "beatnet-fallback"),
            note(c("tempo_suspected"), "tempo-variation-suspected"),
            note(c("spectral_status") == "fallback", "spectral-analysis-fallback"),
            note(sources & classifier, "instrument-classifier-fallback"),
            note(sources & ~classifier & (status == "complete"), "instrument-analysis-succeeded", "info"),
            note(sources & (status == "partial"), "instrument-analysis-partial"),
            note(sources & ~status.isin("complete", "partial"), fallback),
            note(c("tempo_ambiguous") & ~manual, "tempo-arbitration-ambiguous"),
            note(~c("tempo_ambiguous") & ~c("tempo_accepted") & ~manual, "tempo-refinement-fallback"),
            note((c("bar_count") >= 4) & (c("structure_confidence") < 0.35), "structure-low-confidence"),
            note(c("resolution_evidence") == 0, "resolution-evidence-fallback"),
        )
    )
    return states.select(*keys, F.inline(found))


def alignment_report(charts: DataFrame, group: str) -> DataFrame:
    """Alignment sums per group and overall in one pass over per-chart counts.

    Needs note_count, evidenced_count, silent_violation_count and deterministic per chart.
    """
    rolled = charts.groupingSets([[group], []], group).agg(
        F.grouping(group).alias("_all"),
        F.count(F.lit(1)).alias("chart_count"),
        F.sum("note_count").alias("note_count"),
        F.sum("evidenced_count").alias("evidenced_note_count"),
        F.sum("silent_violation_count").alias("silent_violation_count"),
        flag_sum(F.col("deterministic")).alias("deterministic_chart_count"),
    )
    lost = F.col("note_count") - F.col("evidenced_note_count")
    return rolled.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col(group)).alias(group),
        "chart_count",
        "note_count",
        "evidenced_note_count",
        lost.alias("unsupported_note_count"),
        ratio(lost, F.col("note_count"), digits=6).alias("unsupported_note_ratio"),
        "silent_violation_count",
        "deterministic_chart_count",
        ratio(F.col("deterministic_chart_count"), F.col("chart_count"), digits=6).alias("deterministic_rate"),
    )


#: Ratios of the course report: name, counted part, whole, and the value of an empty whole.
REPORT_RATIOS = (
    ("unsupported_rate", "unsupported_count", "note_evaluated", 0.0),
    ("strong_response", "strong_responded", "strong_evaluated", 1.0),
    ("fill_alignment", "fill_aligned", "fill_evaluated", 1.0),
    ("violation_rate", "violation_count", "activity_count", 0.0),
    ("mean_tick_error", "tick_error_sum", "tick_evaluated", 0.0),
    ("deterministic_rate", "deterministic_count", "chart_count", 1.0),
)


def course_report(charts: DataFrame, group: str) -> DataFrame:
    """The alignment of charts per group and over all ("all"): notes without support, response
    to strong onsets, alignment of fills, notes in silence, distance to the tick, and charts
    that were rebuilt alike. Counts are added up once for groups and total; a ratio is that of
    the sums.

    ``charts`` carry the counts that ``REPORT_RATIOS`` names (null is 0; a chart's own metrics
    may be missing), tick_error_sum and the flag deterministic.
    """
    counts = [n for n in dict.fromkeys(x for _, part, whole, _ in REPORT_RATIOS for x in (part, whole)) if n not in ("deterministic_count", "chart_count")]
    rolled = charts.groupingSets([[group], []], group).agg(
        F.grouping(group).alias("_all"),
        F.count(F.lit(1)).alias("chart_count"),
        flag_sum(F.coalesce(F.col("deterministic"), F.lit(False))).alias("deterministic_count"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts],
    )
    return rolled.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col(group)).alias(group),
        "chart_count",
        "deterministic_count",
        *[n for n in counts if n != "tick_error_sum"],
        *[ratio(F.col(part), F.col(whole), empty=empty, digits=6).alias(name) for name, part, whole, empty in REPORT_RATIOS],
    )
