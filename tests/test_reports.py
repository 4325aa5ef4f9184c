"""Report folders, quality findings and audits on hand-made cases."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import gates, structure
from pulsegrid.sources.reports import manifest_of, read_report, write_report


def test_a_report_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    first = spark.range(20).select("id", F.array("id", F.lit(None).cast("long")).alias("list"), F.struct(F.col("id").cast("string").alias("a")).alias("s"), F.lit(1.5).alias("x"), F.lit(Decimal("2.50")).alias("d"), F.lit("2024-02-03").cast("date").alias("day"))
    write_report(first.repartition(3), path)
    assert sorted(map(str, read_report(spark, path).collect())) == sorted(map(str, first.collect()))
    assert read_report(spark, path).dtypes == first.dtypes
    write_report(first.limit(0), path)
    assert read_report(spark, path).count() == 0 and read_report(spark, path).columns == first.columns
    with pytest.raises(Exception, match="whole"):
        first.write.format("report").mode("append").option("path", path).save()


def test_a_failing_task_leaves_the_old_report(spark, tmp_path):
    path = str(tmp_path / "report")
    write_report(spark.range(5), path)
    before = manifest_of(path)
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_report(broken, path)
    assert manifest_of(path) == before
    assert sorted(r.id for r in read_report(spark, path).collect()) == list(range(5))
    # What the failed write's tasks had written is gone, but for tasks that ended after it.
    names = {f for folder, _, files in os.walk(path) for f in files if f.startswith("part-")}
    assert set(before["files"]) <= names and len(names - set(before["files"])) <= 3 + 8
    write_report(spark.range(7), path)
    assert manifest_of(path)["older"][0] == before["version"]
    assert read_report(spark, path).count() == 7


def test_no_report_and_no_mount(spark):
    with pytest.raises(Exception, match="no report"):
        read_report(spark, "/tmp/there-is-none").count()
    with pytest.raises(Exception, match="mounted"):
        write_report(spark.range(1), "store://bucket/report")


def chart(spark, notes, **more):
    hint = {"kind": "normal", "min_hits": 2, "max_hits": 12, "allow_empty": False, "in_average": True, "density_class": "high", "timing_locked": False, **more}
    rows = [(1, n, text, *hint.values()) for n, text in enumerate(notes)]
    kinds = "track long, bar int, notes string, kind string, min_hits int, max_hits int, allow_empty boolean, in_average boolean, density_class string, timing_locked boolean"
    return spark.createDataFrame(rows, kinds).withColumn("start_s", F.col("bar") * 2.0).withColumn("end_s", F.col("bar") * 2.0 + 2)


def findings(frame):
    return {r.code: r.n for r in gates.quality_gate(frame, ["track"]).collect()}


def test_quality_findings(spark):
    empty, thin, full = "0" * 16, "1" + "0" * 15, "1" * 16
    assert findings(chart(spark, [full, thin])) == {"bar-too-dense": 1, "bar-too-sparse": 1}
    assert findings(chart(spark, [full, thin], timing_locked=True)) == {"bar-too-dense": 1}
    bars = [empty, empty, thin, empty, *["1010101010101010"] * 5]
    got = findings(chart(spark, bars, density_class="medium"))
    assert got == {"bar-too-sparse": 4, "nearly-all-don": 1, "overused-patterns": 1}
    got = findings(chart(spark, bars))
    assert got == {"bar-too-sparse": 4, "too-sparse": 1, "sparse-bars": 4, "empty-runs": 2, "nearly-all-don": 1, "overused-patterns": 1}
    mixed = ["1020102010201020", "1000200010202010"] * 4
    assert findings(chart(spark, mixed, density_class="medium")) == {}
    assert findings(chart(spark, [])) == {}


def test_refill_fills_up_to_the_minimum(spark):
    point = "track long, phrase_id long, bar int, tick int, priority int, weight double, reliable boolean"
    selected = spark.createDataFrame([(1, 0, 0, t, 0, 1.0, True) for t in (0, 7, 11)] + [(1, 0, 1, 6, 0, 1.0, True)], point)
    spare = [(1, 0, 0, 3, 1, 2.0, True), (1, 0, 0, 9, 1, 3.0, True), (1, 0, 0, 12, 0, 0.5, False), (1, 0, 0, 13, 0, 9.0, True), (1, 0, 1, 3, 0, 1.0, True)]
    lattice = spark.createDataFrame([(1, 0, 0, None)], "track long, phrase_id long, straight_phase int, triplet_phase int")
    admitted = spark.createDataFrame([(1, 0, 7)], "track long, phrase_id long, tick int")
    hints = spark.createDataFrame([(1, 0, 5), (1, 1, 5)], "track long, bar int, min_hits int")
    made = structure.resolved_skeleton(selected, selected.unionByName(spark.createDataFrame(spare, point)), lattice, admitted, hints, ["track", "phrase_id"])
    # Bar 0 is owed three (as many as were selected), has two; bar 1 is owed one and has it.
    assert sorted((r.bar, r.tick, r.source) for r in made.collect()) == [(0, 0, "lattice"), (0, 7, "exception"), (0, 9, "refill"), (1, 6, "lattice")]


def test_counted_values(spark):
    rows = spark.createDataFrame([(1, "b", 24), (1, "a", 16), (1, "b", 100), (2, None, 16)], "k long, name string, size int")
    got = {r.k: (r.name, r["size"]) for r in gates.value_counts(rows, ["k"], ["name", "size"]).collect()}
    assert got == {1: ("a:1 b:2", "16:1 24:1 100:1"), 2: ("", "16:1"), None: ("a:1 b:2", "16:2 24:1 100:1")}


def test_order_audit_reads_input_positions(spark):
    rows = [(1, 0, n, t) for n, t in enumerate((1, 2, 2, 9))] + [(1, 1, n, t) for n, t in enumerate((5, 3, 4, 1))] + [(2, 0, 0, 7)]
    frame = spark.createDataFrame(rows, "k long, bar int, n int, tick int").orderBy(F.rand(3)).repartition(3)
    got = {r.k: (r.place_count, r.unordered_count, r.falling_steps) for r in gates.order_audit(frame, ["k"], ["bar"], ["n"], "tick").collect()}
    assert got == {1: (2, 1, 2), 2: (1, 0, 0)}


def test_evidence_summary(spark):
    charts = spark.createDataFrame([(1,), (2,), (3,)], "track long")
    metrics = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "score")], "track long, metric string")
    wrong = spark.createDataFrame([(3, "late"), (1, "late")], "track long, code string")
    row = gates.evidence_summary(metrics, charts, wrong, ["a", "b"], ["score", "total"], ["track"], 2).collect()
    assert [tuple(r) for r in row] == [(3, 2, 2, "score", "2=b 3=a,b", "1=late 3=late")]


def test_course_report(spark):
    names = ["note_evaluated", "unsupported_count", "strong_evaluated", "strong_responded", "fill_evaluated", "fill_aligned", "activity_count", "violation_count", "tick_evaluated", "tick_error_sum"]
    rows = [("Easy", True, 10, 5, 4, 2, 2, 1, 20, 5, 4, 2.0), ("Easy", False, 10, 0, None, None, None, None, 0, 0, None, None), ("Oni", True, None, None, 1, 1, 0, 0, 5, 0, 1, 0.5)]
    frame = spark.createDataFrame(rows, "course string, deterministic boolean, " + ", ".join(f"{n} {'double' if n == 'tick_error_sum' else 'long'}" for n in names))
    got = {r.course: r for r in gates.course_report(frame, "course").collect()}
    assert set(got) == {"Easy", "Oni", "all"}
    easy, whole = got["Easy"], got["all"]
    assert (easy.chart_count, easy.deterministic_count, easy.deterministic_rate) == (2, 1, 0.5)
    assert (easy.unsupported_rate, easy.strong_response, easy.fill_alignment, easy.violation_rate, easy.mean_tick_error) == (0.25, 0.5, 0.5, 0.25, 0.5)
    assert (whole.note_evaluated, whole.strong_response, whole.fill_alignment, whole.violation_rate, whole.mean_tick_error) == (20, 0.6, 0.5, 0.2, 0.5)
    assert (got["Oni"].unsupported_rate, got["Oni"].fill_alignment) == (0.0, 1.0)
