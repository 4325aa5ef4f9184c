"""What larger tables showed: cases that small ones do not reach."""

from pyspark.sql import functions as F

from pulsegrid.operators.quality import correlation, structure_quality


def test_correlation_of_flat_rows_is_zero(spark):
    rows = [("flat", 1.0, 2.0), ("flat", 2.0, 2.0), ("one", 1.0, 1.0), ("up", 0.0, 1.0), ("up", 1.0, 2.0), ("up", 2.0, 3.0), ("down", 0.0, 1.0), ("down", 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "k string, x double, y double").repartition(4, "k")
    got = {r["k"]: round(r["c"], 9) for r in frame.groupBy("k").agg(correlation(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got == {"flat": 0.0, "one": 0.0, "up": 1.0, "down": -1.0}


def test_structure_quality_of_a_chart_with_equal_bars(spark):
    bars = [(1, b, "1000", 0.5, 0.5, "build_up", False, b // 8, b % 8 / 7.0) for b in range(16)]
    schema = "track long, bar int, notes string, nps double, energy_percentile double, role string, fill_candidate boolean, phrase_id int, phrase_progress double"
    row = structure_quality(spark.createDataFrame(bars, schema), ["track"]).first()
    assert (row["structure_density_correlation"], row["build_up_slope_agreement"]) == (0.0, 0.0)


def test_a_small_file_of_many_rows_is_not_broadcast(spark, tmp_path):
    """Only sizes that adaptive execution measures, or marks in a plan, broadcast a side."""
    from pulsegrid.plans.registry import PLANS, plan

    path = str(tmp_path / "rows")
    spark.range(2_000_000).select((F.col("id") % 3).alias("k"), F.lit("x" * 40).alias("text")).write.parquet(path)
    name = "probe_of_measured_broadcasts"
    plan(name)(lambda spark, sf_dir: spark.read.parquet(path).join(spark.read.parquet(path).withColumnRenamed("text", "other"), "k"))
    joined = PLANS.pop(name)(spark, "")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_hit_scores_do_not_shuffle_the_dense_grid(spark, tmp_path):
    from pulsegrid.operators import evidence as ev

    numbers = ["vocal_activity", "drum_activity", "bass_activity", "accompaniment_activity", "energy"]
    bars = spark.range(8).select(
        (F.col("id") % 2).alias("track"), F.floor(F.col("id") / 2).cast("int").alias("bar"), *[F.lit(0.5).alias(n) for n in numbers],
        F.lit("peak").alias("role"), F.lit(False).alias("edge"), (F.col("id") < 4).alias("silent"),
    )
    # The first bars of both tracks are silent and move, the second ones are silent and do not.
    points = bars.where("bar <> 1").select("track", "bar", F.lit(6).alias("tick"), F.lit(True).alias("onset"), F.lit(False).alias("hint"), *[F.lit(0.6).alias(n) for n in ev.CHANNELS])
    ev.with_peaks(ev.evidence_grid(points, bars)).write.parquet(str(tmp_path / "peaks"))
    peaks = spark.read.parquet(str(tmp_path / "peaks"))
    assert {(r["bar"], r["_moving"]) for r in peaks.collect()} == {(0, True), (1, False), (2, True), (3, True)}
    scored = ev.hit_scores(peaks, spark.createDataFrame([(0, 0.5), (1, 0.5)], "track long, transient_p75 double"))
    assert "Window" not in scored._jdf.queryExecution().optimizedPlan().toString()
    assert {r["bar"] for r in scored.collect()} == {0, 2, 3}


def test_peaks_of_a_grid_without_empty_ticks_are_those_of_the_whole_grid(spark):
    from pulsegrid.operators import evidence as ev

    numbers = ["vocal_activity", "drum_activity", "bass_activity", "accompaniment_activity", "energy"]
    bars = spark.range(4).select(
        (F.col("id") % 2).alias("track"), F.floor(F.col("id") / 2).cast("int").alias("bar"), *[F.lit(0.5).alias(n) for n in numbers],
        F.lit("peak").alias("role"), F.lit(False).alias("edge"), F.lit(False).alias("silent"),
    )
    # Neighbours, ticks apart, ticks on and off the beat, a repeated and an outside tick; one bar has none.
    ticks = [(0, 0, 5, 0.4), (0, 0, 6, 0.9), (0, 0, 8, 0.7), (0, 0, 8, 0.3), (0, 1, 12, 0.6), (0, 1, 13, 0.6), (1, 0, 47, 0.8), (1, 0, 48, 1.0), (1, 0, 45, 0.0)]
    points = spark.createDataFrame(ticks, "track long, bar int, tick int, x double").select(
        "track", "bar", "tick", (F.col("x") > 0.35).alias("onset"), F.lit(False).alias("hint"), *[F.col("x").alias(n) for n in ev.CHANNELS]
    )
    whole = ev.with_peaks(ev.evidence_grid(points, bars))
    short = ev.with_peaks(ev.evidence_grid(points, bars, whole=False))
    assert whole.columns == short.columns
    held = {(r["track"], r["bar"], r["tick"]): r for r in short.collect()}
    assert len(held) == 16 + 6 and short.count() == len(held)
    for row in whole.collect():
        place = (row["track"], row["bar"], row["tick"])
        if place in held:
            assert row == held[place]
        else:
            assert not (row["onset_peak"] or row["spectral_peak"] or row["beat"] or row["onset"])
            assert row["margin"] == row["spectral"] == row["drum_raw"] == row["activity"] == 0.0
    reference = spark.createDataFrame([(0, 0.5), (1, 0.5)], "track long, transient_p75 double")
    found = [ev.hit_scores(p, reference) for p in (whole, short)]
    assert sorted(map(str, found[0].collect())) == sorted(map(str, found[1].collect()))
    salience = [ev.bar_salience(p, h) for p, h in zip((whole, short), found, strict=True)]
    assert sorted(map(str, salience[0].collect())) == sorted(map(str, salience[1].collect()))


def test_density_coverage_takes_notes_to_the_kinds_in_reach_only(spark, monkeypatch):
    import random

    from pulsegrid.operators import quality

    draw = random.Random(5)
    kinds = ("silent", "rest", "sparse", "normal")
    # Kinds change every 40; a tie, both ends of the tolerance and a track without candidates.
    found = [(1, kinds[1 + int(t // 40) % 3], t) for t in sorted(draw.sample(range(400), 90))] + [(2, "rest", 7.0), (2, "sparse", 9.0), (2, "rest", 64.0)]
    notes = [(1, float(t) / 2) for t in draw.sample(range(-4, 800), 160)] + [(2, 8.0), (2, 8.0), (2, 63.0), (2, 65.0), (3, 1.0)]

    def walked(track, kind):
        refs = sorted(t for k, n, t in found if (k, n) == (track, kind))
        ests = sorted(t for k, t in notes if k == track and t >= 0)
        i = j = hits = 0
        while i < len(refs) and j < len(ests):
            if abs(ests[j] - refs[i]) <= 1.0:
                i, j, hits = i + 1, j + 1, hits + 1
            elif ests[j] < refs[i]:
                j += 1
            else:
                i += 1
        return hits, len(refs)

    seen = []
    whole = quality.match_one_to_one

    def watched(references, estimates, *more, **named):
        seen.append(estimates.count())
        return whole(references, estimates, *more, **named)

    monkeypatch.setattr(quality, "match_one_to_one", watched)
    made = quality.density_coverage(
        spark.createDataFrame([(k, n, float(t)) for k, n, t in found], "track long, kind string, t double"),
        spark.createDataFrame(notes, "track long, t double"), ["track"], kinds, 1.0, 96.0,
    )
    got = {(r.track, r.kind): (r.responded_count, r.evaluated_count) for r in made.collect()}
    assert got == {(t, k): walked(t, k) for t in (1, 2, 3) for k in kinds}
    assert got[(2, "rest")] == (2, 2) and got[(2, "sparse")] == (1, 1)
    assert seen and max(seen) < 2 * len(notes)


def test_tables_staged_by_bar_are_not_shuffled_by_bar_again(spark, tmp_path):
    from pyspark.sql import Window

    from pulsegrid.plans.stages import buckets, stage

    assert buckets(spark, 0) == buckets(spark, 100) == spark.sparkContext.defaultParallelism
    assert buckets(spark, 250_000 * 99 + 1) == 100
    rows = spark.range(3000).select((F.col("id") % 7).alias("track"), (F.col("id") % 11).alias("bar"), "id").withColumn("bar", F.when(F.col("bar") < 10, F.col("bar")))
    made = [stage(spark, str(tmp_path), f"probe-{n}", lambda: rows.repartition(6, "track", "bar"), ("track", "bar"), 6) for n in "ab"]
    assert made[0].exceptAll(rows).count() == 0 == rows.exceptAll(made[0]).count()
    first = made[0].withColumn("n", F.row_number().over(Window.partitionBy("track", "bar").orderBy("id"))).filter("n = 1")
    sums = made[1].groupBy("track", "bar").agg(F.max("id").alias("last"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    met = first.join(sums, ["track", "bar"])
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 70


def test_candidates_are_picked_per_bar_without_a_shuffle(spark, tmp_path):
    from pulsegrid.operators import evidence as ev
    from pulsegrid.plans.evidence import ranked, scored
    from pulsegrid.plans.registry import measured_broadcasts

    n = F.col("id")
    spark.range(400).select(
        F.when(n % 50 > 0, n % 3).alias("l_suppkey"), (n % 50 + 1).cast("decimal(15,2)").alias("l_quantity"), ((n % 11) / 100).alias("l_discount"), ((n % 9) / 100).alias("l_tax"),
        F.element_at(F.array(F.lit("A"), F.lit("R"), F.lit("N")), (n % 3 + 1).cast("int")).alias("l_returnflag"), F.when(n % 2 == 0, "O").otherwise("F").alias("l_linestatus"),
        F.date_add(F.lit("1995-01-01").cast("date"), (n * 37 % 300).cast("int")).alias("l_shipdate"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    measured_broadcasts(spark)
    picked = ev.quota_topk(ranked(spark, str(tmp_path)), size=8, arbitrary=1)
    assert "Exchange" not in picked._jdf.queryExecution().executedPlan().toString()
    best = {(r.track, r.bar): r.n for r in picked.groupBy("track", "bar").agg(F.count("tick").alias("n")).collect()}
    assert best and max(best.values()) == 8 and {t for t, _ in best} <= {0, 1, 2}
    points = scored(spark, str(tmp_path))[1]
    assert not {"section_id", "onset_count", "margin", "energy"} & set(points.columns)
