"""Tolerance operators against brute force on random and degenerate timelines."""

import random
import uuid

import pytest

from pulsegrid.operators import matching, sequences
from pulsegrid.operators.scan import ordered_scan, time_cell
from pyspark.sql import functions as F

TOL = 5


def timelines(seed, tracks=25, span=400):
    rng = random.Random(seed)
    out = {}
    for track in range(tracks):
        dense = rng.choice([3, 20, 90])
        ref = sorted(rng.randint(0, span) for _ in range(rng.randint(0, dense)))
        est = sorted(rng.randint(0, span) for _ in range(rng.randint(0, dense)))
        out[track] = (ref, est)
    out[100] = ([10, 10, 10], [10, 15, 16])
    out[101] = ([0], [5])
    out[102] = (list(range(0, 300)), list(range(2, 302)))
    return out


def frames(spark, data, parts=3):
    ref = [(k, t) for k, (r, _) in data.items() for t in r]
    est = [(k, t) for k, (_, e) in data.items() for t in e]
    random.Random(1).shuffle(ref)
    random.Random(2).shuffle(est)
    schema = "track long, t long"
    return spark.createDataFrame(ref, schema).repartition(parts), spark.createDataFrame(est, schema).repartition(parts)


def two_pointer(ref, est, tol):
    i = j = 0
    pairs = []
    while i < len(ref) and j < len(est):
        if abs(est[j] - ref[i]) <= tol:
            pairs.append((ref[i], est[j]))
            i, j = i + 1, j + 1
        elif est[j] < ref[i]:
            j += 1
        else:
            i += 1
    return sorted(pairs)


@pytest.mark.parametrize("seed,chunk,parts", [(1, 512, 3), (2, 7, 1), (3, 3, 8)])
def test_one_to_one(spark, seed, chunk, parts):
    data = timelines(seed)
    ref, est = frames(spark, data, parts)
    rows = matching.match_one_to_one(ref, est, ["track"], TOL, cell_width=40, chunk_rows=chunk).collect()
    for track, (r, e) in data.items():
        mine = [x for x in rows if x.track == track]
        assert sorted(x.t for x in mine if x.side == "ref") == r
        assert sorted(x.t for x in mine if x.side == "est") == e
        pairs = sorted((x.t, x.partner_t) for x in mine if x.side == "ref" and x.partner_t is not None)
        assert pairs == two_pointer(r, e, TOL)
        back = sorted((x.partner_t, x.t) for x in mine if x.side == "est" and x.partner_t is not None)
        assert back == pairs


def test_nearest_and_exists(spark):
    data = timelines(4)
    ref, est = frames(spark, data)
    rows = matching.nearest_within(ref, est, ["track"], TOL, cell_width=11).collect()
    assert len(rows) == sum(len(r) for r, _ in data.values())
    for row in rows:
        near = [t for t in data[row.track][1] if abs(t - row.t) <= TOL]
        want = min(near, key=lambda t: (abs(t - row.t), t)) if near else None
        assert row.match_t == want


def test_invalid_times_are_dropped(spark):
    schema = "track long, t double"
    ref = spark.createDataFrame([(1, 1.0), (1, -2.0), (1, float("nan")), (1, float("inf"))], schema)
    est = spark.createDataFrame([(1, 1.5)], schema)
    rows = matching.match_one_to_one(ref, est, ["track"], 0.5).collect()
    assert sorted((r.side, r.t, r.partner_t) for r in rows) == [("est", 1.5, 1.0), ("ref", 1.0, 1.5)]


@pytest.mark.parametrize("closed,margin", [(False, 0), (True, 0), (False, 3)])
def test_covering(spark, closed, margin):
    rng = random.Random(9)
    points = [(k, rng.randint(0, 300)) for k in range(6) for _ in range(60)]
    ranges = [(k, s, s + rng.randint(0, 40)) for k in range(6) for s in rng.sample(range(300), 12)]
    p = spark.createDataFrame(points, "track long, t long")
    r = spark.createDataFrame(ranges, "track long, start_t long, end_t long")
    rows = matching.count_covering(p, r, ["track"], margin=margin, closed=closed, cell_width=25).collect()
    assert len(rows) == len(points)
    for row in rows:
        want = sum(
            k == row.track and s - margin <= row.t and (row.t <= e + margin if closed else row.t < e + margin)
            for k, s, e in ranges
        )
        assert row.covering == want


def test_overlaps(spark):
    rng = random.Random(11)
    a = [(k, i, s, s + rng.randint(0, 9)) for k in range(5) for i, s in enumerate(rng.sample(range(200), 15))]
    b = [(k, s, s + rng.randint(0, 9)) for k in range(5) for s in rng.sample(range(200), 6)]
    left = spark.createDataFrame(a, "track long, id long, start_t long, end_t long")
    right = spark.createDataFrame(b, "track long, start_t long, end_t long")
    rows = matching.overlaps_any(left, right, ["track"], cell_width=30).collect()
    assert len(rows) == len(a)
    for row in rows:
        assert row.overlaps == any(k == row.track and max(s, row.start_t) <= min(e, row.end_t) for k, s, e in b)


def test_ordered_scan_crosses_cells(spark):
    rows = spark.createDataFrame([(1, t, t * 2) for t in (0, 3, 9, 50, 51, 120)], "k long, t long, v long")
    out = ordered_scan(
        rows.repartition(3), ["k"], ["t"], time_cell(F.col("t"), 10),
        lag={"before": F.col("v")}, lead={"after": F.col("v")}, cumsum={"total": F.col("v")},
    ).orderBy("t").collect()
    assert [r.before for r in out] == [None, 0, 6, 18, 100, 102]
    assert [r.after for r in out] == [6, 18, 100, 102, 240, None]
    assert [r.total for r in out] == [0, 6, 24, 124, 226, 466]


@pytest.mark.parametrize("top", [200, 2000, 40_000])
def test_spaced_picks(spark, top):
    rng = random.Random(3)
    data = {k: sorted({rng.randint(-50, top) for _ in range(150)}) for k in range(4)}
    df = spark.createDataFrame([(k, t) for k, ts in data.items() for t in ts + ts[:3]], "track long, t long")
    got = sequences.spaced_picks(df, ["track"], "t", 7, 20).collect()
    for k, times in data.items():
        kept = []
        for t in times:
            if not kept or t - kept[-1] > 7:
                kept.append(t)
        assert sorted(r.t for r in got if r.track == k) == kept


def jobs_of(spark, build):
    """The result of ``build()`` and the jobs that it and its collection took."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "")
    rows = build().collect()
    spark.sparkContext.setJobGroup("rest", "")
    return rows, len(tracker.getJobIdsForGroup(group))


def test_spaced_picks_of_a_long_chain(spark):
    """100,000 events of which each depends on the one before; jobs as for a short one."""
    chain = lambda n: spark.range(n).select(F.lit(1).alias("track"), (F.col("id") * 5).alias("t"))
    short, few = jobs_of(spark, lambda: sequences.spaced_picks(chain(100), ["track"], "t", 7, 20))
    rows, many = jobs_of(spark, lambda: sequences.spaced_picks(chain(100_000), ["track"], "t", 7, 20))
    assert sorted(r.t for r in short) == list(range(0, 500, 10))
    assert sorted(r.t for r in rows) == list(range(0, 500_000, 10))
    assert many <= few + 2


def plain_apart(data, separation):
    """The kept (track, frame) of {(track, frame): value}, strongest first."""
    want = set()
    for (k, f), _ in sorted(data.items(), key=lambda x: (x[1], x[0][1]), reverse=True):
        if all((k, f + d) not in want for d in range(1 - separation, separation)):
            want.add((k, f))
    return want


@pytest.mark.parametrize(("separation", "spread"), [(5, 90), (2, 300), (9, 700), (70, 900), (1, 60)])
def test_strongest_apart(spark, separation, spread):
    rng = random.Random(5)
    data = {(k, f): rng.randint(0, 20) for k in range(4) for f in rng.sample(range(-30, spread), spread // 2)}
    df = spark.createDataFrame([(k, f, float(v)) for (k, f), v in data.items()], "track long, frame long, value double")
    got = [(r.track, r.frame) for r in sequences.strongest_apart(df, ["track"], "frame", "value", separation).collect()]
    assert sorted(got) == sorted(plain_apart(data, separation))


def test_strongest_apart_of_rising_peaks(spark):
    """10,000 peaks of which each depends on the next; jobs as for a few."""
    rising = lambda n: spark.range(n).select(F.lit(1).alias("track"), (F.col("id") * 2).alias("frame"), F.col("id").cast("double").alias("value"))
    _, few = jobs_of(spark, lambda: sequences.strongest_apart(rising(50), ["track"], "frame", "value", 6))
    rows, many = jobs_of(spark, lambda: sequences.strongest_apart(rising(10_000), ["track"], "frame", "value", 6))
    assert sorted(r.frame for r in rows) == list(range(19_998, -1, -6))[::-1]
    assert many <= few + 2


def test_quantiles(spark):
    rng = random.Random(6)
    data = {k: [rng.randint(0, 1000) / 10 for _ in range(n)] for k, n in ((1, 1), (2, 2), (3, 57), (4, 200))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k long, v double")
    rows = sequences.grouped_quantiles(
        df, ["k"], {"median": (F.col("v"), 0.5), "p95": (F.col("v"), 0.95)}, 3.0, index_rule=["p95"]
    ).collect()
    for row in rows:
        values = sorted(data[row.k])
        spot = 0.5 * (len(values) - 1)
        low, high = values[int(spot)], values[min(len(values) - 1, int(spot) + 1)]
        assert abs(row.median - (low + (high - low) * (spot - int(spot)))) < 1e-9
        assert row.p95 == values[min(len(values) - 1, int(len(values) * 0.95))]


def test_tempo_scan_paths_agree(spark, monkeypatch):
    from pulsegrid.operators import tempo

    rng = random.Random(8)
    rows = [(k, i * 0.5 + rng.random() / 50, rng.randint(1, 9)) for k in range(2) for i in range(40)]
    df = spark.createDataFrame(rows, "track long, s double, w long")
    runs = []
    for few in (4096, 5):
        monkeypatch.setattr(tempo, "FEW_ONSETS", few)
        runs.append(sorted(map(tuple, tempo.tempo_scan(df, ["track"], F.col("s"), F.col("w"), 20.0, 118.0).collect())))
    assert runs[0] == runs[1]
    assert all(abs(row[3] - 120.0) <= 1.0 for row in runs[0])
