"""Hand-computed chart texts, note strings and small structures."""

from pyspark.sql import functions as F

from pulsegrid.functions import notes as N
from pulsegrid.operators import charts, rules, structure
from pulsegrid.sources import chart_text, content

TEXT = """TITLE:Example
SUBTITLE:--Someone
BPM:120
WAVE:a.ogg
OFFSET:-1

COURSE:Oni
LEVEL:8
BALLOON:5,7
#START
1020, // first bar
#BPMCHANGE 240
#MEASURE 3/4
#GOGOSTART
7008
00,
#GOGOEND
#MEASURE 1/1
10
#BPMCHANGE 120
79,
#END
COURSE:Easy
LEVEL:2
#START
1,
#END
"""


def test_ingest_by_hand(spark):
    text = TEXT.replace("79,", "78,")
    files = spark.createDataFrame([("a", text)], "source_id string, text string")
    got = chart_text.ingest(files)
    assert got.errors.count() == 0
    rows = {(r.course, r.bar): r for r in got.bars.collect()}
    assert len(rows) == 4
    first, second, third = (rows["Oni", i] for i in range(3))
    assert (first.start_s, first.end_s, first.notes, first.level) == (1.0, 3.0, "1020", 8)
    assert (second.start_s, second.end_s, second.notes) == (3.0, 3.75, "700800")
    assert second.gogo and second.balloon_counts == [5] and second.measure_ratio == "3/4"
    assert third.notes == "1078" and third.balloon_counts == [7] and not third.gogo
    assert [tuple(x) for x in third.tempo_changes] == [(2, 120.0)]
    assert third.end_s == 3.75 + 0.5 + 1.0
    assert rows["Easy", 0].end_s == 3.0


def test_first_error_decides(spark):
    cases = {
        "empty": ("", "missing-chart"),
        "open": ("BPM:1\nCOURSE:A\nLEVEL:1\n#START\n1,\n", "unclosed-chart"),
        "two": ("BPM:1\nCOURSE:A\nLEVEL:1\n#START\n#GOGOEND\n,\n#END\n", "orphan-gogo-end"),
        "more": ("BPM:1\nCOURSE:A\nLEVEL:1\nBALLOON:3\n#START\n77,\n#END\n", "balloon-count-mismatch"),
        "fewer": ("BPM:1\nCOURSE:A\nLEVEL:1\nBALLOON:3,4\n#START\n7,\n#END\n", "balloon-count-mismatch"),
        "cleared": ("BPM:1\nCOURSE:A\nLEVEL:1\n#START\n1,\n#END\nCOURSE:B\n#START\n1,\n#END\n", "invalid-level"),
    }
    files = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "source_id string, text string")
    got = {r.source_id: r.code for r in chart_text.ingest(files).errors.collect()}
    assert got == {k: code for k, (_, code) in cases.items()}


def test_same_rhythm_at_three_resolutions(spark):
    coarse = "1020300040005008"
    rows = [(n, "".join(ch + "0" * (n // 16 - 1) for ch in coarse)) for n in (16, 48)]
    df = spark.createDataFrame(rows, "n int, notes string")
    keys = {r.k for r in df.select(N.pattern_key(F.col("notes")).alias("k")).collect()}
    assert len(keys) == 1
    bars = df.select(
        F.col("n").cast("long").alias("track"), F.lit(0).alias("bar"), "notes", F.lit(0.0).alias("start_s"),
        F.lit(2.0).alias("end_s"), F.array().cast("array<int>").alias("balloon_counts"),
    )
    loads = [tuple(r)[1:] for r in charts.chart_load(bars, ["track"]).collect()]
    assert len(set(loads)) == 1
    spans = {(r.start_s, r.end_s) for r in charts.sustain_spans(charts.sustain_events(bars, ["track"]), ["track"]).collect()}
    assert len(spans) == 1


def test_spans_toggle_and_strict(spark):
    bars = spark.createDataFrame(
        [(1, 0, "5080", 0.0, 4.0), (1, 1, "5578", 4.0, 8.0), (1, 2, "8000", 8.0, 12.0), (1, 3, "7000", 12.0, 16.0), (1, 4, "8000", 5.0, 5.0), (1, 5, "8000", 20.0, 24.0)],
        "track long, bar int, notes string, start_s double, end_s double",
    )
    marks = charts.sustain_events(bars, ["track"])
    spans = sorted((r.start_s, r.end_s) for r in charts.sustain_spans(marks, ["track"]).collect())
    assert spans == [(0.0, 2.0), (6.0, 7.0)]
    issues = sorted((r.bar, r.pos, r.code) for r in charts.span_issues(marks.filter("note != 'x'"), ["track"]).collect())
    assert issues == [(1, 1, "overlapping-roll-start"), (1, 2, "overlapping-roll-start"), (2, 0, "orphan-roll-end")]


def test_sections_join_the_nearest_centre(spark):
    def vector(x):
        return [x] * 19

    rows = [(1, i, vector(x), x) for i, x in enumerate((0.1, 0.9, 0.15, 0.88, 0.5))]
    phrases = spark.createDataFrame(rows, "track long, phrase_id long, signature array<double>, mean_energy double")
    bars = phrases.select(
        "track", "phrase_id", F.lit(0.5).alias("activity_mean"),
        *[F.lit(0.2).alias(n) for n in structure.SOURCES],
    )
    got = {r.phrase_id: (r.section_id, r.section) for r in structure.sections(phrases, bars, ["track"]).collect()}
    assert got[0][0] == got[2][0] and got[1][0] == got[3][0] and got[4][0] == "section-3"
    assert got[1][1] == "chorus" and got[4][1] == "outro" and got[0][1] == "verse"


def test_resolution_plan_lifts_one_phrase(spark):
    rows = []
    for bar in range(12):
        step = 1 if 4 <= bar < 8 else 3
        rows += [(1, bar, float(bar * 48 + t), 1.0) for t in range(0, 48, 3 if step == 3 else 5)]
    samples = spark.createDataFrame(rows, "track long, bar int, position double, weight double")
    bars = spark.createDataFrame(
        [(1, b, b // 4, f"s{b // 4}", 0.5 if b % 4 == 3 else 0.0) for b in range(12)],
        "track long, bar int, phrase_id int, section_id string, boundary_confidence double",
    )
    chosen = structure.resolution_choice(samples, ["track"])
    got = {r.bar: r.resolution for r in structure.resolution_plan(samples, bars, chosen, ["track"]).collect()}
    assert [got[b] for b in (0, 3, 4, 7, 8, 11)] == [16, 16, 48, 48, 16, 16]


def test_exception_groups_are_all_or_nothing(spark):
    base = [(1, 0, b, t, "transient", 0.5, ["onset"], 1.0) for b in range(10) for t in (0, 6, 12, 18)]
    three = [(1, 0, b, 7, "strong-transient", 0.99, ["onset"], 2.0) for b in range(3)]
    five = [(1, 0, b, 11, "strong-transient", 0.99, ["onset"], 9.0) for b in range(5)]
    points = spark.createDataFrame(
        base + three + five,
        "track long, phrase_id long, bar int, tick int, kind string, confidence double, reasons array<string>, weight double",
    )
    lattice = spark.createDataFrame([(1, 0, 0, None)], "track long, phrase_id long, straight_phase int, triplet_phase int")
    got = structure.exception_budget(points, lattice, ["track", "phrase_id"]).collect()
    # The budget is 4 of 40: the heavier group of five does not fit, the group of three does.
    assert [r.tick for r in got] == [7]


def test_fill_scores(spark):
    zeros = {n: 0.0 for n in (*structure.SPECTRAL, *structure.SOURCES, "energy_percentile", "activity_mean", "cadence_cue")}
    rows = [
        {"track": 1, "bar": b, "phrase_id": b // 2, "transition_role": "cadence" if b == 1 else "stable", "onset_density": 0.3, "edge_silent": False, **zeros}
        for b in range(6)
    ]
    roles = spark.createDataFrame(rows)
    phrases = spark.createDataFrame(
        [(1, 0, 0, 1, 0.2, 1.0, "stable"), (1, 1, 2, 3, 0.9, 0.5, "peak"), (1, 2, 4, 5, 0.2, 1.0, "stable")],
        "track long, phrase_id long, start_bar long, end_bar long, mean_energy double, ending_confidence double, final_role string",
    )
    got = {r.bar: (r.fill_score, r.fill_candidate) for r in structure.fill_candidates(roles, phrases, ["track"]).collect()}
    # bar 1: .30 + .15 + .7*.2 + .15 + .10 = .84; bar 5: .30 + .15 + .15 = .60 but only one bar of six is kept.
    assert got[1] == (0.84, True)
    assert got[3] == (0.44, False)
    assert got[5] == (0.599, False)


def test_event_encoding(spark):
    hits = spark.createDataFrame([(1, 0, 0, "1"), (1, 0, 12, "2"), (1, 1, 1, "1"), (1, 2, 4, "3")], "track long, bar int, tick int, note string")
    longs = spark.createDataFrame([(1, 0, 24, 36, "balloon", 5), (1, 2, 0, 6, "drumroll", None)], "track long, bar int, start_tick int, end_tick int, kind string, balloon_count int")
    bars = spark.createDataFrame([(1, b, 24) for b in range(3)] + [(1, 3, 20)], "track long, bar int, resolution int")
    issues, clean = rules.encode_events(hits, longs, bars, ["track", "bar"])
    assert {(r.bar, r.code) for r in issues.collect()} == {
        (1, "tick-not-representable"), (2, "hit-inside-long-note"), (3, "incompatible-resolution"),
    }
    assert {r.bar: r.notes for r in clean.collect()} == {0: "100000200000700000800000"}


def test_pairs_and_decoding(spark, tmp_path):
    for name in ("Song A.tja", "song a.OGG", "Other.tja"):
        (tmp_path / name).write_bytes(b"x")
    files = content.list_files(spark, str(tmp_path))
    assert [(r.name, r.code) for r in content.unpaired_charts(files).collect()] == [("Other.tja", "missing-audio")]
    empty = content.unpaired_charts(files.filter("suffix = 'ogg'"))
    assert [r.code for r in empty.collect()] == ["no-charts"]
    raw = spark.createDataFrame([(1, bytearray("曲".encode("cp932"))), (2, bytearray(b"\xef\xbb\xbfab")), (3, bytearray(b"\xff"))], "id int, content binary")
    got = {r.id: (r.text, r.encoding, r.code) for r in content.decode_files(spark, raw).collect()}
    assert got == {1: ("曲", "cp932", None), 2: ("ab", "utf-8", None), 3: (None, None, "decode-failed")}
    audit = content.encode_audit(spark, spark.createDataFrame([(1, "曲\naéb"), (2, "曲")], "id int, text string")).collect()
    assert [(r.id, r.line_no, r.column_no, r.code_point) for r in audit] == [(1, 2, 2, "U+00E9")]
