"""Plans that write chart files, read them back and check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.plans.bindings import chart_bars
from pulsegrid.plans.charts import COURSES
from pulsegrid.plans.registry import cte, plan
from pulsegrid.sources import chart_text


def _course_texts(spark, sf_dir):
    """One chart block per track with commands placed by bar number: track, text parts.

    Highlights run over bars 5 to 7 of every 8, bar lines are hidden from 2 to 3 of every
    5, every 7th bar is in 3/4, and every 6th bar changes the tempo at half its length.
    """
    b = F.col("bar")
    half = (F.length("notes") / 2).cast("int")
    nl = F.lit("\n")
    tempo = (5 + b % 3).cast("string")

    def when(condition, text):
        return F.when(condition, F.concat(F.lit(text), nl)).otherwise("")

    split_notes = F.concat(
        F.substring("notes", 1, half), nl, F.lit("#BPMCHANGE "), tempo, nl, F.expr("substring(notes, int(length(notes) / 2) + 1)")
    )
    line = F.concat(
        when(b % 8 == 5, "#GOGOSTART"),
        when(b % 5 == 2, "#BARLINEOFF"),
        when(b % 5 == 3, "#BARLINEON"),
        when(b % 7 == 3, "#MEASURE 3/4"),
        F.when(b % 6 == 1, split_notes).otherwise(F.col("notes")),
        F.lit(","),
        F.when(b % 4 == 0, F.lit(" // note")).otherwise(""),
        nl,
        when(b % 7 == 3, "#MEASURE 1/1"),
        when(b % 8 == 7, "#GOGOEND"),
    )
    rows = chart_bars(spark, sf_dir).withColumn("line", line)
    body = rows.groupBy("track").agg(
        F.array_sort(F.collect_list(F.struct("bar", "line", "balloon_counts"))).alias("rows")
    )
    last = F.element_at("rows", -1)["bar"]
    balloons = F.array_join(F.flatten(F.transform("rows", lambda r: r["balloon_counts"])).cast("array<string>"), ",")
    names = F.array(*[F.lit(c) for c in COURSES])
    return body.select(
        "track",
        F.element_at(names, (F.pmod(F.col("track"), F.lit(4)) + 1).cast("int")).alias("course"),
        (F.pmod(F.col("track"), F.lit(10)) + 1).cast("int").alias("level"),
        balloons.alias("balloons"),
        F.concat(
            F.array_join(F.transform("rows", lambda r: r["line"]), ""),
            F.when(last % 8 >= 5, F.when(last % 8 < 7, F.lit("#GOGOEND\n")).otherwise("")).otherwise(""),
        ).alias("body"),
    )


def _block():
    return F.concat(
        F.lit("COURSE:"), F.col("course"), F.lit("\nLEVEL:"), F.col("level").cast("string"),
        F.lit("\nBALLOON:"), F.col("balloons"), F.lit("\n#START\n"), F.col("body"), F.lit("#END\n"),
    )


def chart_files(spark, sf_dir):
    """Files of up to four courses: source_id, text."""
    blocks = _course_texts(spark, sf_dir).select(F.floor(F.col("track") / 4).alias("source_id"), "track", _block().alias("block"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("track", "block"))), lambda x: x["block"]), "\n")
    return blocks.groupBy("source_id").agg(
        F.concat(F.lit("TITLE:chart\nBPM:5\nWAVE:a.ogg\nOFFSET:-1.5\n"), text).alias("text")
    )


cte(
    "expected_bars",
    """SELECT source_id, course, level, track, bar, notes, res AS resolution,
  CASE WHEN bar % 7 = 3 THEN '3/4' ELSE '1/1' END AS measure_ratio, bar % 8 >= 5 AS gogo, bar % 5 <> 2 AS barline_visible,
  CASE WHEN bar % 6 = 1 THEN CAST(res / 2 AS INTEGER) END AS change_position, CASE WHEN bar % 6 = 1 THEN 5.0::DOUBLE + bar % 3 END AS change_bpm,
  coalesce(last_value(CASE WHEN bar % 6 = 1 THEN 5.0::DOUBLE + bar % 3 END IGNORE NULLS) OVER (PARTITION BY track ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5.0::DOUBLE) AS bpm
FROM corpus""",
    "corpus",
)
cte(
    "ingested",
    """SELECT *, round_even(round_even(((e - d)) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS start_s, round_even(round_even((e) * 1000000000, 0) / 1000000000 * 1000000, 0) / 1000000 AS end_s FROM (
  SELECT *, 1.5::DOUBLE + sum(d) OVER (PARTITION BY track ORDER BY bar ROWS UNBOUNDED PRECEDING) AS e FROM (
    SELECT *, CASE WHEN measure_ratio = '3/4' THEN 3.0::DOUBLE ELSE 4.0::DOUBLE END * 60 *
      CASE WHEN change_bpm IS NULL THEN 1 / bpm ELSE 0.5::DOUBLE / bpm + 0.5::DOUBLE / change_bpm END AS d FROM expected_bars))""",
    "expected_bars",
)


@plan(
    "chart_ingest",
    """
    SELECT i.source_id, i.course, i.level, i.bar, i.notes, i.resolution, i.start_s, i.end_s, i.bpm, i.change_position, i.change_bpm, i.measure_ratio,
      i.gogo, i.barline_visible, coalesce((SELECT string_agg((n.tick + n.q) % 7 + 1, ',' ORDER BY n.pos) FROM nt n WHERE n.track = i.track AND n.bar = i.bar AND n.note = '7'), '') AS balloon_counts
    FROM ingested i
    """,
    ("ingested", "nt"),
)
def chart_ingest(spark, sf_dir):
    bars = chart_text.ingest(chart_files(spark, sf_dir)).bars
    change = F.try_element_at("tempo_changes", F.lit(1))
    return bars.select(
        "source_id",
        "course",
        "level",
        F.col("bar").cast("int").alias("bar"),
        "notes",
        "resolution",
        "start_s",
        "end_s",
        "bpm",
        change["position"].alias("change_position"),
        change["bpm"].alias("change_bpm"),
        "measure_ratio",
        "gogo",
        "barline_visible",
        F.array_join(F.col("balloon_counts").cast("array<string>"), ",").alias("balloon_counts"),
    )


# One defect per file: the text put in place of a marker, and the code it must give.
DEFECTS = (
    ("none", ""),
    ("course", "missing-course"),
    ("bpm", "invalid-bpm"),
    ("offset", "invalid-offset"),
    ("level", "invalid-level"),
    ("balloon", "invalid-balloon-count"),
    ("header", "invalid-metadata"),
    ("outside", "unexpected-command"),
    ("open_bar", "unclosed-bar"),
    ("open_gogo", "unclosed-gogo"),
    ("no_end", "unclosed-chart"),
    ("nested_gogo", "nested-gogo"),
    ("nested_chart", "nested-chart"),
    ("orphan_gogo", "orphan-gogo-end"),
    ("empty_bar", "empty-bar"),
    ("inside", "command-inside-bar"),
    ("branch", "unsupported-command"),
    ("character", "unsupported-note-character"),
    ("more_balloons", "balloon-count-mismatch"),
    ("no_chart", "missing-chart"),
    ("argument", "missing-command-argument"),
    ("measure", "invalid-measure"),
)


def defect_files(spark, sf_dir):
    """One file per track; the track number chooses the defect."""
    kind = F.element_at(
        F.array(*[F.lit(name) for name, _ in DEFECTS]), (F.pmod(F.col("track"), F.lit(len(DEFECTS))) + 1).cast("int")
    )
    rows = _course_texts(spark, sf_dir).withColumn("kind", kind)

    def put(name, text, normal=""):
        return F.when(F.col("kind") == name, F.lit(text)).otherwise(normal if not isinstance(normal, str) else F.lit(normal))

    text = F.concat(
        F.lit("TITLE:x\nBPM:"), put("bpm", "fast", "5"), F.lit("\nOFFSET:"), put("offset", "late", "0"),
        put("header", "\nno colon here"), put("outside", "\n#GOGOSTART"),
        F.lit("\nCOURSE:"), put("course", "", F.col("course")), F.lit("\nLEVEL:"), put("level", "high", F.col("level").cast("string")),
        F.lit("\nBALLOON:"), put("balloon", "3,0,2", F.col("balloons")), put("no_chart", "\nEND:", "\n#START"), F.lit("\n"),
        put("nested_gogo", "#GOGOSTART\n#GOGOSTART\n"), put("nested_chart", "#START\n"), put("orphan_gogo", "#GOGOEND\n"),
        put("empty_bar", "00,,\n"), put("inside", "10\n#MEASURE 3/4\n"), put("branch", "#BRANCHSTART p,1,2\n"),
        put("character", "10x0,\n"), put("more_balloons", "7008,7008,7008,\n" * 40), put("argument", "#BPMCHANGE\n"), put("measure", "#MEASURE 3:4\n"),
        F.when(F.col("kind") == "no_chart", F.lit("")).otherwise(F.col("body")),
        put("open_bar", "1010\n"), put("open_gogo", "#GOGOSTART\n"),
        F.when(F.col("kind").isin("no_end", "no_chart"), F.lit("")).otherwise(F.lit("#END\n")),
    )
    return rows.select(F.col("track").alias("source_id"), text.alias("text"))


@plan(
    "chart_quarantine",
    "SELECT track AS source_id, CASE track % {n} {cases} END AS code FROM (SELECT DISTINCT track FROM ln) WHERE track % {n} <> 0".format(
        n=len(DEFECTS), cases=" ".join(f"WHEN {i} THEN '{code}'" for i, (_, code) in enumerate(DEFECTS))
    ),
    ("ln",),
)
def chart_quarantine(spark, sf_dir):
    return chart_text.ingest(defect_files(spark, sf_dir)).errors.select("source_id", "code")


@plan(
    "chart_render",
    """
    WITH b AS (SELECT track, bar, notes, CASE WHEN bar % 9 IN (4, 5) THEN '3/4' ELSE '1/1' END AS m FROM chart),
    l AS (SELECT *, lag(m, 1, '1/1') OVER (PARTITION BY track ORDER BY bar) AS pm, row_number() OVER (PARTITION BY track ORDER BY bar DESC) AS r FROM b),
    t AS (SELECT track, string_agg(CASE WHEN m <> pm THEN '#MEASURE ' || m || chr(10) ELSE '' END || notes || ',', chr(10) ORDER BY bar) AS body, max(CASE WHEN r = 1 THEN m END) AS lm FROM l GROUP BY track),
    k AS (SELECT track, string_agg((tick + q) % 7 + 1, ',' ORDER BY bar, pos) AS bl FROM nt WHERE note = '7' GROUP BY track)
    SELECT t.track, 'TITLE:track ' || t.track || chr(10) || CASE WHEN t.track % 2 = 0 THEN 'SUBTITLE:-- nobody' || chr(10) ELSE '' END || 'BPM:5.0' || chr(10) || 'WAVE:a.ogg' || chr(10)
      || 'OFFSET:' || CASE WHEN t.track % 3 = 0 THEN '0.0' ELSE '-1.5' END || chr(10) || 'COURSE:Oni' || chr(10) || 'LEVEL:' || (t.track % 10 + 1) || chr(10) || 'MAKER:pulsegrid' || chr(10)
      || coalesce('BALLOON:' || bl || chr(10), '') || chr(10) || '#START' || chr(10) || body || chr(10) || CASE WHEN lm <> '1/1' THEN '#MEASURE 1/1' || chr(10) ELSE '' END || '#END' || chr(10) AS text
    FROM t LEFT JOIN k USING (track)
    """,
    ("chart", "nt"),
)
def chart_render(spark, sf_dir):
    bars = chart_bars(spark, sf_dir).withColumn(
        "measure_ratio", F.when((F.col("bar") % 9).isin(4, 5), "3/4").otherwise("1/1")
    )
    heads = bars.select("track").distinct().select(
        "track",
        F.concat(F.lit("track "), F.col("track")).alias("title"),
        F.when(F.col("track") % 2 == 0, "nobody").alias("artist"),
        F.lit(5.0).alias("bpm"),
        F.lit("a.ogg").alias("wave"),
        F.when(F.col("track") % 3 == 0, 0.0).otherwise(1.5).alias("offset"),
        F.lit("Oni").alias("course"),
        (F.col("track") % 10 + 1).alias("level"),
        F.lit("pulsegrid").alias("maker"),
    )
    return chart_text.render(heads, bars, ["track"])


@plan(
    "text_issues",
    """
    SELECT source_id, level, code, detail, count(*) AS n FROM (
      SELECT track AS source_id, 'error' AS level, 'missing-header' AS code, 'WAVE:' AS detail FROM (SELECT DISTINCT track FROM ln)
      UNION ALL SELECT track, 'error', 'missing-header', 'LEVEL:' FROM (SELECT DISTINCT track FROM ln) WHERE track % 22 = -1
      UNION ALL SELECT track, 'error', CASE WHEN track % 22 IN (19) THEN 'missing-start' END, '' FROM (SELECT DISTINCT track FROM ln) WHERE track % 22 = 19
      UNION ALL SELECT track, 'error', 'missing-end', '' FROM (SELECT DISTINCT track FROM ln) WHERE track % 22 IN (10, 19)) GROUP BY ALL
    """,
    ("ln",),
)
def text_issues(spark, sf_dir):
    found = chart_text.text_issues(defect_files(spark, sf_dir))
    heads = found.filter(F.col("code").isin("missing-header", "missing-start", "missing-end"))
    return heads.groupBy("source_id", "level", "code", "detail").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "text_line_issues",
    """
    WITH v AS (SELECT track, bar, CASE track % 22 WHEN 10 THEN false WHEN 19 THEN false ELSE true END AS ok FROM bars),
    x AS (SELECT track, 'error' AS level, 'invalid-characters' AS code FROM v WHERE ok AND bar % 8 = 5 UNION ALL SELECT track, 'warning', 'missing-comma' FROM v WHERE ok AND bar % 8 = 5
      UNION ALL SELECT track, 'error', 'invalid-characters' FROM v WHERE ok AND bar % 8 = 7 UNION ALL SELECT track, 'warning', 'missing-comma' FROM v WHERE ok AND bar % 8 = 7
      UNION ALL SELECT track, 'error', 'invalid-characters' FROM v WHERE ok AND bar % 5 IN (2, 3) UNION ALL SELECT track, 'warning', 'missing-comma' FROM v WHERE ok AND bar % 5 IN (2, 3)
      UNION ALL SELECT track, 'error', 'invalid-characters' FROM v WHERE ok AND bar % 6 = 1 UNION ALL SELECT track, 'warning', 'missing-comma' FROM v WHERE ok AND bar % 6 = 1
      UNION ALL SELECT track, 'warning', 'missing-comma' FROM v WHERE ok AND bar % 6 = 1
      UNION ALL SELECT track, 'error', 'invalid-characters' FROM v WHERE ok AND bar % 4 = 0 UNION ALL SELECT track, 'warning', 'missing-comma' FROM v WHERE ok AND bar % 4 = 0
      UNION ALL SELECT track, l, c FROM (SELECT track, max(bar) % 8 AS m FROM v WHERE ok GROUP BY track), (VALUES ('error', 'invalid-characters'), ('warning', 'missing-comma')) y(l, c) WHERE m IN (5, 6)
      UNION ALL SELECT track, l, c FROM (SELECT track, CASE track % 22 WHEN 11 THEN 2 WHEN 12 THEN 1 WHEN 13 THEN 1 WHEN 16 THEN 1 WHEN 20 THEN 1 WHEN 9 THEN 1 ELSE 0 END AS k FROM (SELECT DISTINCT track FROM ln)),
        (VALUES ('error', 'invalid-characters'), ('warning', 'missing-comma')) y(l, c), range(0, k)
      UNION ALL SELECT track, 'warning', 'missing-comma' FROM (SELECT DISTINCT track FROM ln) WHERE track % 22 IN (8, 15)
      UNION ALL SELECT track, 'error', 'measure-ratio' FROM (SELECT DISTINCT track FROM ln) WHERE track % 22 = 21)
    SELECT track AS source_id, level, code, count(*) AS n FROM x GROUP BY ALL
    """,
    ("bars", "ln"),
)
def text_line_issues(spark, sf_dir):
    found = chart_text.text_issues(defect_files(spark, sf_dir)).filter(F.col("line_no").isNotNull())
    return found.groupBy("source_id", "level", "code").agg(F.count(F.lit(1)).alias("n"))
