"""Chart text in and out.

A chart file is one row; its lines are numbered and every running state (course header,
tempo, measure, highlight, bar line, open bar) is a window over the lines of that file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.numeric import round_half_even

# Headers, commands and characters of the chart text format.
COURSE_KEYS = ("LEVEL", "BALLOON", "SCOREINIT", "SCOREDIFF")
UNSUPPORTED_COMMANDS = ("#N", "#E", "#M")
UNSUPPORTED_PREFIXES = ("#BRANCHSTART", "#BRANCHEND", "#DELAY", "#SCROLL")
REQUIRED_HEADERS = ("TITLE:", "BPM:", "WAVE:", "OFFSET:", "COURSE:", "LEVEL:")
MEASURE_RATIOS = ("1/1", "3/4")


def piecewise_duration(resolution: Column, quarters: Column, start_bpm: Column, changes: Column) -> Column:
    """Seconds of a bar whose tempo changes at the given slot positions (array of position, bpm)."""
    start = F.struct(F.lit(0).alias("at"), start_bpm.cast("double").alias("bpm"), F.lit(0.0).alias("seconds"))

    def step(acc: Column, change: Column) -> Column:
        at = F.least(resolution, F.greatest(acc["at"], change["position"]))
        part = quarters * (at - acc["at"]) / resolution * 60.0 / acc["bpm"]
        return F.struct(
            at.alias("at"), change["bpm"].cast("double").alias("bpm"), (acc["seconds"] + part).alias("seconds")
        )

    return F.aggregate(
        changes,
        start,
        step,
        lambda acc: acc["seconds"] + quarters * (resolution - acc["at"]) / resolution * 60.0 / acc["bpm"],
    )


@dataclass(frozen=True)
class Ingested:
    """Bars of the good files and one error row per bad file."""

    bars: DataFrame
    errors: DataFrame


def number_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """source_id, line_no (from 1), raw line."""
    parts = F.split(F.regexp_replace(text, r"\r\n?|\x0b|\x0c|\x85|\u2028|\u2029", "\n"), "\n")
    # A final line break does not open another line.
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    lines = files.select("source_id", F.posexplode(parts).alias("_i", "raw"))
    return lines.select("source_id", (F.col("_i") + 1).alias("line_no"), "raw")


def _starts(column: Column, *prefixes: str) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | column.startswith(prefix)
    return found


def _number(text: Column) -> Column:
    return text.try_cast("double")


def line_states(lines: DataFrame) -> DataFrame:
    """Classify the lines and attach the running state before each of them."""
    line = F.trim(F.substring_index("raw", "//", 1))
    base = lines.withColumn("line", line).filter(F.col("line") != "").withColumn("up", F.upper("line"))
    up = F.col("up")
    by_file = Window.partitionBy("source_id").orderBy("line_no")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)

    def running(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)).over(before), F.lit(0))

    starts, ends = _starts(up, "#START"), _starts(up, "#END")
    scoped = base.select(
        "*", running(starts).alias("chart_no"), (running(starts) > running(ends)).alias("in_chart")
    )
    inside = F.col("in_chart")
    command = _starts(up, "#")
    header = ~inside & ~command & F.col("line").contains(":")
    key = F.upper(F.trim(F.substring_index("line", ":", 1)))
    value = F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    kind = (
        F.when(header, "header")
        .when(~inside & ~command, "text")
        .when(~inside & starts, "start")
        .when(~inside, "command")
        .when(ends, "end")
        .when(command, "command")
        .otherwise("notes")
    )
    typed = scoped.select(
        "*", kind.alias("kind"), F.when(header, key).alias("key"), F.when(header, value).alias("value")
    )

    def header_value(name: str, per_course: bool) -> Column:
        mine = F.when(F.col("key") == name, F.col("value"))
        if not per_course:
            return F.last(mine, ignorenulls=True).over(before)
        # A new COURSE line clears the values of the course before it.
        cleared = F.when(F.col("key") == "COURSE", F.lit("")).otherwise(mine)
        return F.last(cleared, ignorenulls=True).over(before)

    headed = typed.select(
        "*",
        header_value("BPM", False).alias("h_bpm"),
        header_value("OFFSET", False).alias("h_offset"),
        F.last(F.when(F.col("key") == "COURSE", F.col("value")), ignorenulls=True).over(before).alias("h_course"),
        header_value("LEVEL", True).alias("h_level"),
        header_value("BALLOON", True).alias("h_balloon"),
    )
    notes = F.col("kind") == "notes"
    argument = F.trim(F.regexp_extract("line", r"^\S+\s+(.*)$", 1))
    body = F.regexp_replace("line", r"\s", "")
    cells = F.when(notes, F.split(body, ","))
    commas = F.when(notes, F.size(cells) - 1).otherwise(0)
    opened = F.col("kind") == "start"
    prepared = headed.select(
        "*",
        F.when(F.col("kind") == "command", argument).alias("arg"),
        cells.alias("cells"),
        commas.alias("commas"),
        F.when(opened, 1).otherwise(0).alias("_opens"),
    )
    # Header values as they stand at the #START of the chart.
    chart = Window.partitionBy("source_id", "chart_no").orderBy("line_no")
    prior = chart.rowsBetween(Window.unboundedPreceding, -1)
    restarted = prepared.withColumn("chart_no", F.col("chart_no") + F.col("_opens"))
    at_start = {
        name: F.first(F.when(F.col("kind") == "start", F.col(f"h_{name}")), ignorenulls=True).over(
            chart.rowsBetween(Window.unboundedPreceding, 0)
        )
        for name in ("bpm", "offset", "course", "level", "balloon")
    }
    bound = restarted.select(
        "*", *[expr.alias(name) for name, expr in at_start.items()]
    )
    tempo = F.when(_starts(F.col("up"), "#BPMCHANGE"), _number(F.col("arg")))
    closes = F.col("commas") > 0
    tail = F.length(F.element_at("cells", -1))
    staged = bound.select(
        "*",
        F.coalesce(F.last(tempo, ignorenulls=True).over(prior), _number(F.col("bpm"))).alias("bpm_before"),
        F.coalesce(
            F.last(F.when(_starts(F.col("up"), "#MEASURE") & (F.col("kind") == "command"), F.col("arg")), ignorenulls=True).over(prior),
            F.lit("1/1"),
        ).alias("measure"),
        F.coalesce(
            F.last(
                F.when(F.col("up") == "#GOGOSTART", True).when(F.col("up") == "#GOGOEND", False), ignorenulls=True
            ).over(prior),
            F.lit(False),
        ).alias("gogo"),
        F.coalesce(
            F.last(
                F.when(F.col("up") == "#BARLINEON", True).when(F.col("up") == "#BARLINEOFF", False), ignorenulls=True
            ).over(prior),
            F.lit(True),
        ).alias("barline"),
        F.coalesce(F.sum("commas").over(prior), F.lit(0)).alias("bars_before"),
        F.when(notes, F.when(closes, tail).otherwise(F.length(body))).otherwise(0).alias("_adds"),
    )
    # Length of the open bar: characters since the last line that closed one.
    within = Window.partitionBy("source_id", "chart_no", "bars_before").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    closed_tail = F.coalesce(F.last(F.when(closes, tail), ignorenulls=True).over(prior), F.lit(0))
    return staged.select(
        "*", (F.coalesce(F.sum("_adds").over(within), F.lit(0)) + closed_tail).alias("pending")
    ).drop("_adds", "_opens")


def measure_quarters(ratio_text: Column) -> Column:
    """4·num/den of a 'num/den' text; null when it is no positive ratio."""
    num = F.substring_index(ratio_text, "/", 1).try_cast("double")
    den = F.expr("try_cast(nullif(substring_index(measure_text, '/', -1), measure_text) AS DOUBLE)")
    return F.when((num > 0) & (den > 0), 4.0 * num / den)


def ingest(files: DataFrame) -> Ingested:
    """Parse chart files (source_id, text) into bars; files with an error give one error row."""
    states = line_states(number_lines(files))
    place = ["source_id", "chart_no"]
    cells = states.filter(F.col("kind") == "notes").select(
        *place,
        "line_no",
        "bpm_before",
        "measure",
        "gogo",
        "barline",
        "balloon",
        "bars_before",
        "commas",
        F.posexplode("cells").alias("cell", "part"),
    )
    parts = cells.select(
        "*", (F.col("bars_before") + F.col("cell")).alias("bar"), (F.col("cell") < F.col("commas")).alias("closing")
    )
    piece = F.struct("line_no", "part")
    closing_place = F.when(F.col("closing"), F.col("line_no"))
    assembled = parts.groupBy(*place, "bar").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["part"]), "").alias("notes"),
        F.max("closing").alias("closed"),
        F.max(closing_place).alias("line_no"),
        F.min_by("bpm_before", F.when(F.col("part") != "", F.col("line_no"))).alias("start_bpm"),
        F.max_by("measure", closing_place).alias("measure"),
        F.max_by("gogo", closing_place).alias("gogo"),
        F.max_by("barline", closing_place).alias("barline"),
        F.max("balloon").alias("balloon"),
    )
    splits = (
        states.filter((F.col("kind") == "command") & F.col("in_chart") & _starts(F.col("up"), "#BPMCHANGE"))
        .filter(F.col("pending") > 0)
        .groupBy(*place, F.col("bars_before").alias("bar"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct("line_no", F.col("pending").cast("int").alias("position"), _number(F.col("arg")).alias("bpm")))
            ).alias("c")
        )
        .select(
            *place,
            "bar",
            F.transform("c", lambda x: F.struct(x["position"].alias("position"), x["bpm"].alias("bpm"))).alias("tempo_changes"),
        )
    )
    none = F.array().cast("array<struct<position:int,bpm:double>>")
    complete = assembled.filter("closed").join(splits, [*place, "bar"], "left")
    used = F.length("notes") - F.length(F.translate("notes", "79", ""))
    by_bar = Window.partitionBy(*place).orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.when(F.trim(F.coalesce("balloon", F.lit(""))) == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split("balloon", ","), lambda x: F.trim(x).try_cast("int"))
    )
    timed = (
        complete.withColumn("tempo_changes", F.coalesce("tempo_changes", none))
        .withColumn("measure_text", F.col("measure"))
        .withColumn("quarters", measure_quarters(F.col("measure")))
        .withColumn("used", used)
        .withColumn("counts", counts)
        .withColumn("used_before", F.coalesce(F.sum("used").over(by_bar), F.lit(0)))
    )
    timed = timed.withColumn(
        "duration", piecewise_duration(F.length("notes"), F.col("quarters"), F.col("start_bpm"), F.col("tempo_changes"))
    )
    errors = _errors(states, timed, files)
    good = timed.join(errors.select("source_id"), "source_id", "left_anti")
    heads = states.filter(F.col("kind") == "start").select(
        *place,
        F.col("h_course").alias("course"),
        F.floor(_number(F.col("h_level"))).cast("int").alias("level"),
        (-_number(F.coalesce("h_offset", F.lit("0")))).alias("origin"),
    )
    elapsed = F.coalesce(F.sum("duration").over(by_bar), F.lit(0.0))
    bars = good.withColumn("_elapsed", elapsed).join(heads, place)
    start = F.col("origin") + F.col("_elapsed")
    return Ingested(
        bars.select(
            "source_id",
            "chart_no",
            "course",
            "level",
            "bar",
            "notes",
            F.length("notes").alias("resolution"),
            round_half_even(start, 6).alias("start_s"),
            round_half_even(start + F.col("duration"), 6).alias("end_s"),
            F.col("start_bpm").alias("bpm"),
            "tempo_changes",
            F.col("measure").alias("measure_ratio"),
            "gogo",
            F.col("barline").alias("barline_visible"),
            F.slice("counts", F.col("used_before").cast("int") + 1, F.col("used")).alias("balloon_counts"),
        ),
        errors,
    )


def _bad_float(text: Column) -> Column:
    return _number(text).isNull()


def _errors(states: DataFrame, bars: DataFrame, files: DataFrame) -> DataFrame:
    """First failing line of each file with its code: source_id, line_no, code."""
    up, arg, kind = F.col("up"), F.col("arg"), F.col("kind")
    bad_bpm = ~F.coalesce(_number(F.col("h_bpm")) > 0, F.lit(False))
    level = _number(F.coalesce("h_level", F.lit("")))
    balloon_text = F.trim(F.coalesce("h_balloon", F.lit("")))
    bad_balloon = (balloon_text != "") & ~balloon_text.rlike(r"^\s*\+?0*[1-9]\d*\s*(,\s*\+?0*[1-9]\d*\s*)*$")
    at_start = (
        F.when(bad_bpm, "invalid-bpm")
        .when(F.coalesce(F.col("h_course"), F.lit("")) == "", "missing-course")
        .when(level.isNull() | (F.signum(level) * F.floor(F.abs(level)) < 0), "invalid-level")
        .when(bad_balloon, "invalid-balloon-count")
        .when(_bad_float(F.coalesce("h_offset", F.lit("0"))), "invalid-offset")
    )
    chart_used = bars.groupBy("source_id", "chart_no").agg(F.sum("used").alias("_used"))
    expected = F.when(F.trim(F.coalesce("balloon", F.lit(""))) == "", 0).otherwise(F.size(F.split("balloon", ",")))
    at_end = (
        F.when(F.col("pending") > 0, "unclosed-bar")
        .when(F.col("gogo"), "unclosed-gogo")
        .when(F.coalesce("_used", F.lit(0)) != expected, "balloon-count-mismatch")
    )
    tempo, measure = _starts(up, "#BPMCHANGE"), _starts(up, "#MEASURE")
    refused = up.isin(*UNSUPPORTED_COMMANDS) | _starts(up, *UNSUPPORTED_PREFIXES)
    at_command = (
        F.when(~F.col("in_chart"), "unexpected-command")
        .when(refused, "unsupported-command")
        .when(tempo & (arg == ""), "missing-command-argument")
        .when(tempo & ~F.coalesce(_number(arg) > 0, F.lit(False)), "invalid-bpm")
        .when(tempo, None)
        .when(F.col("pending") > 0, "command-inside-bar")
        .when(measure & (arg == ""), "missing-command-argument")
        .when(measure & F.col("quarters").isNull(), "invalid-measure")
        .when(measure, None)
        .when((up == "#GOGOSTART") & F.col("gogo"), "nested-gogo")
        .when((up == "#GOGOEND") & ~F.col("gogo"), "orphan-gogo-end")
        .when(up.isin("#GOGOSTART", "#GOGOEND", "#BARLINEON", "#BARLINEOFF"), None)
        .when(_starts(up, "#START"), "nested-chart")
        .otherwise("unsupported-command")
    )
    code = (
        F.when(kind == "start", at_start)
        .when(kind == "end", at_end)
        .when(kind == "command", at_command)
        .when(kind == "text", "invalid-metadata")
    )
    with_used = (
        states.withColumn("measure_text", F.coalesce("arg", F.lit("")))
        .withColumn("quarters", measure_quarters(F.col("measure_text")))
        .join(chart_used, ["source_id", "chart_no"], "left")
    )
    line_errors = with_used.select("source_id", "line_no", F.lit(0).alias("_bar"), code.alias("code"))
    bar_code = (
        F.when(F.col("notes") == "", "empty-bar")
        .when(F.col("notes").rlike("[^0-9]"), "unsupported-note-character")
        .when(F.col("used_before") + F.col("used") > F.size("counts"), "balloon-count-mismatch")
    )
    bar_errors = bars.select("source_id", "line_no", F.col("bar").alias("_bar"), bar_code.alias("code"))
    facts = states.groupBy("source_id").agg(
        F.sum(F.when(kind == "start", 1).otherwise(0)).alias("_starts"),
        F.sum(F.when(kind == "end", 1).otherwise(0)).alias("_ends"),
    )
    # Files without any significant line have no state rows.
    sizes = number_lines(files).groupBy("source_id").agg(F.max("line_no").alias("_last"))
    whole = files.select("source_id").distinct().join(facts, "source_id", "left").join(sizes, "source_id", "left")
    opened, ended = F.coalesce("_starts", F.lit(0)), F.coalesce("_ends", F.lit(0))
    file_code = F.when(opened > ended, "unclosed-chart").when(ended == 0, "missing-chart")
    file_errors = whole.select(
        "source_id",
        F.greatest(F.lit(1), F.coalesce("_last", F.lit(1))).alias("line_no"),
        F.lit(1 << 30).alias("_bar"),
        file_code.alias("code"),
    )
    every = line_errors.unionByName(bar_errors).unionByName(file_errors).filter(F.col("code").isNotNull())
    first = F.min(F.struct("line_no", "_bar", "code")).alias("f")
    return every.groupBy("source_id").agg(first).select("source_id", "f.line_no", "f.code")


def render(charts: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """One text per chart: headers, bars with measure changes, balloons in order.

    ``charts`` holds title, artist, bpm, wave, offset, course, level and maker per key;
    ``bars`` holds bar, notes, measure_ratio and balloon_counts.
    """
    by_chart = Window.partitionBy(*keys).orderBy("bar")
    changed = bars.withColumn("_prev", F.coalesce(F.lag("measure_ratio").over(by_chart), F.lit("1/1")))
    head = F.when(
        F.col("measure_ratio") != F.col("_prev"), F.concat(F.lit("#MEASURE "), F.col("measure_ratio"), F.lit("\n"))
    ).otherwise("")
    lines = changed.withColumn("_line", F.concat(head, F.col("notes"), F.lit(",")))
    bodies = lines.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bar", "_line", "balloon_counts", "measure_ratio"))).alias("_rows")
    )
    balloons = F.flatten(F.transform("_rows", lambda r: r["balloon_counts"]))
    closing = F.when(F.element_at("_rows", -1)["measure_ratio"] != "1/1", F.lit("#MEASURE 1/1"))
    offset = F.when(F.col("offset") == 0, F.lit(0.0)).otherwise(-F.col("offset"))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}:"), value.cast("string"))

    parts = F.array(
        header("TITLE", F.col("title")),
        F.when(F.coalesce("artist", F.lit("")) != "", F.concat(F.lit("SUBTITLE:-- "), F.col("artist"))),
        header("BPM", F.col("bpm")),
        header("WAVE", F.col("wave")),
        header("OFFSET", offset),
        header("COURSE", F.col("course")),
        header("LEVEL", F.col("level")),
        header("MAKER", F.col("maker")),
        F.when(F.size(balloons) > 0, header("BALLOON", F.array_join(balloons.cast("array<string>"), ","))),
        F.lit(""),
        F.lit("#START"),
        F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n"),
        closing,
        F.lit("#END"),
    )
    joined = F.concat(F.array_join(parts, "\n"), F.lit("\n"))
    return charts.join(bodies, keys).select(*keys, joined.alias("text"))


def text_issues(files: DataFrame) -> DataFrame:
    """Text-level findings: required headers, block order, characters, commas, measures."""
    lines = number_lines(files)
    stripped = F.trim("raw")
    marks = lines.groupBy("source_id").agg(
        *[F.bool_or(F.col("raw").startswith(h)).alias(f"_h{i}") for i, h in enumerate(REQUIRED_HEADERS)],
        F.min(F.when(stripped == "#START", F.col("line_no"))).alias("_start"),
        F.min(F.when(stripped == "#END", F.col("line_no"))).alias("_end"),
    )
    marks = files.select("source_id").distinct().join(marks, "source_id", "left")
    nowhere = F.lit(None).cast("int")

    def finding(condition: Column, level: str, code: str, line: Column, detail: str = "") -> Column:
        return F.when(
            condition,
            F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), line.alias("line_no"), F.lit(detail).alias("detail")),
        )

    found = [
        finding(~F.coalesce(F.col(f"_h{i}"), F.lit(False)), "error", "missing-header", nowhere, h)
        for i, h in enumerate(REQUIRED_HEADERS)
    ]
    found += [
        finding(F.col("_start").isNull(), "error", "missing-start", nowhere),
        finding(F.col("_end").isNull(), "error", "missing-end", nowhere),
        finding(F.col("_start") >= F.col("_end"), "error", "start-after-end", F.col("_start")),
    ]
    per_file = marks.select("source_id", F.inline(F.array_compact(F.array(*found))))
    bounds = marks.filter(F.col("_start") < F.col("_end")).select("source_id", "_start", "_end")
    body = lines.join(bounds, "source_id").filter(
        (F.col("line_no") > F.col("_start")) & (F.col("line_no") < F.col("_end")) & (stripped != "")
    )
    measure = stripped.startswith("#MEASURE")
    words = F.split(stripped, r"\s+")
    shape = (F.size(words) != 2) | (F.element_at(words, 1) != "#MEASURE")
    bad_ratio = ~shape & ~F.try_element_at(words, F.lit(2)).isin(*MEASURE_RATIOS)
    here = F.col("line_no").cast("int")
    line_found = [
        finding(measure & shape, "error", "measure-shape", here),
        finding(measure & F.coalesce(bad_ratio, F.lit(False)), "error", "measure-ratio", here),
        finding(~measure & stripped.rlike("[^0-9A-Za-z, \\t]"), "error", "invalid-characters", here),
        finding(~measure & ~stripped.endswith(","), "warning", "missing-comma", here),
    ]
    per_line = body.select("source_id", F.inline(F.array_compact(F.array(*line_found))))
    return per_file.unionByName(per_line)
