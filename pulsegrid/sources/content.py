"""File listings, decoding, encodability, and tolerant JSON readers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Audio suffixes, persisted keys that must not appear, dropped secrets.
AUDIO_SUFFIXES = ("aac", "flac", "m4a", "mp3", "ogg", "opus", "wav")
FORBIDDEN_KEYS = ("api_key", "artist", "base_url", "input_audio", "output_dir", "title", "wave")
SECRET_FIELDS = ("ai_base_url", "ai_api_key")
CHARSET = "windows-31j"


@contextmanager
def lenient_charsets(spark: SparkSession):
    """Allow the Shift-JIS charset, and replacement characters instead of errors, while expressions are built."""
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "true")
        yield
    finally:
        for n, value in before.items():
            if value is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, value)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, stem and suffix of the files in a folder; contents are not read."""
    paths = spark.read.format("binaryFile").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return paths.select(
        "path",
        name.alias("name"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"),
    )


def unpaired_charts(files: DataFrame, chart_suffix: str = "tja") -> DataFrame:
    """Charts without an audio file of the same case-folded stem; an empty corpus gives one error row."""
    charts = files.filter(F.col("suffix") == chart_suffix)
    audio = files.filter(F.col("suffix").isin(*AUDIO_SUFFIXES)).select(F.lower("stem").alias("_stem")).distinct()
    missing = charts.withColumn("_stem", F.lower("stem")).join(audio, "_stem", "left_anti")
    empty = charts.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("").alias("name"), F.lit("no-charts").alias("code")
    )
    return missing.select("name", F.lit("missing-audio").alias("code")).unionByName(empty)


def decode_files(spark: SparkSession, files: DataFrame, content: str = "content") -> DataFrame:
    """Text, content id, encoding and error code of binary contents: UTF-8 first, then Shift-JIS."""
    with lenient_charsets(spark):
        raw = F.col(content)
        as_text = raw.cast("string")
        utf8 = F.is_valid_utf8(as_text)
        shift = F.decode(raw, CHARSET)
        readable = ~F.contains(shift, F.lit("\ufffd"))
        text = F.when(utf8, F.regexp_replace(as_text, "^\ufeff", "")).when(readable, shift)
        encoding = F.when(utf8, "utf-8").when(readable, "cp932")
        return files.select(
            *[c for c in files.columns if c != content],
            F.substring(F.sha2(raw, 256), 1, 16).alias("source_id"),
            text.alias("text"),
            encoding.alias("encoding"),
            F.when(encoding.isNull(), "decode-failed").alias("code"),
        )


def encode_audit(spark: SparkSession, texts: DataFrame, text: str = "text") -> DataFrame:
    """First character of each text that Shift-JIS cannot hold: line, column, code point.

    Only distinct non-ASCII characters of a text are tried, so nothing is exploded.
    """
    with lenient_charsets(spark):
        odd = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([^\x00-\x7F])"), 1))
        lost = F.filter(odd, lambda ch: F.decode(F.encode(ch, CHARSET), CHARSET) != ch)
        body = F.col(text)
        places = F.transform(lost, lambda ch: F.struct(F.instr(body, ch).alias("at"), ch.alias("ch")))
        rows = texts.select(*[c for c in texts.columns], F.array_min(places).alias("_first")).filter(
            F.col("_first").isNotNull()
        )
        before = F.expr(f"substring({text}, 1, _first.at - 1)")
        line = F.length(before) - F.length(F.translate(before, "\n", "")) + 1
        column = F.length(F.substring_index(before, "\n", -1)) + 1
        code = F.hex(F.expr("ascii(_first.ch)"))
        return rows.select(
            *[c for c in texts.columns if c != text],
            line.alias("line_no"),
            column.alias("column_no"),
            F.concat(F.lit("U+"), F.lpad(code, F.greatest(F.lit(4), F.length(code)), F.lit("0"))).alias("code_point"),
        )


GROUND_TRUTH = """fixture string, schema_version int, bpm double, time_signature string, duration double,
first_downbeat double, onsets array<double>, strong_onsets array<double>, beats array<double>, downbeats array<double>,
low_band_onsets array<double>, high_band_onsets array<double>, silent_ranges array<array<double>>, fill_ranges array<array<double>>,
sections array<struct<start:double,end:double,role:string>>"""


def read_ground_truth(documents: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, ranges, rejected) of ground-truth documents; those of another version than 1,
    and those that can't be read, are rejected with their fixture and version, if known.

    Sections are ranges of kind ``section:<role>``.
    """
    every = documents.select(F.from_json(column, GROUND_TRUTH).alias("d")).select("d.*")
    good = F.coalesce(F.col("schema_version") == 1, F.lit(False))
    parsed, rejected = every.filter(good), every.filter(~good).select("fixture", "schema_version")
    kinds = ("onsets", "strong_onsets", "beats", "downbeats", "low_band_onsets", "high_band_onsets")
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("times")) for k in kinds])
    events = parsed.select("fixture", F.inline(lists)).select("fixture", "kind", F.explode("times").alias("time_s"))
    spans = ("silent_ranges", "fill_ranges")
    none = F.array().cast("array<struct<kind:string,start_s:double,end_s:double>>")

    def named(kind: str) -> Column:
        made = F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s[0].alias("start_s"), s[1].alias("end_s")))
        return F.coalesce(made, none)

    role = F.transform(
        "sections",
        lambda s: F.struct(F.concat(F.lit("section:"), s["role"]).alias("kind"), s["start"].alias("start_s"), s["end"].alias("end_s")),
    )
    ranges = parsed.select("fixture", F.inline(F.concat(*[named(k) for k in spans], F.coalesce(role, none))))
    return events, ranges, rejected


ANALYSIS = """schema_version int, bpm double, onset_grids array<int>, onset_16 array<int>, accent_grids array<int>,
accent_16 array<int>, activity_grids array<double>, activity_16 array<double>, grids_per_bar int"""


def read_analysis(documents: DataFrame, keys: list[str], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of analysis documents: old names are mapped, a missing version is 1.

    Documents of another version are rejected; secrets of unversioned ones are dropped
    because only known fields are read.
    """
    parsed = documents.select(*keys, F.from_json(column, ANALYSIS).alias("d"), F.col(column).alias("_raw"))
    version = F.coalesce("d.schema_version", F.lit(1))
    known = parsed.filter(F.col("d").isNotNull() & (version == 1))
    old = F.col("d.onset_grids").isNull() & F.col("d.onset_16").isNotNull()
    rows = known.select(
        *keys,
        F.col("d.bpm").alias("bpm"),
        F.coalesce("d.grids_per_bar", F.when(old, 16).otherwise(48)).alias("grids_per_bar"),
        F.coalesce("d.onset_grids", "d.onset_16").alias("onset_grids"),
        F.coalesce("d.accent_grids", "d.accent_16").alias("accent_grids"),
        F.coalesce("d.activity_grids", "d.activity_16").alias("activity_grids"),
    )
    rejected = parsed.filter(F.col("d").isNull() | (version != 1)).select(*keys, version.alias("schema_version"))
    return rows, rejected


def scan_records(records: DataFrame, keys: list[str], allowed: DataFrame, column: str = "value") -> DataFrame:
    """Privacy findings per JSON record: forbidden keys, paths and URLs, unknown audio names.

    Objects and lists are read at every depth: a JSON text is its string tokens in order, one
    followed by a colon is a key, any other a string value, and one that a key "audio"
    stands directly before is an audio name. Escaped quotes are masked while the tokens are cut, so no
    nesting has to be followed. A record that is no JSON, or has no strings, has counts of 0.
    """
    slash, quote = F.lit("\x01"), F.lit("\x02")
    masked = F.replace(F.replace(F.col(column), F.lit("\\\\"), slash), F.lit('\\"'), quote)
    body = F.when(F.try_parse_json(column).isNotNull(), masked)
    found = records.select(
        *keys, F.posexplode_outer(F.regexp_extract_all(body, F.lit(r'([\[{,]?\s*"[^"]*"\s*:?)'), F.lit(1))).alias("_n", "_token")
    )
    token = F.col("_token")
    inner = F.regexp_extract(token, r'"([^"]*)"', 1)
    literal = F.concat(F.lit('["'), F.replace(F.replace(inner, quote, F.lit('\\"')), slash, F.lit("\\\\")), F.lit('"]'))
    tokens = found.select(
        *keys,
        F.from_json(literal, "array<string>")[0].alias("text"),
        token.endswith(":").alias("_key"),
        F.ltrim(token).startswith('"').alias("_direct"),
        F.when(token.isNotNull(), F.lag(F.lower(inner)).over(Window.partitionBy(*keys).orderBy("_n"))).alias("_before"),
    )
    value = F.col("text")
    local = value.rlike(r"^[A-Za-z]:[\\/]") | value.startswith("/") | value.startswith("\\\\")
    leaf, name = ~F.col("_key"), F.lower("text")
    audio = F.when(leaf & F.col("_direct") & (F.col("_before") == "audio"), value)
    known = allowed.select(F.col("name").alias("_audio"), F.lit(True).alias("_known")).distinct()
    judged = tokens.withColumn("_audio", audio).join(known, "_audio", "left")

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    return judged.groupBy(*keys).agg(
        count(leaf).alias("scanned_string_count"),
        count(F.col("_key") & name.isin(*FORBIDDEN_KEYS)).alias("forbidden_key_count"),
        count(leaf & (local | F.contains(value, F.lit("://")))).alias("forbidden_string_count"),
        count(F.col("_audio").isNotNull() & F.col("_known").isNull()).alias("unknown_audio_count"),
    )


def redact(rows: DataFrame, secret: str, columns: list[str], marker: str = "[REDACTED]") -> DataFrame:
    """Replace a known secret in text columns and in arrays of text."""
    kinds = dict(rows.dtypes)

    def cleaned(name: str) -> Column:
        if kinds[name] == "array<string>":
            return F.transform(name, lambda x: F.replace(x, F.lit(secret), F.lit(marker)))
        return F.replace(F.col(name), F.lit(secret), F.lit(marker))

    return rows.withColumns({n: cleaned(n) for n in columns}) if secret else rows
