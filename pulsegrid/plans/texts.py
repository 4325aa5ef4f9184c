"""Plans over documents and pages: decoding, audits, readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.plans.bindings import DAY, SECOND, chart_bars, table, timeline
from pulsegrid.plans.evidence import _r
from pulsegrid.plans.registry import plan
from pulsegrid.sources import content


@plan(
    "pair_check",
    "SELECT 'Song ' || doc_id || '.tja' AS name, 'missing-audio' AS code FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)",
)
def pair_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Song "), F.col("doc_id").cast("string")).alias("stem"), F.lit("tja").alias("suffix")
    )
    audio = table(spark, sf_dir, "labels").filter("quality = 1").select(
        F.concat(F.lit("SONG "), F.col("doc_id").cast("string")).alias("stem"), F.lit("ogg").alias("suffix")
    )
    files = docs.unionByName(audio).withColumn("name", F.concat_ws(".", "stem", "suffix"))
    return content.unpaired_charts(files)


@plan(
    "content_id",
    r"""
    WITH d AS (SELECT doc_id, doc_id % 10 AS k, text, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS a FROM documents)
    SELECT doc_id, substr(sha256(CASE WHEN k < 3 THEN '\xEF\xBB\xBF'::BLOB || encode(text) WHEN k = 7 THEN encode(text) || '\xFF'::BLOB WHEN k = 8 THEN '\x82\xA0'::BLOB || encode(a) ELSE encode(text) END), 1, 16) AS source_id,
      CASE WHEN k = 7 THEN NULL WHEN k = 8 THEN 'cp932' ELSE 'utf-8' END AS encoding, CASE WHEN k = 7 THEN 'decode-failed' END AS code,
      CASE WHEN k = 7 THEN NULL WHEN k = 8 THEN 1 + length(a) ELSE length(text) END::INTEGER AS n_chars FROM d
    """,
)
def content_id(spark, sf_dir):
    k = F.col("doc_id") % 10
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    raw = F.encode("text", "UTF-8")
    body = (
        F.when(k < 3, F.concat(F.unhex(F.lit("EFBBBF")), raw))
        .when(k == 7, F.concat(raw, F.unhex(F.lit("FF"))))
        .when(k == 8, F.concat(F.unhex(F.lit("82A0")), F.encode(plain, "UTF-8")))
        .otherwise(raw)
    )
    files = table(spark, sf_dir, "documents").select("doc_id", body.alias("content"))
    return content.decode_files(spark, files).select("doc_id", "source_id", "encoding", "code", F.length("text").alias("n_chars"))


@plan(
    "encode_audit",
    r"""
    WITH t AS (SELECT doc_id, 'かな ' || text || CASE WHEN doc_id % 5 = 0 THEN '😀' ELSE '' END AS text FROM documents),
    d AS (SELECT doc_id, text, regexp_extract(text, '^(?s:.*?)([^\x00-\x7Fかな])', 1) AS ch FROM t WHERE regexp_matches(text, '[^\x00-\x7Fかな]')),
    p AS (SELECT *, left(text, strpos(text, ch) - 1) AS pre FROM d)
    SELECT doc_id, (length(pre) - length(replace(pre, chr(10), '')) + 1)::INTEGER AS line_no, (length(list_last(string_split(pre, chr(10)))) + 1)::INTEGER AS column_no, 'U+' || lpad(upper(to_hex(unicode(ch))), greatest(4, length(to_hex(unicode(ch))))::INTEGER, '0') AS code_point FROM p
    """,
)
def encode_audit(spark, sf_dir):
    smile = F.when(F.col("doc_id") % 5 == 0, "😀").otherwise("")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("かな "), "text", smile).alias("text"))
    return content.encode_audit(spark, texts)


@plan(
    "privacy_scan",
    """
    SELECT page_id, 5::BIGINT AS scanned_string_count, 1::BIGINT AS forbidden_key_count, (1 + (page_id % 3 = 0)::INT + (url LIKE '%://%')::INT + (html LIKE '%://%' OR html LIKE '/%')::INT - 1)::BIGINT AS forbidden_string_count,
      (NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = page_id % 60))::BIGINT AS unknown_audio_count FROM pages
    """,
)
def privacy_scan(spark, sf_dir):
    page = F.col("page_id")
    path = F.when(page % 3 == 0, "C:\\music\\a.ogg").otherwise("a.ogg")
    record = F.to_json(
        F.struct(
            "url",
            "html",
            path.alias("file"),
            F.struct(
                F.concat(F.lit("x"), page.cast("string")).alias("Title"),
                F.concat(F.lit("item-"), (page % 60).cast("string")).alias("audio"),
            ).alias("meta"),
        )
    )
    records = table(spark, sf_dir, "pages").select("page_id", record.alias("value"))
    names = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("name"))
    return content.scan_records(records, ["page_id"], names)


@plan(
    "redact",
    "SELECT doc_id, sha256(replace(text, 'the', '[REDACTED]')) AS text_hash, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the')))::INTEGER AS redacted_lines FROM documents",
)
def redact(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n").alias("lines"))
    clean = content.redact(rows, "the", ["text", "lines"])
    marked = F.size(F.filter("lines", lambda x: F.contains(x, F.lit("[REDACTED]"))))
    return clean.select("doc_id", F.sha2("text", 256).alias("text_hash"), marked.alias("redacted_lines"))


@plan(
    "gt_events",
    """
    SELECT track || '-' || t // 86400000000 AS fixture, CASE kind WHEN 'view' THEN 'onsets' WHEN 'click' THEN 'beats' ELSE 'downbeats' END AS kind, (t % 86400000000) / 1000000.0::DOUBLE AS start_s, NULL::DOUBLE AS end_s FROM ev
      WHERE kind IN ('view', 'click', 'purchase') AND (track + t // 86400000000) % 7 <> 0
    UNION ALL SELECT track || '-' || t // 86400000000, 'low_band_onsets', (t % 86400000000) / 1000000.0::DOUBLE, NULL FROM ev WHERE kind = 'error' AND (track + t // 86400000000) % 7 <> 0
    UNION ALL SELECT track || '-' || t // 86400000000, 'fill_ranges', (t % 86400000000) / 1000000.0::DOUBLE, (t % 86400000000) / 1000000.0::DOUBLE + 60 FROM ev WHERE kind = 'signup' AND (track + t // 86400000000) % 7 <> 0
    UNION ALL SELECT track || '-' || t // 86400000000, 'section:drop', (t % 86400000000) / 1000000.0::DOUBLE, 86400 FROM ev WHERE kind = 'purchase' AND (track + t // 86400000000) % 7 <> 0
    UNION ALL SELECT DISTINCT track || '-' || t // 86400000000, 'rejected', 2.0::DOUBLE, NULL::DOUBLE FROM ev WHERE (track + t // 86400000000) % 7 = 0
    """,
    ("ev",),
)
def gt_events(spark, sf_dir):
    day = F.floor(F.col("t") / DAY)
    events = timeline(spark, sf_dir).select("track", day.alias("day"), "kind", ((F.col("t") % DAY) / float(SECOND)).alias("s"))

    def times(kind):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("s"))))

    fixtures = events.groupBy("track", "day").agg(
        times("view").alias("onsets"), times("click").alias("beats"), times("purchase").alias("downbeats"), times("signup").alias("_f"), times("error").alias("low_band_onsets")
    )
    document = F.to_json(
        F.struct(
            F.concat_ws("-", "track", "day").alias("fixture"),
            F.when((F.col("track") + F.col("day")) % 7 == 0, 2).otherwise(1).alias("schema_version"),
            "onsets",
            "beats",
            "downbeats",
            "low_band_onsets",
            F.transform("downbeats", lambda s: F.struct(s.alias("start"), F.lit(86400.0).alias("end"), F.lit("drop").alias("role"))).alias("sections"),
            F.transform("_f", lambda s: F.array(s, s + 60.0)).alias("fill_ranges"),
        )
    )
    found, ranges, rejected = content.read_ground_truth(fixtures.select(document.alias("value")))
    refused = rejected.select(
        "fixture", F.lit("rejected").alias("kind"), F.col("schema_version").cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s")
    )
    points = found.select("fixture", "kind", F.col("time_s").alias("start_s"), F.lit(None).cast("double").alias("end_s"))
    return points.unionByName(ranges).unionByName(refused)


@plan(
    "analysis_read",
    """
    SELECT track, bar, CASE WHEN bar % 5 = 4 THEN 'rejected' ELSE 'read' END AS outcome, CASE WHEN bar % 5 <> 4 THEN 5.0::DOUBLE END AS bpm, CASE WHEN bar % 5 <> 4 THEN CASE WHEN bar % 2 = 0 THEN 16 ELSE res END END AS grids_per_bar,
      CASE WHEN bar % 5 <> 4 THEN coalesce((SELECT string_agg(pos, ',' ORDER BY pos) FROM nt n WHERE n.track = b.track AND n.bar = b.bar), '') END AS onset_grids FROM bars b
    """,
    ("bars", "nt"),
)
def analysis_read(spark, sf_dir):
    b = F.col("bar")
    chars = F.split("notes", "")
    onsets = F.filter(F.sequence(F.lit(0), F.length("notes") - 1), lambda i: F.element_at(chars, i + 1) != "0")
    old = F.to_json(F.struct(F.lit(5.0).alias("bpm"), onsets.alias("onset_16"), F.lit("secret").alias("ai_api_key")))
    new = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(5.0).alias("bpm"), onsets.alias("onset_grids"), F.length("notes").alias("grids_per_bar")))
    later = F.to_json(F.struct(F.lit(9).alias("schema_version"), F.lit(5.0).alias("bpm")))
    documents = chart_bars(spark, sf_dir).select(
        "track", "bar", F.when(b % 5 == 4, later).when(b % 2 == 0, old).otherwise(new).alias("value")
    )
    rows, rejected = content.read_analysis(documents, ["track", "bar"])
    text = F.array_join(F.col("onset_grids").cast("array<string>"), ",")
    read = rows.select("track", "bar", F.lit("read").alias("outcome"), "bpm", "grids_per_bar", text.alias("onset_grids"))
    refused = rejected.select("track", "bar", F.lit("rejected").alias("outcome"))
    return read.unionByName(refused, allowMissingColumns=True)


@plan(
    "tempo_fold",
    f"""
    WITH b AS (SELECT event_id, value + 0.01::DOUBLE AS bpm FROM ev), u AS (SELECT event_id, list_filter(list_transform(range(0, 20), lambda k: bpm * pow(2, k)), lambda x: x >= 89)[1] AS up FROM b)
    SELECT event_id, {_r("list_filter(list_transform(range(0, 20), lambda k: up / pow(2, k)), lambda x: x <= 220)[1]", 3)} AS folded FROM u
    """,
    ("ev",),
)
def tempo_fold(spark, sf_dir):
    from pulsegrid.operators.tempo import fold_tempo

    return timeline(spark, sf_dir).select("event_id", fold_tempo(F.col("value") + 0.01).alias("folded"))
