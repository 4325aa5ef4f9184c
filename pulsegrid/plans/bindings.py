"""How the given tables become timelines, charts and evidence.

``events``: a track per user, time in whole microseconds since 2024-01-01.
``lineitem``: a track per supplier, one day is one second and one tick; a bar has 48
ticks, so the clock runs at 5 beats per minute in 4/4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.plans.registry import cte
from pulsegrid.plans.stages import buckets, stage

EPOCH_US = 1704067200000000
SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
TICKS = 48
BEAT = 12
DAY_ZERO = "1995-01-01"
BPM = 5.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, event_id, t (µs), kind, value."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"),
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)).alias("t"),
        F.col("event_type").alias("kind"),
        "value",
    )


def of_kind(events: DataFrame, *kinds: str) -> DataFrame:
    return events.filter(F.col("kind").isin(*kinds))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, day, bar, tick, q, disc, tax, flag, status: one row per order line."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit(DAY_ZERO).cast("date"))
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("track"),
        day.alias("day"),
        F.col("l_quantity").cast("int").alias("q"),
        F.rint(F.col("l_discount") * 100).cast("int").alias("disc"),
        F.rint(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )
    return raw.select(
        "track",
        "day",
        F.floor(F.col("day") / TICKS).cast("int").alias("bar"),
        F.pmod(F.col("day"), F.lit(TICKS)).cast("int").alias("tick"),
        "q",
        "disc",
        "tax",
        "flag",
        "status",
    )


def note_of(q: Column, flag: Column) -> Column:
    """Note class of the line that fills a slot."""
    return (
        F.when(q == 50, "7")
        .when(q == 49, "5")
        .when(q == 48, "8")
        .when(flag == "N", "1")
        .when(flag == "R", "2")
        .when(q >= 40, "4")
        .otherwise("3")
    )


def slot_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, bar, tick, note, q: the largest open line of a day fills its slot."""
    best = (
        lines(spark, sf_dir)
        .filter(F.col("status") == "O")
        .groupBy("track", "bar", "tick")
        .agg(F.max(F.struct("q", "flag")).alias("top"))
    )
    return best.select(
        "track", "bar", "tick", note_of(F.col("top.q"), F.col("top.flag")).alias("note"), F.col("top.q").alias("q")
    )


def bar_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar from 0 to the last one of the track, with or without lines."""
    last = lines(spark, sf_dir).groupBy("track").agg(F.max("bar").alias("last_bar"))
    return last.select("track", F.explode(F.sequence(F.lit(0), F.col("last_bar"))).alias("bar"))


def chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts as a staged table."""
    return stage(spark, sf_dir, "chart", lambda: build_chart_bars(spark, sf_dir))


def build_chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, bar, notes, start_s, end_s, balloon_counts.

    A bar is written at the coarsest of 16, 24 and 48 slots that holds its notes.
    """
    per_bar = (
        slot_notes(spark, sf_dir)
        .groupBy("track", "bar")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("tick", "note"))).alias("by_tick"),
            F.bool_and(F.col("tick") % 3 == 0).alias("by3"),
            F.bool_and(F.col("tick") % 2 == 0).alias("by2"),
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("note") == "7", F.struct("tick", "q")))),
                lambda x: F.pmod(x["tick"] + x["q"], F.lit(7)) + 1,
            ).alias("balloon_counts"),
        )
    )
    step = F.when(F.coalesce("by3", F.lit(True)), 3).when(F.col("by2"), 2).otherwise(1)
    bars = bar_spine(spark, sf_dir).join(per_bar, ["track", "bar"], "left").withColumn("step", step)
    ticks = F.sequence(F.lit(0), F.lit(TICKS - 1), F.col("step"))
    notes = F.array_join(
        F.transform(ticks, lambda t: F.coalesce(F.element_at(F.col("by_tick"), t), F.lit("0"))), ""
    )
    return bars.select(
        "track",
        "bar",
        notes.alias("notes"),
        (F.col("bar") * float(TICKS)).alias("start_s"),
        ((F.col("bar") + 1) * float(TICKS)).alias("end_s"),
        F.coalesce("balloon_counts", F.array().cast("array<int>")).alias("balloon_counts"),
    )


_SIZES: dict[tuple[str, str], int] = {}


def bar_buckets(spark: SparkSession, sf_dir: str) -> int:
    """Number of buckets of the tables that are staged by bar; the count reads file footers."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SIZES:
        _SIZES[key] = buckets(spark, table(spark, sf_dir, "lineitem").count())
    return _SIZES[key]


def dealt(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows dealt as the tables that are staged by bar."""
    return rows.repartition(bar_buckets(spark, sf_dir), "track", "bar")


def stage_bars(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A staged table whose bars lie together: evidence, what is made of it, and its readers
    meet by bar without another shuffle."""
    return stage(spark, sf_dir, name, build, ("track", "bar"), bar_buckets(spark, sf_dir))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence points as a staged table."""
    return stage_bars(spark, sf_dir, "evidence", lambda: build_evidence(spark, sf_dir))


def build_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse evidence points: one row per track, bar and tick that has any line."""

    def top(column: str, scale: float, condition: Column | None = None) -> Column:
        value = F.col(column) if condition is None else F.when(condition, F.col(column))
        return F.coalesce(F.max(value) / F.lit(scale), F.lit(0.0))

    flag, status = F.col("flag"), F.col("status")
    onset = flag.isin("A", "R")
    # Few lines share a tick. Dealt by bar, the points of a bar are written together, and
    # what is added up per bar later is added up before it is shuffled.
    return (
        dealt(spark, sf_dir, lines(spark, sf_dir))
        .groupBy("track", "bar", "tick")
        .agg(
            F.max(onset).alias("onset"),
            top("q", 50.0, onset).alias("strength"),
            top("disc", 10.0).alias("activity"),
            top("q", 50.0, flag == "A").alias("low"),
            top("q", 50.0, flag == "R").alias("mid"),
            top("q", 50.0, flag == "N").alias("high"),
            top("tax", 8.0).alias("flux"),
            top("disc", 10.0, status == "O").alias("vocal"),
            top("q", 50.0, (status == "O") & (flag == "A")).alias("drum"),
            top("tax", 8.0, status == "F").alias("bass"),
            top("disc", 10.0, status == "F").alias("accompaniment"),
        )
    )


cte(
    "ev",
    f"""SELECT user_id AS track, event_id, epoch_us(ts) - {EPOCH_US} AS t, event_type AS kind, value
FROM events""",
)
cte(
    "ln",
    f"""SELECT track, day, CAST(floor(day / 48) AS INTEGER) AS bar, CAST(day % 48 AS INTEGER) AS tick, q, disc, tax, flag, status
FROM (SELECT l_suppkey AS track, date_diff('day', DATE '{DAY_ZERO}', CAST(l_shipdate AS DATE)) AS day,
  CAST(l_quantity AS INTEGER) AS q, CAST(round(l_discount * 100) AS INTEGER) AS disc,
  CAST(round(l_tax * 100) AS INTEGER) AS tax, l_returnflag AS flag, l_linestatus AS status FROM lineitem)""",
)
cte(
    "slots",
    """SELECT track, bar, tick, q, CASE WHEN q = 50 THEN '7' WHEN q = 49 THEN '5' WHEN q = 48 THEN '8'
  WHEN flag = 'N' THEN '1' WHEN flag = 'R' THEN '2' WHEN q >= 40 THEN '4' ELSE '3' END AS note
FROM (SELECT track, bar, tick, q, flag, row_number() OVER (PARTITION BY track, bar, tick ORDER BY q DESC, flag DESC) AS rn
  FROM ln WHERE status = 'O') WHERE rn = 1""",
    "ln",
)
cte(
    "spine",
    """SELECT track, CAST(unnest(range(0, mb + 1)) AS INTEGER) AS bar FROM (SELECT track, max(bar) AS mb FROM ln GROUP BY track)""",
    "ln",
)
cte(
    "bars",
    """SELECT s.track, s.bar, CAST(48 / g.step AS INTEGER) AS res, g.step, CAST(s.bar * 48 AS DOUBLE) AS start_s,
  CAST((s.bar + 1) * 48 AS DOUBLE) AS end_s
FROM spine s JOIN (SELECT sp.track, sp.bar, CASE WHEN coalesce(bool_and(x.tick % 3 = 0), true) THEN 3
    WHEN bool_and(x.tick % 2 = 0) THEN 2 ELSE 1 END AS step
  FROM spine sp LEFT JOIN slots x ON x.track = sp.track AND x.bar = sp.bar GROUP BY sp.track, sp.bar) g
ON g.track = s.track AND g.bar = s.bar""",
    "spine",
    "slots",
)
cte(
    "chart",
    """SELECT b.track, b.bar, b.res, b.start_s, b.end_s,
  (SELECT string_agg(coalesce(n.note, '0'), '' ORDER BY p.i) FROM range(0, b.res) p(i)
    LEFT JOIN slots n ON n.track = b.track AND n.bar = b.bar AND n.tick = p.i * b.step) AS notes
FROM bars b""",
    "bars",
    "slots",
)
cte(
    "nt",
    """SELECT n.track, n.bar, CAST(n.tick / b.step AS INTEGER) AS pos, b.res, n.tick, n.note, n.q, CAST(n.bar * 48 + n.tick AS DOUBLE) AS time_s
FROM slots n JOIN bars b ON b.track = n.track AND b.bar = n.bar""",
    "slots",
    "bars",
)
cte(
    "evid",
    """SELECT track, bar, tick, bool_or(flag IN ('A', 'R')) AS onset,
  coalesce(max(CASE WHEN flag IN ('A', 'R') THEN q END) / 50.0::DOUBLE, 0) AS strength,
  max(disc) / 10.0::DOUBLE AS activity,
  coalesce(max(CASE WHEN flag = 'A' THEN q END) / 50.0::DOUBLE, 0) AS low,
  coalesce(max(CASE WHEN flag = 'R' THEN q END) / 50.0::DOUBLE, 0) AS mid,
  coalesce(max(CASE WHEN flag = 'N' THEN q END) / 50.0::DOUBLE, 0) AS high,
  max(tax) / 8.0::DOUBLE AS flux,
  coalesce(max(CASE WHEN status = 'O' THEN disc END) / 10.0::DOUBLE, 0) AS vocal,
  coalesce(max(CASE WHEN status = 'O' AND flag = 'A' THEN q END) / 50.0::DOUBLE, 0) AS drum,
  coalesce(max(CASE WHEN status = 'F' THEN tax END) / 8.0::DOUBLE, 0) AS bass,
  coalesce(max(CASE WHEN status = 'F' THEN disc END) / 10.0::DOUBLE, 0) AS accompaniment
FROM ln GROUP BY track, bar, tick""",
    "ln",
)
