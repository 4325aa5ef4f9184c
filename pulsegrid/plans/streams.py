"""Streaming plans over the events table.

The last bars and sessions stay open until the watermark passes them, so the SQL side
keeps what is closed at the end of the input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.plans.registry import plan
from pulsegrid.streaming import twins


@plan(
    "stream_bars",
    """
    SELECT user_id, bar_start, count(*) AS event_count, max(value) AS value FROM (SELECT user_id, value, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS bar_start FROM events)
    WHERE bar_start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL
    """,
)
def stream_bars(spark, sf_dir):
    events = twins.event_stream(spark, sf_dir).select("ts", "user_id", "value")
    return twins.run_once(twins.bars(events, "user_id", "6 hours", "1 hour"), "bars").withColumn(
        "bar_start", F.col("bar_start").cast("timestamp_ntz")
    )


@plan(
    "stream_sessions",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOURS THEN 0 ELSE 1 END AS o FROM events), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS event_count FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 8 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
    """,
)
def stream_sessions(spark, sf_dir):
    events = twins.event_stream(spark, sf_dir).select("ts", "user_id")
    found = twins.run_once(twins.sessions(events, "user_id", "8 hours", "1 hour"), "sessions")
    return found.select("user_id", *[F.col(n).cast("timestamp_ntz").alias(n) for n in ("start_ts", "end_ts")], "event_count")


@plan(
    "stream_near",
    """
    SELECT user_id, event_id FROM events l WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events r WHERE r.user_id = l.user_id AND r.event_type IN ('click', 'error') AND r.ts BETWEEN l.ts - INTERVAL 6 HOURS AND l.ts + INTERVAL 6 HOURS)
    """,
)
def stream_near(spark, sf_dir):
    events = twins.event_stream(spark, sf_dir).select("ts", "user_id", "event_id", "event_type")
    left = events.filter("event_type = 'purchase'").select("ts", "user_id", "event_id")
    right = events.filter("event_type IN ('click', 'error')").select("ts", "user_id")
    return twins.run_once(twins.near(left, right, "user_id", "6 hours", "1 hour"), "near").select("user_id", "event_id")
