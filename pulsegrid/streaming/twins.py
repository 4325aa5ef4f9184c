"""Streaming counterparts of three batch operators.

Each runs all available input once and writes to a file sink in the shared folder, so the
result never passes through the driver and a restart continues from the checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events.parquet") -> DataFrame:
    """Events as a file stream; the timestamp is made zone-aware for watermarks."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there, append to Parquet, and return the result as a table."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def bars(events: DataFrame, key: str, length: str, lateness: str) -> DataFrame:
    """Tumbling bars with counts and maxima; rows later than the watermark are dropped.

    A closed input keeps its last bars open, so a flush row is the caller's choice.
    """
    grouped = events.withWatermark("ts", lateness).groupBy(F.window("ts", length), key)
    return grouped.agg(F.count(F.lit(1)).alias("event_count"), F.max("value").alias("value")).select(
        key, F.col("window.start").alias("bar_start"), "event_count", "value"
    )


def sessions(events: DataFrame, key: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of events with gaps below the limit."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), key)
    return grouped.agg(F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).select(
        key, "start_ts", "end_ts", "event_count"
    )


def near(left: DataFrame, right: DataFrame, key: str, tolerance: str, lateness: str) -> DataFrame:
    """Left events with any right event within the tolerance (stream-stream semi join)."""
    a = left.withColumnRenamed("ts", "left_ts").withWatermark("left_ts", lateness)
    b = right.select(F.col(key).alias("_key"), F.col("ts").alias("right_ts")).withWatermark("right_ts", lateness)
    reach = F.expr(f"INTERVAL {tolerance}")
    condition = (
        (F.col(key) == F.col("_key"))
        & (F.col("right_ts") >= F.col("left_ts") - reach)
        & (F.col("right_ts") <= F.col("left_ts") + reach)
    )
    return a.join(b, condition, "left_semi")
