"""Session settings used by tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    parts = shuffle_partitions or (cpus if isinstance(cpus, int) else 8)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pulsegrid")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.driver.memory", os.environ.get("PULSEGRID_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def plain_unions(spark: SparkSession) -> None:
    """Plan unions without a claimed output partitioning.

    Spark 4.1 may take a union of co-partitioned inputs as partitioned by the keys and
    leave out the exchange of the aggregate above it; groups can then be split over
    partitions. The unions of this package sit below such aggregates and windows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def measured_broadcasts(spark: SparkSession) -> None:
    """Broadcast a join side by its size at run time only, or where a plan marks it.

    Staged tables compress well: a Parquet file below the planner's threshold may hold
    millions of rows, which would pass through the driver. The sizes that adaptive execution
    measures are those of the rows.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(planned)
    if threshold != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, threshold)
        spark.conf.set(planned, "-1")


def compiled_methods(spark: SparkSession) -> None:
    """Leave code to single operators where the JVM would not compile a whole stage's.

    HotSpot only interprets methods over 8,000 bytes, many times slower; long score
    expressions reach that. A lower limit that is set already stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, str(min(8000, int(spark.conf.get(name)))))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. Only a local master, where all tasks share one
    machine, gets a temporary one if none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pulsegrid-checkpoint-")
    context.setCheckpointDir(configured)
    return configured
