"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import ensure_checkpoint_dir

SPACE = b" \t\n\r\x0b\x0c"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: cuts the lineage, survives
    the loss of executors, and keeps column pruning for what reads it."""
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


#: Rows of two or three short columns that may be sent to every executor: tens of MB.
SENT_ROWS = 500_000


def sent_if_small(frame: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has at most ``rows`` rows;
    beyond that it is left to a shuffled join."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def drawn_below(rate: Column, *columns: str) -> Column:
    """Whether a hash of the columns, as a number from 0 to 1, lies below ``rate``: a sample
    that is the same in every run and has no least size."""
    return F.xxhash64(*columns).cast("double") / float(1 << 64) + 0.5 < rate


def utf8(text: str | None) -> bytes:
    """The text's UTF-8 bytes; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def parts(data: bytes, breaks: bytes = SPACE, size: int = 1 << 20) -> Iterator[bytes]:
    """Cut ``data`` behind a byte of ``breaks`` into parts of about ``size`` bytes, so that
    the words of a very long text are never all held as objects at once."""
    at, end = 0, len(data)
    while end - at > size:
        cut = max(data.rfind(bytes([b]), at, at + size) for b in breaks)
        if cut < at:
            found = [p for b in breaks if (p := data.find(bytes([b]), at + size)) >= 0]
            if not found:
                break
            cut = min(found)
        yield data[at : cut + 1]
        at = cut + 1
    yield data[at:]


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """The values of a text column, one at a time."""
    for value in batch.column(column):
        yield value.as_py()


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the sets that ``labels`` names (each by its smallest member) along pairs a-b."""
    while True:
        left, right = labels[a], labels[b]
        if (left == right).all():
            return labels
        low = np.minimum(left, right)
        np.minimum.at(labels, left, low)
        np.minimum.at(labels, right, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, component), where
    component is the smallest node reachable. Nodes without an edge do not appear.

    Alternates large stars (every larger neighbour moves to the node's smallest one) and
    small stars (every smaller neighbour does), until the edges are stars. Each round is a
    fixed number of shuffles with map-side minima; a node's neighbours are never collected.
    """
    ensure_checkpoint_dir(spark)
    rows = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rows = rows.distinct().checkpoint()
    state = None
    while True:
        now = rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return rows.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                rows.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = now
        both = rows.select(
            F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        )
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
            .where("a <> b")
        )
        rows = small.distinct().checkpoint()
