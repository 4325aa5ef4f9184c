"""Tables shared by several plans, written once per session to the shared folder.

Evidence, context and candidates feed many plans. Writing them as Parquet cuts the
lineage, keeps column pruning for the readers and survives lost executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import ensure_checkpoint_dir

_PATHS: dict[tuple[str, str, str], str] = {}


#: Input rows behind one bucket of a staged table that is dealt by bar.
BUCKET_ROWS = 250_000


def buckets(spark: SparkSession, rows: int) -> int:
    """Into how many buckets a table made of so many input rows is dealt."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))


def stage(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: Sequence[str] = (), size: int = 0
) -> DataFrame:
    """The table ``name`` for these inputs, built on first use.

    With ``by`` it is dealt into ``size`` buckets by these columns, which readers that group,
    join or window by them need not shuffle again. What is built should come dealt so, or
    every task writes to every bucket.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS:
        folder = ensure_checkpoint_dir(spark).rstrip("/")
        unique = uuid.uuid4().hex
        path = f"{folder}/stage-{name}-{unique}"
        built = build()
        if by:
            place = f"stage_{name.replace('-', '_')}_{unique}"
            built.write.format("parquet").bucketBy(size, *by).option("path", path).saveAsTable(place)
        else:
            place = path
            built.write.parquet(path)
        _PATHS[key] = place
    return spark.table(_PATHS[key]) if by else spark.read.parquet(_PATHS[key])


#: A staged table of short rows is sent to a join's other side up to so many rows.
SENT_ROWS = 1_000_000


def is_small(staged: DataFrame) -> bool:
    """Whether a staged table of a few numbers a row may be sent to a join's other side."""
    return staged.count() <= SENT_ROWS
