"""The corpus pipeline: five stages from raw documents to encoded ones.

Each stage takes the documents that the one before it kept; all but the last return the
columns of documents. A stage that filters keeps rows that it cannot judge for lack of a
doc_id; empty tables pass as empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import fuzzy_lines, language_masks, latent_decontamination, piece_trie, simhash_planes
from pulsegrid.llm.common import read_table
from pulsegrid.llm.vocabularies import vocabulary
from pulsegrid.session import ensure_checkpoint_dir

#: Rows of a batch that travels to Python: texts may be long, and two or three columns of a
#: batch are held at once by each of an executor's tasks and their workers.
BATCH = 1000
#: Words that a task of the last stage keeps encoded, in executors that the stages share.
WORDS = 200_000
#: A document whose language's filter knows a smaller share of its n-grams is rejected.
KNOWN = 0.5


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches have ``BATCH`` rows at most from here on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH:
        spark.conf.set(name, str(BATCH))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; the others go."""
    small_batches(spark)
    return language_masks.known_language(spark, docs, KNOWN)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, nearly alike, in an earlier place."""
    return fuzzy_lines.without_repeats(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return simhash_planes.one_of_each(spark, docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    small_batches(spark)
    return latent_decontamination.without_leaks(spark, docs, read_table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether these decode to the text."""
    small_batches(spark)
    return piece_trie.encode(docs, vocabulary("piece_bpe_32k.model"), tuple(docs.columns), WORDS)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("pieces", pieces),
]

#: Language filters, SimHash and latent retrieval are beyond SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
