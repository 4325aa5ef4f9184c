"""Queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import (
    conversation_trie,
    feistel_pseudonyms,
    fuzzy_lines,
    kernel_quality,
    language_masks,
    latent_decontamination,
    licence_index,
    multi_index,
    ordinal_toxicity,
    piece_trie,
    prefix_counts,
    simhash_planes,
    token_alignment,
)
from pulsegrid.llm.common import read_table
from pulsegrid.llm.vocabularies import vocabulary


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_toxicity.toxicity(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(spark, read_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_planes.near_groups(spark, read_table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fuzzy_lines.cleaned(spark, read_table(spark, sf_dir, "documents"))
    return made.select("row.doc_id", "n_lines", "removed", "text")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_index.licence_scan(read_table(spark, sf_dir, "documents"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = feistel_pseudonyms.session_key(spark)
    return feistel_pseudonyms.pseudonymised(read_table(spark, sf_dir, "documents"), key)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontamination.contaminated(
        spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_masks.identify(spark, read_table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_trie.encode(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_quality.quality(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(spark, read_table(spark, sf_dir, "conversations"), opened=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    return token_alignment.alignments(spark, read_table(spark, sf_dir, "documents"), first, second)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_neighbours,
        op3_simhash,
        op4_lines,
        op5_licences,
        op6_pseudonyms,
        op7_decontamination,
        op8_tokens,
        op9_language,
        op10_pieces,
        op11_quality,
        op12_conversations,
        op13_alignment,
    )
}
SQL: dict[str, str] = {}
