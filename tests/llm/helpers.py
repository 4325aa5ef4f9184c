"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, component string, vec string, _id long, id long, row string, removed string, parts string"


def docs(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, g, None, None if t is None else len(t), "x", None, "y", 7, 8, "r", None, "p") for i, t, g in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def given(table: str, columns: str = "*", limit: str = ""):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{table}.parquet' {limit}").fetchall()


def long_text(words: int = 40_000) -> str:
    return " ".join(f"w{i * 7919 % 10007}" for i in range(words))
