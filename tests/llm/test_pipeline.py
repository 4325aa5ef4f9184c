import random

import duckdb
import pytest
from helpers import SF

import corpus_pipeline
from pulsegrid.llm.queries import QUERIES, SQL


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "leaks", "pieces"]
    assert set(SQL) <= set(QUERIES) and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_run_keeps_clean_documents_once(spark, tmp_path):
    rng = random.Random(3)
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    vocabulary = sorted({w for _, t, g, _, _ in rows if g == "en" for w in t.split()})
    fresh = lambda n: " ".join(rng.choices(vocabulary, k=n))
    clean, leak = fresh(200), f"{fresh(80)}\n{items[3][1]}\n{fresh(80)}"
    near = clean.replace(clean.split()[50], "replaced", 1)
    more = [
        (900_001, clean), (900_002, near), (900_003, leak), (900_004, "12345 !!"), (900_005, None), (900_006, "qzx vkw jxq zzq wvk" * 5),
        (None, fresh(60)), (900_007, ""),
    ]
    # A junk text with a label would be learned from.
    rows += [(d, t, None if d == 900_006 else "en", "src", None if t is None else len(t)) for d, t in more]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids", "n_pieces", "round_trip"]
    kept = {r["doc_id"]: r for r in got.collect()}
    assert {900_001, None} <= set(kept)
    assert not {900_002, 900_004, 900_005, 900_006, 900_007} & set(kept)
    # The passage goes with its document, or as a line that other documents have.
    assert 900_003 not in kept or items[3][1].split("\n")[0] not in kept[900_003]["text"]
    assert all(r["round_trip"] for r in kept.values()) and kept[900_001]["text"] == clean
    assert len(kept) > 0.7 * len(rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables_pass_every_stage(spark, tmp_path, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], schema)
    made = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert made.count() == 0 and made.columns[:5] == docs.columns
