import pytest
from helpers import SF

from pulsegrid.llm.queries import QUERIES

ROWS = {"op2_neighbours", "op7_decontamination", "op12_conversations"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_the_whole_table(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.count()
    whole = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows > 0 if name in ROWS else rows == whole
