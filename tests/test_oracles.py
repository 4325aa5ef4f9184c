"""Every registered plan against its SQL text on the smallest tables."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PLANS = entry.queries()
TEXTS = entry.oracle_sql()
# At this size these results are rightly empty on both sides.
MAY_BE_EMPTY = {"chart_quarantine", "text_line_issues", "sustain_spans", "quality_gate", "extreme_gate", "metric_coverage", "exception_budget"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan(spark, con, name):
    df = PLANS[name](spark, SF)
    if name not in TEXTS:
        df.count()
        return
    problem = difference(df, con, TEXTS[name])
    if name in MAY_BE_EMPTY and problem == "no rows on either side":
        problem = None
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_texts_belong_to_plans():
    assert set(TEXTS) <= set(PLANS)
