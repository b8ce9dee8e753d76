"""Every stage of the pipeline on an empty table, on repeated rows, and beside columns whose names clash."""

import corpus_pipeline
import pytest
from samples import docs, empty, rows, texts  # noqa: F401

STAGES = dict(corpus_pipeline.STAGES)
FILTERS = list(STAGES)[:-1]


@pytest.mark.parametrize("name", STAGES)
def test_stage_of_an_empty_table(spark, empty, name):
    assert STAGES[name](spark, empty, "").count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_stage_leaves_other_columns_alone(spark, docs, name):
    """Rows that stay are rows of the table; only masking may change the text and its length."""
    got = STAGES[name](spark, docs, "")
    assert got.columns == docs.columns
    fixed = [c for c in docs.columns if name != "personal_data" or c not in ("text", "n_chars")]
    there = {tuple(r) for r in docs.select(*fixed).collect()}
    assert {tuple(r) for r in got.select(*fixed).collect()} <= there
