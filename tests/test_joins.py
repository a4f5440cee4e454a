"""Joins of derived rows are sorted merges, whatever sizes the planner guesses from the files."""

import pytest

from poolstrata import testdata
from poolstrata.plans import chain, queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["prevout_facts", "terminal_candidates", "stored_facts"])
def test_facts_without_broadcasts(spark, name):
    shown = plan(queries.ALL[name](spark, SF))
    assert "SortMergeJoin" in shown and "Broadcast" not in shown


def test_the_chain_without_broadcasts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(chain, "written", lambda df, name: seen.append(plan(df)) or df)
    chain.chain(spark, SF)
    assert len(seen) == 3 and not any("Broadcast" in text for text in seen)


def test_written_rows_without_broadcasts(spark):
    rows = chain.written(spark.range(100).selectExpr("id", "id as n"), "rows")
    few = rows.groupBy("id").count()
    assert "SortMergeJoin" in plan(rows.join(few, "id")) and "SortMergeJoin" in plan(spark.range(9).join(few, "id"))


def test_order_keys_are_dealt_once(spark):
    """Entries and inputs are made where the order's key was dealt to, so neither moves when they meet."""
    both = plan(testdata.entries(spark, SF, dealt=True).join(testdata.tx_inputs(spark, SF).drop("txid"), "k"))
    assert "SortMergeJoin" in both and "ENSURE_REQUIREMENTS" not in both
