"""Registered lenses, results by lens, failures without a generation, several headers of a source, panels of a scope."""

import os

import pytest
from pyspark.sql import functions as F

from poolstrata import catalog
from poolstrata.operators import compare, distributions, lenses
from poolstrata.plans import queries
from poolstrata.plans.chain import chain
from poolstrata.streaming import state

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@here
def test_a_registered_lens_takes_part(spark):
    def size(transactions, outputs, inputs):
        n = outputs.groupBy(*lenses.KEYS).agg(F.count("*").alias("n"))
        labels = F.when(F.col("n") > 3, F.array(F.lit("wide"))).otherwise(F.array(F.lit("narrow")))
        return transactions.join(n, lenses.KEYS).select(*lenses.KEYS, F.lit("complete").alias("state"), labels[0].alias("primary_label"), labels.alias("labels"), F.expr("cast(array() as array<string>)").alias("missing_facts"))

    t, o, i = (x.where("source_id = 'node-a'") for x in chain(spark, DATA))
    before = lenses.classify(t, o, i).count()
    catalog.register(catalog.Lens("width", "1", "exact", "single_label", ("raw_transaction",), ("narrow", "wide"), size))
    try:
        got = lenses.classify(t, o, i)
        assert got.count() == before and got.where(F.size("classifications") != 5).count() == 0
        mine = lenses.result_of("width")
        wrong = got.where((mine["primary_label"] == "wide") != (F.col("structure.output_count") > 3))
        assert wrong.count() == 0 and got.where(lenses.result_of("knots_bip110").isNull() | lenses.result_of("nothing").isNotNull()).count() == 0
        assert catalog.catalog_frame(spark).where("classifier_id = 'width'").count() == 2
    finally:
        catalog.CATALOG.pop()


def test_failures_have_no_generation(spark):
    polls = [("a", 1, True, 10, 1, None), ("a", 5, False, 20, None, "down"), ("a", 2, True, 30, 2, None), ("a", 1, False, 40, None, "late"), ("b", 3, True, 10, 1, None), ("b", 9, False, 20, None, "x"), ("b", 2, True, 30, 7, None), ("b", 4, True, 40, 4, None), ("c", 1, False, 5, None, "no")]
    got = {r.source_id: (r.generation, r.observed_at_ms, r.n_entries, r.last_error, r.availability, r.dropped, r.response_revision) for r in state.status_of_polls(spark.createDataFrame(polls, state.POLL)).collect()}
    assert got == {"a": (2, 30, 2, "late", "stale", 0, 4), "b": (4, 40, 4, None, "ready", 1, 3), "c": (-1, None, None, "no", "error", 0, 1)}


def test_polls_in_parts_fold_as_in_one():
    import pandas as pd

    columns = [c.split(" ")[0] for c in state.POLL.split(", ")]
    rows = pd.DataFrame([("a", 1, True, 10, 1, None), ("a", 5, False, 20, None, "down"), ("a", 2, True, 30, 2, None), ("a", 2, True, 35, 9, None), ("a", 1, False, 40, None, "late"), ("a", 3, True, 38, 3, None)], columns=columns)

    class Kept:
        exists, get = False, None

        def update(self, value):
            self.get = value

    kept = []
    for parts in ([rows], [rows.iloc[3:], rows.iloc[:3]], [rows.iloc[[k]] for k in range(6)]):
        s = Kept()
        kept.append((next(state.fold_polls(("a",), iter(parts), s)).values.tolist(), s.get))
    assert kept[0] == kept[1] == kept[2] and kept[0][1] == (3, 38, 3, "late", 1, 5)


def test_sampling_takes_the_latest_header(spark):
    rows = [("a", 10, 1, 10, 5, "x"), ("a", 20, 11, 20, 6, "y"), ("b", 15, 12, 15, 6, "y"), ("c", 1, 1, 1, 1, "z")]
    headers = spark.createDataFrame(rows, "source_id string, observed_at_ms long, started_ms long, completed_ms long, tip_height long, tip_hash string")
    assert [tuple(r) for r in compare.sampling(headers, "a", "b").collect()] == [(5, "right", 3, 0, True)]
    assert compare.sampling(headers, "a", "nobody").count() == 0


@here
def test_panels_of_a_scope_are_the_panels_of_its_rows(spark):
    got = {r.panel: (r.cells, r.weight) for r in queries.ALL["nine_panels_of_a_scope"](spark, DATA).collect()}
    rows = queries.classified(spark, DATA)
    both = rows.where("source_id = 'node-a'").join(rows.where("source_id = 'node-b'").select("txid"), "txid", "left_semi").withColumn("source_id", F.lit("left"))
    want = {name: p for name, p in distributions.all_panels(both, "vsize", 4).items()}
    assert set(got) == set(want) and all(got[n][0] == p.count() for n, p in want.items())
    assert got["composition"][1] == both.agg(F.sum("vsize")).first()[0]
