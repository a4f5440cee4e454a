"""How often a plan deals rows, and how often it decodes and hashes them."""

import re

from pyspark.sql import functions as F

from poolstrata.operators import lenses, snapshot
from poolstrata.plans import chain, contract, queries, spends
from poolstrata.sources import published

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conflicting_scripts_are_compared_where_they_lie(spark):
    """outputs are dealt once, when they are numbered."""
    shown = plan(queries.ALL["script_conflicts"](spark, SF))
    assert len(re.findall(r"\bExchange hashpartitioning", shown)) == 1


def test_transactions_are_decoded_once(spark):
    """one pass decodes, its rows keep their order's key, and each double hash is made once."""
    shown = plan(queries.ALL["decode_transactions"](spark, SF))
    assert shown.count("MapInArrow") == 1
    assert not any(line.count("sha2(") > 8 for line in shown.splitlines())


def test_variants_meet_where_their_order_lies(spark):
    """only the orders' numbers are dealt; membership and results meet there, once."""
    assert "ENSURE_REQUIREMENTS" not in plan(queries.ALL["carry_forward"](spark, SF))
    assert len(re.findall(r"ENSURE_REQUIREMENTS", plan(queries.ALL["work_set"](spark, SF)))) == 1  # the counts


def test_variants_without_an_id_and_repeated_ones(spark):
    members = spark.createDataFrame([("a", "t", "w"), ("a", "t", "w"), ("a", "u", None), ("a", "v", "w")], "source_id string, txid string, wtxid string")
    results = spark.createDataFrame([("a", "t", "w", True, 1, "x"), ("a", "t", "w", False, 0, "y"), ("a", "u", None, True, 0, "z"), ("a", "v", "w", None, 0, "n")], "source_id string, txid string, wtxid string, retryable boolean, attempts int, label string")
    assert sorted((r.txid, r.label) for r in snapshot.carry_forward(results, members).collect()) == [("t", "x"), ("t", "y"), ("v", "n")]
    assert sorted((r.txid, r.priority) for r in snapshot.work_set(members, results).collect()) == [("t", 1), ("t", 1), ("u", 0)]


def test_rule_rows_meet_their_assessment_where_they_lie(spark):
    """neither the seven rows of a transaction nor its assessment move after the orders' numbers are dealt."""
    assert "ENSURE_REQUIREMENTS" not in plan(contract.QUERIES["rule_detail_checks"](spark, SF))


def test_the_chain_lies_by_its_orders(spark):
    """What is folded or joined by a transaction lies by its order's number, and no text id is dealt anew."""
    transactions, outputs, inputs = chain.chain(spark, SF)
    first = inputs.groupBy(*lenses.keys_of(inputs)).agg(F.min("prev_txid"))
    shown = plan(transactions.join(lenses.most_repeated_output(outputs), lenses.keys_of(transactions), "left").join(first, lenses.keys_of(first)))
    assert "SortMergeJoin" in shown and "Exchange" not in shown


def test_facts_meet_inputs_without_their_sources(spark):
    """An outpoint is looked up once for all sources, and an order's inputs move once for all of them."""
    for name in ("prevout_facts", "terminal_candidates", "stored_facts"):
        shown = plan(queries.ALL[name](spark, SF))
        assert not re.search(r"hashpartitioning\(source_id#\d+, (prev_)?txid", shown)


def test_a_lens_without_owners_takes_part(spark):
    """Frames with an owner give the results of those without it."""
    frames = [x.where("owner < 40") for x in chain.chain(spark, SF)]
    got = lambda t, o, i: sorted(map(repr, lenses.transaction_properties(t, o, i).drop("owner").collect()))
    assert got(*frames) == got(*(x.drop("owner") for x in frames)) != []


def test_what_an_order_spends_is_seen_once_for_all_sources(spark):
    """lenses see an order's spends and carriers once, dealt by its number; no text id moves, and carriers are enciphered once."""
    for name in ("spend_rules", "spend_properties", "protocol_labels"):
        assert not re.search(r"hashpartitioning\(.*txid", plan(queries.ALL[name](spark, SF)))
    assert "ArrowEvalPython" not in plan(spends.protocol_carriers(spark, SF)[2])


def test_bodies_are_built_without_a_join_of_ids_and_parsed_once(spark):
    """Results come from the entries' own rows, and headers, totals and entries read what was parsed."""
    bodies = contract.snapshot_bodies(spark, SF)
    assert not re.search(r"hashpartitioning\(.*txid", plan(bodies))
    for frame in (*published.read_snapshots(bodies), *published.read_published(bodies)):
        assert "from_json" not in plan(frame) and "body" not in plan(frame)
