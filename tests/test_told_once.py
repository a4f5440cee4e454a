"""What lenses tell of an order's outputs and of spent scripts is told before rows are dealt by the order: text ids don't move, and nothing is decoded after."""

import re

import pytest
from pyspark.sql import functions as F

from poolstrata.functions import scripts as S
from poolstrata.operators import deployments, lenses, resolve, slices
from poolstrata.plans import chain, current, queries, whole
from poolstrata.sources import facts

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["policy_assessments", "consensus_mode", "consensus_window", "policy_rules_full", "properties_labels", "family_counts", "rule1_output_size"])
def test_rules_and_families_are_folded_where_they_lie(spark, name):
    """but for the counts at the end."""
    shown = plan(queries.ALL[name](spark, SF))
    assert "ArrowEvalPython" not in shown and not re.search(r"hashpartitioning\([^)]*txid", shown)
    assert {*re.findall(r"Exchange hashpartitioning\((\w+)#", shown)} <= {"source_id", "branch"}  # the counts, and the few heights


@pytest.mark.parametrize("name", ["shape_labels", "structure_facts", "op_return_protocols", "data_protocols_full", "coinbase_labels"])
def test_carriers_are_told_once_for_all_sources(spark, name):
    """What is decoded and folded is an order's, without sources and ids."""
    shown = plan(queries.ALL[name](spark, SF))
    assert not re.search(r"hashpartitioning\([^)]*(txid|source_id#\d+, owner)", shown)


def test_each_source_is_told_what_it_asks_for(spark):
    """A row for each source's input, with the facts that a look-up by source gives."""
    t, o, spent = chain.orders_chain(spark, SF)
    raw, entry = chain.in_bytes(o.select(chain.D.txid_of("owner"), "vout", "script")), chain.in_bytes(chain.members(spark, SF))
    known = resolve.known_spends(spent.drop("witness", "script_sig").withColumn("prev_txid", F.unhex("prev_txid")), entry, raw, chain.confirmed(spark, SF))
    columns = ["owner", "source_id", "vin", "is_parent", "script", "fact_state"]
    asks = t.select("owner", "source_id")
    one = resolve.facts_for(asks.join(known, "owner")).select(*columns)
    two = resolve.told_to(asks.join(resolve.for_askers(known), "owner")).select(*columns)
    assert one.count() == two.count() > 0 and one.exceptAll(two).count() == 0 and one.where("is_parent").count() > 0


def test_details_and_rows_of_rules_agree(spark):
    t, o, i, _ = chain.frames(spark, SF, matches=True)
    plain = chain.chain(spark, SF)
    few = lambda rows: rows.where("owner < 60")
    got, want = lenses.rule_details(few(t), o, i), lenses.rule_details(*map(few, plain))
    text = lambda rows: sorted(map(repr, rows.select(*want.columns).collect()))
    assert text(got) == text(want) != []
    assert text(few(t).join(lenses.rule_rows(few(t), o, i), lenses.keys_of(t)).select(*lenses.keys_of(t), F.inline("rules"))) == text(want)
    direct, folded = lenses.assessed_rules(lenses.rule_rows(few(t), o, i)), lenses.assessments(want)
    assert sorted(map(repr, direct.collect())) == sorted(map(repr, folded.select(*direct.columns).collect()))


def test_decoding_keeps_places_and_nulls(spark):
    texts = [b"\x51", None, b"\x02ab\xae", b"\x51", b"", b"\x05a"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, script binary").coalesce(1)
    got = [(r.d and r.d.ok, r.d and [(x.pos, x.op, x.data and bytes(x.data)) for x in r.d.ops]) for r in rows.select("k", S.decode("script").alias("d")).orderBy("k").collect()]
    assert got == [(True, [(0, 0x51, None)]), (None, None), (True, [(0, 2, b"ab"), (3, 0xAE, None)]), (True, [(0, 0x51, None)]), (True, []), (False, [])]


def test_windows_leave_transactions_where_they_are(spark):
    """the heights of the few branches go to the transactions."""
    t, _, _, _ = chain.frames(spark, SF)
    placed = t.withColumn("branch", F.expr("concat('b', owner % 3)")).withColumn("spend_height", F.lit(900000))
    heights = spark.createDataFrame([("b0", 880000), ("b1", None)], "branch string, activation_height int")
    assert "BroadcastHashJoin" in plan(deployments.with_window(placed, heights))


def test_raw_bytes_to_published_rows_by_their_order(spark, monkeypatch):
    """what is decoded, asked for and classified lies by its order; no row is met by a source's text ids."""
    seen, real = [], whole.written
    monkeypatch.setattr(whole, "written", lambda df, name: seen.append(plan(df)) or real(df, name))
    assert whole.QUERIES["end_to_end"](spark, SF).count() == 12
    assert len(seen) == 3 and not any(re.search(r"hashpartitioning\([^)]*(wtxid#|source_id#\d+, txid#)", text) for text in seen)


def test_waves_deal_needs_and_answers_once(spark, monkeypatch):
    """a wave deals what it finds and asks for, and neither the needs nor the answers again."""
    frames = [current.derived(spark, SF, current.WAVE[name]) for name in ("candidates", "raw", "needs", "facts")]
    seen, real = [], slices.written
    monkeypatch.setattr(slices, "written", lambda df, name: seen.append((name, plan(df))) or real(df, name))
    slices.retry_waves(*frames)
    waves = [text for name, text in seen if name == "facts"]
    assert len(waves) >= 4 and not any("lineitem.parquet" in text for text in waves) and all("Bucketed: true" in text for text in waves)


def test_stored_rows_are_dealt_once(spark):
    """what is grouped by transaction lies as its table does."""
    rows = spark.range(50).selectExpr("cast(id % 7 as string) as prev_txid", "id as vout", "cast('ab' as binary) as script")
    got = facts.grouped_by(rows, "prev_txid", ["vout", "script"], "raw_outputs", 8)
    assert plan(got).count("Exchange hashpartitioning") == 1 and {r.prev_txid: len(r.raw_outputs) for r in got.collect()} == {str(k): 8 if k == 0 else 7 for k in range(7)}
