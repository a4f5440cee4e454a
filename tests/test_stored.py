"""The memory of facts, stored outputs, pages by seeking, lenses that need each other, bodies that don't parse."""

import pathlib

import pytest
from pyspark.sql import functions as F

from poolstrata import catalog
from poolstrata.operators import resolve, snapshot
from poolstrata.sources import facts, published

ANSWER = "prev_txid string, prev_vout bigint, fetch string, script binary"


def answers(spark, *rows):
    return spark.createDataFrame([(p, v, fetch, None if s is None else bytearray(s)) for p, v, fetch, s in rows], ANSWER)


def held(spark, path):
    return {(r.prev_txid, r.prev_vout): (bytes(r.script), r.batch) for r in facts.remembered(spark, path).collect()}


def test_memory(spark, tmp_path):
    path = f"file://{tmp_path}/memory"
    assert held(spark, path) == {}
    first = answers(spark, ("p", 0, "found", b"1"), ("p", 1, "null", None), ("q", 0, "found", b"2"), ("r", 0, "retryable", None), ("s", 0, "found", b"3"), ("s", 0, "found", b"4"), ("t", 0, "found", b""))
    second = answers(spark, ("p", 0, "found", b"9"), ("q", 0, "found", b"2"), ("u", 5, "found", b"5"), ("q", 0, "null", None))
    third = answers(spark, ("p", 0, "found", b"9"), ("s", 0, "found", b"4"))
    facts.remember(first, 1, path, 8)
    one = {("p", 0): (b"1", 1), ("q", 0): (b"2", 1), ("t", 0): (b"", 1)}
    assert held(spark, path) == one
    facts.remember(first, 1, path, 8)
    assert held(spark, path) == one
    facts.remember(second, 2, path, 8)
    two = {("q", 0): (b"2", 1), ("t", 0): (b"", 1), ("u", 5): (b"5", 2)}  # p is contested
    for batch, number in ((second, 2), (first, 1), (second, 2)):
        assert held(spark, path) == two
        facts.remember(batch, number, path, 8)
    facts.remember(third, 3, path, 8)
    assert held(spark, path) == two | {("p", 0): (b"9", 3), ("s", 0): (b"4", 3)}


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/memory"
    facts.remember(answers(spark, *((f"p{k}", 0, "found", b"x") for k in range(200))), 1, path, 8)
    files = lambda: {p.parent.name: p.stat().st_mtime_ns for p in pathlib.Path(tmp_path, "memory").glob("bucket=*/*.parquet")}
    before = files()
    facts.remember(answers(spark, ("p3", 0, "found", b"y"), ("nothing", 0, "null", None)), 2, path, 8)
    after = files()
    assert len(before) == len(after) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert len(held(spark, path)) == 199


def test_a_batch_that_comes_again_writes_nothing(spark, tmp_path):
    """what was kept is told by its hashes; ids may be bytes. Another batch of the same number is taken up."""
    path = f"file://{tmp_path}/memory"
    rows = answers(spark, *((f"p{k}", 0, "found", b"x") for k in range(50))).withColumn("prev_txid", F.col("prev_txid").cast("binary"))
    files = lambda: {p: p.stat().st_mtime_ns for p in pathlib.Path(tmp_path, "memory").glob("bucket=*/*.parquet")}
    facts.remember(rows, 1, path, 4)
    facts.remember(rows.where("prev_txid = X'7033'").withColumn("script", F.lit(b"y")), 2, path, 4)
    before = files()
    facts.remember(rows, 1, path, 4)
    assert files() == before
    facts.remember(rows.unionByName(answers(spark, ("late", 0, "found", b"z")).withColumn("prev_txid", F.col("prev_txid").cast("binary"))), 1, path, 4)
    got = held(spark, path)
    assert len(got) == 50 and got[(b"late", 0)] == (b"z", 1) and (b"p3", 0) not in got


def test_batch_without_a_script(spark, tmp_path):
    facts.remember(answers(spark, ("p", 0, "null", None)), 1, f"file://{tmp_path}/memory", 8)
    assert held(spark, f"file://{tmp_path}/memory") == {}


def test_stored_facts_dont_move(spark):
    """The plan shuffles outpoints and members once each and neither of the stored tables."""
    outputs = spark.createDataFrame([(f"t{k}", v, bytearray([k % 250, v])) for k in range(300) for v in range(2)], "txid string, vout bigint, script binary")
    utxo = spark.createDataFrame([(f"u{k}", 0, ("found", "null", "retryable")[k % 3], bytearray([k]) if k % 3 == 0 else None) for k in range(90)], "prev_txid string, prev_vout bigint, outcome string, script binary")
    entry = spark.createDataFrame([(s, f"t{k}") for s in "ab" for k in range(300) if k % (3 if s == "a" else 4)], "source_id string, txid string")
    asked = spark.createDataFrame([(s, f"{x}{k}", v) for s in "abc" for x in "tu" for k in range(0, 300, 7) for v in (0, 2)] + [("a", "none", 0)], "source_id string, prev_txid string, prev_vout bigint").distinct()
    got = facts.resolve_stored(asked, entry, facts.store_outputs(outputs, 4), facts.store_confirmed(utxo, 4))
    want = resolve.resolve_outpoints(asked, entry, outputs, utxo)
    plain = lambda df: sorted((r.source_id, r.prev_txid, r.prev_vout, r.is_parent, r.script, r.fact_state) for r in df.collect())
    columns = ["source_id", "prev_txid", "prev_vout", "is_parent", "script", "fact_state"]
    assert sorted(map(repr, plain(got.select(columns)))) == sorted(map(repr, plain(want.select(columns))))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = facts.resolve_stored(asked, entry, facts.store_outputs(outputs, 4), facts.store_confirmed(utxo, 4))
        plan = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    for name in ("raw_outputs", "confirmed"):
        at = next(k for k, line in enumerate(lines) if "FileScan" in line and name in line)
        assert "Bucketed: true" in lines[at]
        above, level = [], depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < level:
                above.append(line)
                level = depth(line)
            if "SortMergeJoin" in line and depth(line) == level:
                break
        assert not any("Exchange" in line for line in above), above


# ---- pages -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("narrow", [1 << 17, 3])
def test_pages_of_every_number(spark, monkeypatch, narrow):
    monkeypatch.setattr(snapshot, "NARROW", narrow)
    ids = sorted({f"{(k * k * 7919) % 65521:04x}{k % 10:02x}" for k in range(137)} | {"abc0", "abc01", "abc012", "abc0123", "abc01234", ""})
    rows = spark.createDataFrame([(x, 1) for x in ids], "txid string, vsize int").repartition(5)
    for number in (-1, 0, 1, 5, 13, 14, 99):
        page = snapshot.page(rows, number, 10)
        at = min(max(number, 0), (len(ids) - 1) // 10)
        got = page.collect()
        assert [r.txid for r in got] == ids[10 * at : 10 * at + 10]
        assert {(r.page, r.first_match, r.last_match) for r in got} == {(at, 10 * at + 1, min(len(ids), 10 * at + 10))}
    assert "rangepartitioning" not in page._jdf.queryExecution().executedPlan().toString()


def test_page_of_nothing(spark):
    assert snapshot.page(spark.createDataFrame([], "txid string, vsize int"), 3).collect() == []


# ---- lenses ----------------------------------------------------------------------------------------------------------


def lens(name, *needs):
    return catalog.Lens(name, "1", "exact", "multi_label", (), ("x",), None, needs)


def test_lenses_come_after_what_they_need():
    assert [x.classifier_id for x in catalog.planned([lens("a", "c"), lens("b"), lens("c", "b"), lens("d", "a", "b")])] == ["b", "c", "a", "d"]
    assert [x.classifier_id for x in catalog.planned(catalog.CATALOG)] == ["transaction_properties", "data_protocols", "transaction_shape", "knots_bip110"]


@pytest.mark.parametrize("lenses, message", [([lens("a", "b"), lens("b", "a")], "need each other"), ([lens("a", "z")], "needs z"), ([lens("a", "a")], "need each other")])
def test_needs_that_cant_be_met(lenses, message):
    with pytest.raises(ValueError, match=message):
        catalog.planned(lenses)


# ---- bodies ----------------------------------------------------------------------------------------------------------


def test_one_spoilt_body_stops_nothing(spark):
    entry = '{"txid":"' + "a" * 64 + '","wtxid":"' + "b" * 64 + '","vsize":100,"weight":400,"fee_sats":1,"entered_at_ms":5,"ancestor_count":1,"ancestor_vsize":100,"ancestor_fee_sats":1,"descendant_count":1,"descendant_vsize":100,"replaceable":true,"structure":null,"classifications":null,"bip110":null}'
    body = lambda **x: "{" + ",".join(f'"{k}":{v}' for k, v in ({"source_id": '"s"', "generation": 1, "revision": 0, "observed_at_ms": 9, "tip_height": 7, "tip_hash": '"h"', "count": 1, "total_vsize": 100, "transactions": f"[{entry}]"} | x).items() if v is not None) + "}"
    rows = [
        ("good", body()), ("wrong_total", body(total_vsize=99, generation=2)), ("cut", body()[:-9]), ("null", None), ("empty", ""), ("list", "[1]"), ("odd", body(odd=1)), ("odd_entry", body(transactions="[" + entry[:-1] + ',"odd":1}]')),
        ("type", body(count='"x"')), ("entry_type", body(transactions="[" + entry.replace('"vsize":100', '"vsize":"x"') + "]")), ("lacking", body(tip_hash=None)), ("twice", body()[:-1] + ',"count":1}'), ("no_entries", body(transactions="[]", count=0, total_vsize=0, generation=3)),
    ]
    heads, entries, rejects = published.read_published(spark.createDataFrame(rows, "name string, body string").repartition(3))
    assert {r.generation: r.reasons for r in heads.collect()} == {1: [], 2: ["total_vsize"], 3: []}
    assert sorted(r.generation for r in entries.collect()) == [1, 2]
    assert {r.name: r.reason for r in rejects.collect()} == {
        "cut": "not_json", "null": "not_json", "empty": "not_json", "list": "not_json", "odd": "unknown_member", "odd_entry": "unknown_member", "type": "wrong_type", "entry_type": "wrong_type", "lacking": "missing_member", "twice": "not_json",
    }
    assert rejects.columns == ["name", "reason"]
