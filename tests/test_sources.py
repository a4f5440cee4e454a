import json

import pytest
from builders import P2WPKH, push
from pyspark.sql import functions as F

from poolstrata.schemas import ENVELOPE
from poolstrata.sources import captures, published, transactions


def member(**facts):
    base = {"wtxid": "B" * 64, "vsize": 200, "weight": 800, "time": 1721234000, "height": 1, "ancestorcount": 1, "ancestorsize": 200, "descendantcount": 1, "descendantsize": 200, "bip125-replaceable": True, "fees": {"base": 0.000012, "modified": 1, "ancestor": -0.000005}}
    return base | facts


def envelopes(spark, *bodies, tips=None):
    rows = [("node", "Node", 1000, 2000 + k, (5, "C" * 64), (5, "c" * 64) if not tips else tips[k], 1, body) for k, body in enumerate(bodies)]
    return spark.createDataFrame(rows, ENVELOPE)


def test_members(spark):
    body = json.dumps({"A" * 64: member()}).replace("1.2e-05", "0.00001200").replace("-5e-06", "-0.00000500")
    row = captures.scan_members(envelopes(spark, body)).first()
    assert (row.txid, row.wtxid, row.fee_sats, row.ancestor_fee_sats, row.entered_at_ms) == ("a" * 64, "b" * 64, 1200, -500, 1721234000000)
    twice = body[:-1] + "," + body[1:]
    assert captures.scan_members(envelopes(spark, twice)).count() == 2


def test_tip_gate(spark):
    tips = [(5, "c" * 64), (6, "c" * 64), (5, "d" * 64)]
    got = captures.snapshot_headers(envelopes(spark, "{}", "{}", "{}", tips=tips)).orderBy("generation").collect()
    assert [r.accepted for r in got] == [True, False, False] and got[1].reasons == ["tip_moved"]


def test_five_outcomes(spark):
    body = '[{"id":1,"result":"00aa"},{"id":2,"result":null},{"id":3},{"id":4,"result":"00","error":{"code":-5,"message":"x"}},{"result":"00"},{"id":6,"result":null,"error":{"code":-28}},{"id":7,"error":"odd"}]'
    rows = spark.createDataFrame([(1, body), (2, "nonsense"), (3, "{}")], "batch_id int, body string")
    got = captures.batch_responses(rows)
    assert {r.id: r.outcome for r in got.where("batch_id = 1").collect()} == {1: "value", 2: "null", 3: "omitted", 4: "error", None: "malformed", 6: "error", 7: "malformed"}
    assert [r.outcome for r in got.where("batch_id > 1").collect()] == ["malformed", "malformed"]
    fetched = captures.raw_transaction_outcomes(got)
    assert {r.id: r.fetch for r in fetched.where("batch_id = 1 and id is not null").collect()} == {1: "found", 2: "retryable", 3: "retryable", 4: "retryable", 6: "systemic", 7: "retryable"}
    utxo = captures.utxo_outcomes(captures.batch_responses(spark.createDataFrame([(1, '[{"id":1,"result":{"scriptPubKey":{"hex":"51"}}},{"id":2,"result":null},{"id":3}]')], "batch_id int, body string")))
    assert {r.id: r.fetch for r in utxo.collect()} == {1: "found", 2: "null", 3: "retryable"}
    assert {r.batch_id: r.paused for r in captures.batch_health(fetched).collect()} == {1: True, 2: False, 3: False}


def serialise(witness=()):
    body = b"\x01" + bytes(32) + (0).to_bytes(4, "little") + push(b"\x51") + b"\xff" * 4 + b"\x01" + (1000).to_bytes(8, "little") + push(P2WPKH)
    wit = bytes([len(witness)]) + b"".join(map(push, witness))
    return b"\x02\0\0\0" + (b"\0\x01" if witness else b"") + body + (wit if witness else b"") + b"\0\0\0\0"


@pytest.mark.parametrize("witness", [(), (b"ab", b"c")])
def test_decode_round_trip(witness):
    got = transactions.decode(serialise(witness))
    assert got["outputs"] == [{"value_sats": 1000, "script": P2WPKH}] and got["inputs"][0]["witness"] == list(witness) and got["inputs"][0]["script_sig"] == b"\x51"
    assert (got["txid"] == got["wtxid"]) is (not witness) and got["base_size"] == len(serialise())
    assert got["txid"] == transactions.decode(serialise())["txid"]


def test_decode_rejects(spark):
    raw = serialise()
    good = transactions.decode(raw)
    rows = [(good["txid"], good["wtxid"], bytearray(raw)), ("00", good["wtxid"], bytearray(raw)), ("11", "11", bytearray(raw[:-2])), ("22", "22", bytearray(raw + b"x")), ("33", "33", None)]
    ok, bad = transactions.decode_transactions(spark.createDataFrame(rows, "txid string, wtxid string, raw binary"))
    assert ok.count() == 1 and {r.txid: r.reason for r in bad.collect()} == {"00": "id mismatch", "11": "the transaction ends early", "22": "bytes after the transaction", "33": "the transaction ends early"}
    nested = transactions.with_coinbase(ok)
    assert not nested.first().is_coinbase and transactions.exploded_inputs(nested, ["txid"]).count() == 1 and transactions.exploded_outputs(nested, ["txid"]).first().value_sats == 1000


def test_snapshot_round_trip(spark, tmp_path):
    from test_operators import entries, entry

    empty = "struct<input_count: bigint, output_count: bigint, op_return_bytes: bigint, output_sats: bigint, witness_bytes: bigint>"
    rows = entries(spark, entry(n=1), entry(n=2)).withColumn("structure", F.lit(None).cast(empty)).withColumn("classifications", F.expr("cast(null as array<struct<classifier_id: string, state: string, primary_label: string, labels: array<string>, missing_facts: array<string>>>)")).withColumn("bip110", F.expr("cast(null as struct<status: string, primary_rule: string, violated_rules: array<string>, unknown_rules: array<string>>)"))
    published.write_entries(rows, str(tmp_path / "entries"))
    assert published.read_entries(spark, str(tmp_path / "entries")).count() == 2
    headers = spark.createDataFrame([("s", 1, 4, 99, 900000, "t")], "source_id string, generation bigint, revision bigint, observed_at_ms bigint, tip_height bigint, tip_hash string")
    bodies = published.snapshot_json(headers, rows)
    head, back = published.read_snapshots(bodies)
    assert head.first().reasons == [] and back.count() == 2
    wrong = bodies.withColumn("body", F.replace("body", F.lit('"total_vsize":400'), F.lit('"total_vsize":401')))
    assert published.read_snapshots(wrong)[0].first().reasons == ["total_vsize"]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        published.read_snapshots(spark.createDataFrame([("{oops",)], "body string"))[0].collect()
