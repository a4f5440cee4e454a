import pytest
from builders import P2PKH, P2SH, P2TR, P2WPKH, P2WSH, push, tx
from pyspark.sql import functions as F

from poolstrata.functions.scripts import arc4
from poolstrata.operators import lenses as L

TAP = b"\xc0" + b"\x01" * 32


def verdicts(spark, rows, **how):
    t, o, i = tx(spark, rows)
    details = L.rule_details(t, o, i, **how)
    out = {name: {} for name in rows}
    for r in details.collect():
        out[r.txid][r.number] = (r.verdict, r.evidence_count, r.missing_count)
    assessed = {r.txid: r.bip110 for r in L.assessments(details).collect()}
    return out, assessed


@pytest.fixture(scope="module")
def policy(spark):
    big, ok = b"x" * 257, b"x" * 256
    redeem_big = push(big)
    wrapped = b"\x51\x20" + b"\x09" * 32
    rows = {
        "script_34": {"outputs": [(1, b"\x00\x20" + b"a" * 32)]}, "script_35": {"outputs": [(1, b"\xff" * 35)]}, "return_83": {"outputs": [(1, b"\x6a" + b"a" * 82)]}, "return_84": {"outputs": [(1, b"\x6a" + b"a" * 83)]}, "empty_script": {"outputs": [(1, b"")]},
        "item_256": {"inputs": [{"script": P2WPKH, "witness": [ok]}]}, "item_257": {"inputs": [{"script": P2WPKH, "witness": [big]}]},
        "wsh_script_push": {"inputs": [{"script": P2WSH, "witness": [b"1", push(big)]}]}, "wsh_script_long": {"inputs": [{"script": P2WSH, "witness": [push(ok) * 2]}]},
        "v2": {"inputs": [{"script": b"\x52\x04dead", "witness": []}]}, "p2a_empty": {"inputs": [{"script": bytes.fromhex("51024e73")}]}, "p2a_witness": {"inputs": [{"script": bytes.fromhex("51024e73"), "witness": [b"1"]}]},
        "annex_key": {"inputs": [{"script": P2TR, "witness": [b"s" * 64, b"\x50a"]}]}, "leaf_c2": {"inputs": [{"script": P2TR, "witness": [b"\x51", b"\xc2" + b"\x01" * 32]}]},
        "control_257": {"inputs": [{"script": P2TR, "witness": [b"\x51", b"\xc0" + b"\x01" * 256]}]}, "control_289": {"inputs": [{"script": P2TR, "witness": [b"\x51", b"\xc0" + b"\x01" * 288]}]}, "control_unaligned": {"inputs": [{"script": P2TR, "witness": [b"\x51", b"\xc0" + b"\x01" * 300]}]},
        "success": {"inputs": [{"script": P2TR, "witness": [b"\xfe\x63", TAP]}]}, "op_if": {"inputs": [{"script": P2TR, "witness": [b"\x63\x68", TAP]}]}, "if_in_data": {"inputs": [{"script": P2TR, "witness": [push(b"\x63"), TAP]}]}, "v0_if": {"inputs": [{"script": P2WSH, "witness": [b"\x63\x68"]}]},
        "p2sh_redeem": {"inputs": [{"script": P2SH, "sig": push(redeem_big)}]}, "p2sh_arg": {"inputs": [{"script": P2SH, "sig": push(big) + push(b"\x51")}]}, "p2sh_not_push": {"inputs": [{"script": P2SH, "sig": b"\x76" + push(big)}]}, "p2sh_v1": {"inputs": [{"script": P2SH, "sig": push(wrapped), "witness": [b"1"]}]},
        "legacy": {"inputs": [{"script": P2PKH, "sig": push(big)}]}, "unknown": {"inputs": [{"script": None}]}, "late": {"inputs": [{"script": None}, {"script": P2WPKH, "witness": [big]}]}, "early": {"inputs": [{"script": P2WPKH, "witness": [big]}, {"script": None}]},
        "coinbase": {"coinbase": True, "inputs": [{"script": None, "prev": "00" * 32}], "outputs": [(1, b"\xff" * 35)]},
    }
    return verdicts(spark, rows)


CASES = {
    "script_34": {}, "script_35": {1}, "return_83": {}, "return_84": {1}, "empty_script": {}, "item_256": {}, "item_257": {2}, "wsh_script_push": {2}, "wsh_script_long": {}, "v2": {3}, "p2a_empty": {}, "p2a_witness": {3}, "annex_key": {4}, "leaf_c2": {3},
    "control_257": {}, "control_289": {5}, "control_unaligned": {}, "success": {6}, "op_if": {7}, "if_in_data": {}, "v0_if": {}, "p2sh_redeem": {2}, "p2sh_arg": {2}, "p2sh_not_push": {}, "p2sh_v1": {3}, "legacy": {2}, "unknown": {}, "late": {2}, "early": {2}, "coinbase": {1},
}


@pytest.mark.parametrize("name", CASES)
def test_rules(policy, name):
    found, _ = policy
    assert {n for n, v in found[name].items() if v[0] == "violate"} == set(CASES[name])


def test_unknown_and_primary(policy):
    found, assessed = policy
    assert {n for n, v in found["unknown"].items() if v[0] == "unknown"} == set(range(2, 8)) and found["unknown"][1][0] == "pass"
    assert assessed["unknown"].status == "indeterminate" and assessed["script_34"].status == "compatible"
    assert assessed["late"].primary_rule is None and assessed["late"].status == "violating" and "element_size" in assessed["late"].unknown_rules
    assert assessed["early"].primary_rule == "element_size"
    assert assessed["coinbase"].unknown_rules == [] and assessed["coinbase"].primary_rule == "output_size"


def test_consensus_mode(spark):
    big = [b"x" * 257]
    rows = {"old": {"inputs": [{"script": P2WPKH, "witness": big, "height": 999}]}, "new": {"inputs": [{"script": P2WPKH, "witness": big, "height": 1500}]}, "unsure": {"inputs": [{"script": P2WPKH, "witness": big}]}, "old_output": {"outputs": [(1, b"\xff" * 35)], "inputs": [{"script": P2WPKH, "height": 1}]}}
    found, assessed = verdicts(spark, rows, activation_height=1000)
    assert assessed["old"].status == "compatible" and assessed["new"].status == "violating" and assessed["unsure"].unknown_rules == ["element_size"] and assessed["old_output"].violated_rules == ["output_size"]


def labels(frame):
    return {r.txid: (r.state, r.labels, r.primary_label) for r in frame.collect()}


def test_data_protocols(spark):
    prev = "0f" * 32
    key = bytes.fromhex(prev)
    env = b"\x00\x63" + push(b"ord") + push(b"\x01") + push(b"text/plain") + b"\x00" + push(b'{"p" : "brc') + push(b'\n-20"}') + b"\x68"
    burn = b"\x02" + b"\x22" * 32
    multisig = lambda m, *keys: bytes([0x50 + m]) + b"".join(map(push, keys)) + bytes([0x50 + len(keys), 0xAE])
    chunk = lambda data: (lambda x: (b"\x02" + x[:31] + b"\x01", b"\x03" + x[31:62] + b"\x01"))(data.ljust(62, b"\0"))
    stamp, cp = arc4(key, b"xx" + b"stamp:abc".ljust(60, b"\0")), arc4(key, b"\x1cCNTRPRTY stamp:".ljust(62, b"\0"))
    plain = b"CNTRPRTYabc"
    rows = {
        "brc": {"inputs": [{"script": P2TR, "prev": prev, "witness": [env, TAP]}], "outputs": [(1, bytes.fromhex("6a5d0401020304"))]},
        "weak": {"inputs": [{"script": P2WSH, "witness": [bytes.fromhex("aa0063036f7264")]}]},
        "cp_return": {"inputs": [{"script": P2WPKH, "prev": prev}], "outputs": [(0, b"\x6a" + push(arc4(key, b"CNTRPRTYabcd")))]},
        "cp_plain": {"inputs": [{"script": P2WPKH, "prev": prev}], "outputs": [(0, b"\x6a" + push(b"CNTRPRTYabcd")), (0, b"\x6a" + push(b"xomni"))]},
        "omni": {"outputs": [(0, b"\x6a" + push(b"omni1234"))]},
        "stamps": {"inputs": [{"script": P2WPKH, "prev": prev}], "outputs": [(1, multisig(1, *chunk(stamp), burn))]},
        "both": {"inputs": [{"script": P2WPKH, "prev": prev}], "outputs": [(1, multisig(1, *chunk(cp), b"\x02" + b"\x77" * 32))]},
        "two_slots": {"inputs": [{"script": P2WPKH, "prev": prev}], "outputs": [(1, multisig(1, b"\x02" + b"\x66" * 32, (bytes([len(plain)]) + plain).ljust(33, b"\0")))]},
        "none": {},
    }
    t, o, i = tx(spark, rows)
    got = labels(L.data_protocols(t, L.detections(o, i)))
    want = {"brc": ["inscription", "brc20", "runes"], "weak": ["inscription"], "cp_return": ["counterparty"], "cp_plain": ["other_op_return"], "omni": ["omni"], "stamps": ["stamps"], "both": ["stamps", "counterparty"], "two_slots": ["counterparty"], "none": ["no_detected_protocol"]}
    # "stamps" as a three-slot output is also a counterparty candidate, but its stream has no envelope
    assert {k: v[1] for k, v in got.items()} == want and all(v[0] == "complete" for v in got.values()) and got["brc"][2] == "inscription"


def test_shapes(spark):
    five = [{"script": b"\x00\x14" + bytes([n]) * 20} for n in range(5)]
    outs = [(v, b"\x00\x14" + bytes([n + 50]) * 20) for n, v in enumerate((100, 100, 100, 7, 0))]
    rows = {"coinjoin": {"inputs": five, "outputs": outs}, "unknown": {"inputs": [*five[:4], {"script": None}], "outputs": outs}, "consolidation": {"inputs": five}, "batch": {"outputs": outs}, "other": {}, "other_unknown": {"inputs": [{"script": None}]}, "blocked": {"inputs": five, "outputs": [*outs, (0, b"\x6a")]}}
    t, o, i = tx(spark, rows)
    got = labels(L.transaction_shape(t, o, i, L.data_protocols(t, L.detections(o, i))))
    assert got["coinjoin"] == ("complete", ["possible_coinjoin"], "possible_coinjoin") and got["unknown"] == ("partial", [], None) and got["consolidation"][1] == ["consolidation"]
    assert got["batch"][1] == ["batch_payout"] and got["other"][1] == ["other_shape"] and got["other_unknown"] == ("partial", [], None) and got["blocked"][1] == ["other_shape"]


def test_properties_and_classify(spark):
    rows = {"a": {"version": 1, "inputs": [{"script": P2TR, "witness": [b"s", b"\x50"], "sequence": 1}], "outputs": [(40000, P2PKH), (9000, P2SH), (0, b"\x6a" + push(b"data"))]}, "b": {"version": 9, "inputs": [{"script": None}]}}
    t, o, i = tx(spark, rows)
    got = labels(L.transaction_properties(t, o, i))
    assert got["a"] == ("complete", ["version_1", "signals_rbf", "has_witness", "has_taproot_annex", "p2pkh", "p2sh", "p2tr", "op_return"], None)
    assert got["b"][:2] == ("partial", ["version_other", "p2wpkh"])
    full = {r.txid: r for r in L.classify(t, o, i).collect()}
    assert [c.classifier_id for c in full["a"].classifications] == ["transaction_properties", "transaction_shape", "data_protocols", "knots_bip110"]
    s = full["a"].structure
    assert (s.input_count, s.output_count, s.op_return_bytes, s.output_sats, s.witness_bytes) == (1, 3, 4, 49000, 2)
    assert full["b"].bip110.status == "indeterminate" and F is not None
