import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from poolstrata.catalog import RULES
from poolstrata.functions import columns as C
from poolstrata.functions import scripts as S


def test_all_masks_round_trip(spark):
    masks = spark.range(1, 128).withColumn("rules", C.rules_of_mask(F.col("id").cast("int"))).withColumn("mask", C.rule_mask("rules"))
    assert masks.where("mask != id").count() == 0


def test_signatures(spark):
    rows = spark.createDataFrame([(["tapscript_op_if", "element_size"], []), (["element_size"], ["element_size"]), (["output_size"], [])], "v array<string>, u array<string>").withColumn("s", F.lit("violating"))
    got = rows.select(C.violation_signature("s", "v", "u").alias("key"), C.signature_label("v", "u").alias("label"), C.gray_rank(C.rule_mask("v")).alias("rank")).collect()
    assert [(r.key, r.label) for r in got] == [("exact:42", "R2 + R7"), ("partial:02:02", "Proven R2"), ("exact:01", "R1 only")]


def test_signature_order_is_gray_order(spark):
    rows = spark.createDataFrame([(m,) for m in (0x40, 0x42, 0x01)], "m int").withColumn("rank", C.gray_rank("m"))
    assert [r.m for r in rows.orderBy("rank").collect()] == [0x01, 0x42, 0x40]


def test_bands_and_bins(spark):
    rows = spark.createDataFrame([(1,), (2,), (4,), (26,)], "n int").select(C.relative_band("n").alias("b"))
    assert [r.b for r in rows.collect()] == ["alone", "one", "few", "many"]
    edges = spark.createDataFrame([(float(2**k),) for k in range(10)], "v double").select(C.log_bin("v", "fee_rate", 9).alias("b"))
    assert [r.b for r in edges.collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    odd = spark.createDataFrame([(0.0,), (-3.0,), (float("nan"),), (1e12,)], "v double").select(C.log_bin("v", "fee_rate", 9).alias("b"))
    assert [r.b for r in odd.collect()] == [0, 0, 0, 8]


def test_age_is_clamped(spark):
    assert spark.range(1).select(C.age_ms(F.lit(10), F.lit(20)).alias("a")).first().a == 0


def test_bucket_keys(spark):
    rows = spark.createDataFrame([("complete", ["gamma", "alpha"]), ("partial", []), (None, None)], "state string, labels array<string>")
    assert [r.k for r in rows.select(C.bucket_key("state", "labels", ("alpha", "beta", "gamma")).alias("k")).collect()] == ["complete:0.2", "partial:none", "unavailable"]


def test_profiles(spark):
    rows = spark.createDataFrame([("complete", ["p2pkh"]), ("complete", ["p2wpkh", "p2sh"]), ("partial", []), ("complete", ["op_return", "p2tr"]), (None, None)], "state string, labels array<string>")
    assert [r.k for r in rows.select(C.script_profile("state", "labels").alias("k")).collect()] == ["complete:profile_legacy", "complete:profile_mixed", "partial:profile_other", "complete:profile_taproot", "unavailable"]


def test_families(spark):
    h, h20 = "ab" * 32, "cd" * 20
    cases = {f"2102{h}ac": "p2pk", f"512102{h}2103{h}52ae": "bare_multisig", f"76a914{h20}88ac": "p2pkh", f"a914{h20}87": "p2sh", f"0014{h20}": "p2wpkh", f"0020{h}": "p2wsh", f"5120{h}": "p2tr", "51024e73": "p2a", "5204deadbeef": "unknown_witness_program", "6a": "op_return", "": "unknown_script", "ff": "unknown_script", "0003aabbcc": "unknown_witness_program", "5201aa": "unknown_script"}
    rows = spark.createDataFrame(list(cases.items()), "h string, want string").withColumn("s", F.unhex("h")).withColumn("d", S.decode("s"))
    for r in rows.select("h", "want", S.script_family("s").alias("native"), S.script_family("s", F.col("d")).alias("decoded")).collect():
        assert r.native == r.want == r.decoded, r.h


def test_arc4_of_many_rows():
    keys = [bytes(range(n, n + n % 40 + 1)) for n in range(150)] + [bytes(300 * [7])]
    texts = [bytes(n * n % 97) for n in range(150)] + [b"x" * 700]
    assert S.arc4_each(keys, texts) == [S.arc4(k, t) for k, t in zip(keys, texts, strict=True)]
    assert S.arc4_each([], []) == []


def test_known_arc4():
    assert S.arc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_instructions_cover_the_script(script):
    ok, ops = S.instructions(script)
    assert [o["pos"] for o in ops] == sorted(o["pos"] for o in ops)
    if ok:
        size = sum(1 if o["data"] is None else 1 + {0x4C: 1, 0x4D: 2, 0x4E: 4}.get(o["op"], 0) + len(o["data"]) for o in ops)
        assert size == len(script)


def test_canonical_push(spark):
    data = [b"a" * n for n in (1, 75, 76, 255, 256, 300)]
    from builders import push

    rows = spark.createDataFrame([(bytearray(push(d)), bytearray(d)) for d in data] + [(bytearray(b"\x4c\x01a"), bytearray(b"a"))], "s binary, d binary")
    assert [r.k for r in rows.select(S.canonical_single_push(F.col("s"), F.col("d")).alias("k")).collect()] == [True] * 6 + [False]


def test_rule_names():
    assert len(RULES) == 7
