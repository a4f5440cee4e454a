import pytest
from pyspark.sql import functions as F

from poolstrata.catalog import CATALOG, Lens, catalog_frame, register
from poolstrata.operators import buckets, compare, distributions, quality, resolve, snapshot

ENTRY = "source_id string, generation bigint, txid string, wtxid string, vsize bigint, weight bigint, fee_sats bigint, entered_at_ms bigint, ancestor_count bigint, ancestor_vsize bigint, ancestor_fee_sats bigint, descendant_count bigint, descendant_vsize bigint, replaceable boolean"


def entry(source="s", n=1, **facts):
    base = {"source_id": source, "generation": 1, "txid": f"{n:064x}", "wtxid": f"{n:064x}", "vsize": 200, "weight": 800, "fee_sats": 2000, "entered_at_ms": 1_700_000_000_000, "ancestor_count": 1, "ancestor_vsize": 200, "ancestor_fee_sats": 2000, "descendant_count": 1, "descendant_vsize": 200, "replaceable": False}
    return tuple((base | facts).values())


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def test_entry_checks(spark):
    rows = entries(spark, entry(n=1), entry(n=2, vsize=0, weight=0, ancestor_vsize=0, descendant_vsize=0), entry(n=3, weight=801), entry(n=4, ancestor_count=0), entry(n=5, ancestor_vsize=199), entry(n=6, fee_sats=1 << 53), entry(n=7, ancestor_fee_sats=-500), entry(n=8, txid="xyz"), entry(n=9, fee_sats=None))
    got = {int(r.wtxid, 16): r.reasons for r in quality.with_entry_reasons(rows).collect()}
    assert got[1] == got[7] == [] and "vsize_positive" in got[2] and got[3] == ["weight_range"] and got[4] == ["counts_positive"] and got[5] == ["relatives_include_self"] and got[6] == got[9] == ["safe_integers"] and got[8] == ["ids"]


def test_duplicates_order_and_sources(spark):
    rows = entries(spark, entry(n=1), entry(n=1, wtxid="f" * 64), entry(n=2))
    assert [(r.kind, r.n) for r in quality.duplicate_ids(rows).collect()] == [("txid", 2)]
    placed = rows.withColumn("position", F.when(F.col("wtxid") == "f" * 64, 3).otherwise(F.col("txid").substr(64, 1).cast("int")))
    assert quality.order_violations(placed).count() == 1
    s = spark.createDataFrame([("ok-1", "Node"), ("..", "Node"), ("a b", " ")], "source_id string, source_label string").select("source_id", quality.reasons(quality.source_checks()).alias("r"))
    assert {r.source_id: r.r for r in s.collect()} == {"ok-1": [], "..": ["source_id"], "a b": ["source_id", "source_label"]}


def test_results_contract(spark):
    rows = spark.createDataFrame([(0, "transaction_properties", "complete", None, ["p2tr"], []), (1, "transaction_shape", "complete", "other_shape", [], []), (2, "data_protocols", "partial", "omni", ["runes", "runes", "nope"], []), (9, "unheard_of", "complete", None, ["x"], [])], "position int, classifier_id string, state string, primary_label string, labels array<string>, missing_facts array<string>")
    got = {r.classifier_id: r.reasons for r in quality.result_reasons(rows, catalog_frame(spark)).collect()}
    assert got == {"transaction_shape": ["complete_has_labels", "primary_is_label"], "data_protocols": ["partial_has_missing", "primary_is_label", "labels_declared", "labels_distinct"], "unheard_of": ["declared_classifier", "catalog_order", "labels_declared"]}


def test_assessment_and_coupling(spark):
    shape = "bip110 struct<status: string, primary_rule: string, violated_rules: array<string>, unknown_rules: array<string>>"
    rows = spark.createDataFrame([(("compatible", None, [], []),), (("compatible", None, ["output_size"], []),), (("violating", None, [], []),), (("indeterminate", None, [], ["op_success"]),), (("odd", None, [], []),)], shape)
    assert [r.ok for r in rows.select(quality.assessment_ok().alias("ok")).collect()] == [True, False, False, True, False]
    c = spark.createDataFrame([(1, 1, [1]), (None, None, None), (None, None, []), (1, None, [1])], "structure int, bip110 int, classifications array<int>")
    assert [r.ok for r in c.select(quality.coupled().alias("ok")).collect()] == [True, True, True, False]


def test_filters(spark):
    now = 1_700_000_000_000
    rows = entries(spark, entry(n=1, fee_sats=2000, vsize=200, entered_at_ms=now), entry(n=2, fee_sats=100), entry(n=3, vsize=100, fee_sats=2000, weight=400), entry(n=4, entered_at_ms=now - 7_200_000), entry(n=5, entered_at_ms=now + 3_600_000)).withColumn("observed_at_ms", F.lit(now).cast("bigint"))
    ids = lambda cond: sorted(int(r.txid, 16) for r in rows.where(cond).collect())
    assert ids(quality.user_filter(8.0, 150, 3_600_000)) == [1, 5] and ids(quality.user_filter(0, 0, 0)) == [1, 2, 3, 5] and ids(quality.user_filter()) == [1, 2, 3, 4, 5]
    assert ids(quality.txid_is(" " + f"{3:064X}" + " ")) == [3] and ids(quality.txid_is("zz")) == [] and ids(quality.txid_prefix("0" * 63 + "4")) == [4]


def test_facts(spark):
    inputs = spark.createDataFrame([("s", "t", "p", 0), ("s", "t", "p", 9), ("s", "u", "q", 0), ("s", "v", "c", 0), ("s", "w", "d", 0), ("s", "x", "r", 0)], "source_id string, txid string, prev_txid string, prev_vout bigint")
    membership = spark.createDataFrame([("s", "p"), ("s", "q"), ("s", "r")], "source_id string, txid string")
    outputs = spark.createDataFrame([("p", 0, bytearray(b"\x51"))], "txid string, vout bigint, script binary")
    utxo = spark.createDataFrame([("q", 0, "found", bytearray(b"\x52")), ("c", 0, "null", None), ("d", 0, "retryable", None), ("r", 0, "null", None)], "prev_txid string, prev_vout bigint, outcome string, script binary")
    got = resolve.resolve_inputs(inputs, membership, outputs, utxo)
    assert {(r.txid, r.prev_vout): (r.fact_state, r.is_parent) for r in got.collect()} == {("t", 0): ("ready", True), ("t", 9): ("pending", True), ("u", 0): ("ready", True), ("v", 0): ("explicitly_missing", False), ("w", 0): ("pending", False), ("x", 0): ("pending", True)}
    assert {r.txid for r in resolve.terminal_candidates(got).collect()} == {"u", "v"}


def test_reconcile(spark):
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "batch_id int, id int")
    got = spark.createDataFrame([(1, 1, "value", "x"), (2, 1, "value", "y"), (2, 1, "value", "z"), (2, 7, "null", None)], "batch_id int, id int, outcome string, value string")
    matched, errors = resolve.reconcile(asked, got)
    assert {(r.batch_id, r.id): r.outcome for r in matched.collect()}[1, 2] is None
    assert {(r.batch_id, r.reason) for r in errors.collect()} == {(2, "duplicate"), (2, "unexpected"), (2, "excess")}


def test_comparison(spark):
    rows = entries(spark, entry("l", 1, vsize=100), entry("l", 2, vsize=200), entry("l", 4, vsize=300), entry("r", 1, vsize=110, wtxid="e" * 64), entry("r", 3, vsize=400), entry("r", 4, vsize=350))
    got = compare.compare(rows, "l", "r")
    t = compare.totals(got).first()
    assert (t.n_union, t.n_common, t.n_left_only, t.n_right_only, t.common_left_vsize, t.common_right_vsize) == (4, 2, 1, 1, 400, 460)
    assert compare.differing_variants(got).first().n_differing == 1
    with pytest.raises(compare.NotComparable):
        compare.compare(rows, "l", "l")
    with pytest.raises(compare.NotComparable):
        compare.require_snapshots(rows, "l", "nowhere")
    long = compare.long_form(got)
    assert long.count() == 6 and compare.scope(long, "right_only", "left").count() == 0 and compare.long_form(got, "left").count() == 4
    assert compare.lookup(got, f"{4:064x}").first().place == 1


def test_sample_and_page(spark):
    rows = entries(spark, *(entry(n=n, vsize=100 + n) for n in range(30)))
    top = snapshot.sample(rows, 8, pinned=f"{3:064x}").collect()
    assert len(top) == 8 and f"{3:064x}" in {r.txid for r in top} and {int(r.txid, 16) for r in top} == {3, 29, 28, 27, 26, 25, 24, 23}
    page = snapshot.page(rows, 7, 20).collect()
    assert len(page) == 10 and (page[0].page, page[0].first_match, page[0].last_match) == (1, 21, 30)


def test_overflow_groups(spark):
    groups = spark.createDataFrame([("s", name, n, v, p) for p, (name, n, v) in enumerate([("alpha", 5, 500), ("beta", 4, 400), ("c", 1, 10), ("d", 1, 20), ("e", 1, 30)])], "source_id string, bucket string, n bigint, vsize bigint, place int")
    bar = {r.bucket: (r.weight, r.buckets) for r in buckets.composition_bar(groups, "vsize", 3).collect()}
    assert bar == {"alpha": (500, 1), "beta": (400, 1), "overflow": (60, 3)}
    kept = [r.bucket for r in buckets.panel_groups(groups, "vsize", 3).orderBy("place").collect()]
    assert kept == ["alpha", "beta", "e", "overflow"]


def test_panels_conserve(spark):
    rows = entries(spark, *(entry(n=n, vsize=65 + 37 * n, fee_sats=n * n, ancestor_count=1 + n % 30) for n in range(200))).withColumn("bucket", F.col("txid").substr(64, 1))
    assert {r.total for r in distributions.fee_spectrum(rows).collect()} == {200}
    cells = distributions.joint_density(rows).collect()
    whole = [r.weight for r in cells if r.col is None and r.row is None]
    assert whole == [200] and sum(r.weight for r in cells if r.col is not None and r.row is not None) == 200
    assert abs(sum(r.share for r in distributions.entanglement(rows).collect()) - 2) < 1e-9


def test_empty_tables(spark):
    none = entries(spark).withColumn("bucket", F.lit("x"))
    assert distributions.fee_spectrum(none).count() == 0 and snapshot.totals(none).count() == 0 and snapshot.page(none, 3).count() == 0
    assert compare.totals(compare.compare(none, "a", "b")).first().n_union == 0


def test_registry():
    with pytest.raises(ValueError):
        register(Lens("knots_bip110", "2", "policy", "rule_set", (), ("x",)))
    register(Lens("extra_lens", "1", "exact", "multi_label", (), ("x", "y")))
    assert CATALOG.pop().classifier_id == "extra_lens"


def test_carry_forward_wants_the_same_variant(spark):
    rows = entries(spark, entry(n=1), entry(n=2, wtxid="a" * 64))
    results = rows.select("source_id", "txid", F.lit(f"{1:064x}").alias("wtxid"), F.lit(1).alias("label"), F.lit(True).alias("retryable"), F.lit(1).alias("attempts"))
    assert snapshot.carry_forward(results, rows).count() == 1
    assert {r.priority for r in snapshot.work_set(rows, results).collect()} == {0, 1}
