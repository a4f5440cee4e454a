"""Keyed state, retry waves, slices and deployment windows on small written cases."""

import pytest
from builders import P2TR, P2WPKH, push, tx
from pyspark.sql import functions as F

from poolstrata.operators import deployments, slices
from poolstrata.streaming import keyed, state
from poolstrata.streaming.run import land, run_results, run_revisions

T0 = 1_700_000_000_000
CHANGE = [c.split(" ")[0] for c in keyed.CHANGE.split(", ")]


def member(seq, generation, wtxid, txid="t", source="a"):
    return source, txid, seq, T0 + 1000 * seq, "member", generation, 0, wtxid, None


def report(seq, generation, revision, wtxid, label, txid="t", source="a"):
    return source, txid, seq, T0 + 1000 * seq, "result", generation, revision, wtxid, label


def results(spark, *batches, keep=1_000_000):
    found, checkpoint = run_results(spark, land([spark.createDataFrame(b, keyed.CHANGE).coalesce(1) for b in batches], "in"), keep, 1)
    return {(r.source_id, r.txid): (r.generation, r.wtxid, r.revision, r.label) for r in found.collect()}, checkpoint


def test_result_survives_with_its_variant(spark):
    got, _ = results(spark, [member(1, 1, "w"), report(2, 1, 1, "w", "x"), member(1, 1, "v", "u"), report(2, 1, 1, "v", "y", "u")], [member(10, 2, "w"), member(10, 2, "v2", "u")], [report(11, 1, 9, "v", "stale", "u"), report(12, 1, 9, "w", "stale")])
    assert got == {("a", "t"): (2, "w", 0, "x"), ("a", "u"): (2, "v2", 0, None)}


def test_revisions_only_go_up(spark):
    got, _ = results(spark, [member(1, 1, "w"), report(2, 1, 2, "w", "two")], [report(3, 1, 1, "w", "one"), report(4, 1, 2, "w", "again")], [report(5, 1, 3, "w", "three"), report(6, 1, 4, "other", "no")])
    assert got == {("a", "t"): (1, "w", 3, "three")}


def test_sources_never_merge(spark):
    got, _ = results(spark, [member(1, 1, "w"), member(1, 5, "w", source="b")], [report(2, 1, 1, "w", "a's"), report(2, 5, 1, "w", "b's", source="b")])
    assert got == {("a", "t"): (1, "w", 1, "a's"), ("b", "t"): (5, "w", 1, "b's")}


def test_departed_state_is_gone(spark):
    got, checkpoint = results(spark, [member(1, 1, "w"), member(1, 1, "v", "u")], [member(60, 2, "v", "u")], [member(120, 3, "v", "u")], keep=100_000)
    assert got == {("a", "u"): (3, "v", 0, None)}
    state = spark.read.format("statestore").option("stateVarName", "variant").load(checkpoint)
    assert [tuple(r.key) for r in state.collect()] == [("a", "u")]


def test_a_transaction_that_comes_back_starts_anew(spark):
    first, last = [member(1, 1, "w"), report(2, 1, 1, "w", "x")], [member(200, 3, "w")]
    for batches in ((first, last), (first + last,), (first, [member(150, 2, "z", "other")], last)):
        assert results(spark, *batches, keep=100_000)[0][("a", "t")] == (3, "w", 0, None)


@pytest.mark.parametrize("cuts", [(3,), (1, 5), (2, 4, 6, 8)])
def test_cuts_between_batches_change_nothing(spark, cuts):
    rows = [member(1, 1, "w"), report(2, 1, 1, "w", "x"), report(3, 1, 2, "w", "y"), member(4, 2, "w"), report(5, 1, 3, "w", "no"), report(6, 2, 1, "w", "z"), member(7, 1, "q"), member(8, 3, "q"), report(9, 3, 1, "q", "end")]
    edges = [0, *cuts, len(rows)]
    assert results(spark, *(rows[a:b] for a, b in zip(edges, edges[1:])))[0] == {("a", "t"): (3, "q", 1, "end")}


def event(seq, kind, generation=None, revision=0, changed=0, lifecycle=None, error=None, source="a"):
    return source, seq, kind, generation, revision, changed, lifecycle, error


def test_one_revision_for_every_kind(spark):
    batches = [
        [event(1, "failure", error="down"), event(2, "poll", 1), event(3, "delta", 1, 1, 4)],
        [event(4, "delta", 1, 1, 4), event(5, "delta", 1, 3, 1), event(6, "delta", 1, 2, 0), event(7, "lifecycle", 1, lifecycle="paused"), event(8, "lifecycle", 1, lifecycle="paused")],
        [event(9, "failure", error="timeout"), event(10, "poll", 1), event(11, "poll", 2), event(12, "lifecycle", 1, lifecycle="complete"), event(13, "lifecycle", 2, lifecycle="complete"), event(1, "poll", 7, source="b")],
    ]
    rows, _ = run_revisions(spark, land([spark.createDataFrame(b, keyed.EVENT).coalesce(1) for b in batches], "events"), 1)
    got = sorted((r.source_id, r.response_revision, r.seq, r.cause, r.availability, r.lifecycle, r.last_error) for r in rows.collect())
    assert got == [
        ("a", 1, 1, "failure", "error", None, "down"), ("a", 2, 2, "poll", "ready", "classifying", None), ("a", 3, 3, "delta", "ready", "classifying", None), ("a", 4, 7, "lifecycle", "ready", "paused", None),
        ("a", 5, 9, "failure", "stale", "paused", "timeout"), ("a", 6, 11, "poll", "ready", "classifying", None), ("a", 7, 13, "lifecycle", "ready", "complete", None), ("b", 1, 1, "poll", "ready", "classifying", None),
    ]


def test_polls_that_cant_be_folded(spark, tmp_path):
    rows = [("a", 1, True, 10, 5, None), ("a", 2, True, None, 5, None), ("a", 3, True, 30, None, None), ("a", None, True, 40, 5, None), (None, 5, True, 50, 5, None), ("a", 6, None, 60, 5, None), ("a", 7, True, -1, 5, None), ("b", None, False, None, None, "down")]
    polls = spark.createDataFrame(rows, state.POLL)
    assert sorted(r.reasons for r in state.rejected_polls(polls).collect()) == [["entries"], ["generation"], ["observed_at"], ["observed_at"], ["outcome"], ["source"]]
    folder = land([polls.coalesce(1)], "polls")
    seen = []
    stream = state.source_status(spark.readStream.schema(state.POLL).parquet(folder))
    stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    plain = lambda rows: sorted((r.source_id, r.generation, r.observed_at_ms, r.n_entries, r.last_error, r.availability, r.response_revision) for r in rows)
    assert plain(seen) == plain(state.source_status(polls).collect()) == [("a", 1, 10, 5, None, "ready", 1), ("b", -1, None, None, "down", "error", 1)]


# ---- retry waves -----------------------------------------------------------------------------------------------------


def waves(spark, candidates, raw, needs, facts):
    key = "source_id string, txid string, wtxid string"
    frames = (
        spark.createDataFrame([("a", x, x, p) for x, p in candidates], f"{key}, priority int"), spark.createDataFrame([("a", *r) for r in raw], "source_id string, wtxid string, ask int, outcome string"),
        spark.createDataFrame([("a", x, x, p, 0) for x, p in needs], f"{key}, prev_txid string, prev_vout bigint"), spark.createDataFrame([("a", p, 0, n, o) for p, n, o in facts], "source_id string, prev_txid string, prev_vout bigint, ask int, outcome string"),
    )
    return {r.txid: (r.status, r.raw_asks, r.wave, r.fact_asks, r.retryable) for r in slices.retry_waves(*frames).collect()}


def test_raw_lookup_again_once(spark):
    got = waves(spark, [("x", 0), ("y", 0), ("z", 0)], [("x", 1, "retryable"), ("x", 2, "found"), ("y", 1, "retryable"), ("y", 2, "retryable"), ("y", 3, "found"), ("z", 1, "null")], [], [])
    assert got == {"x": ("classified", 2, 2, 0, False), "y": ("unavailable", 2, 2, 0, False), "z": ("unavailable", 1, 1, 0, False)}


def test_fresh_before_retryable(spark):
    got = waves(spark, [("x", 0), ("y", 1)], [("x", 1, "retryable"), ("x", 2, "found"), ("y", 1, "found")], [], [])
    assert got["x"][2] == 2 and got["y"] == ("classified", 1, 3, 0, False)


def test_two_attempts_a_fact_shared_by_variants(spark):
    found = [(x, 1, "found") for x in "wxyz"]
    got = waves(spark, [(x, 0) for x in "wxyz"], found, [("w", "p"), ("x", "p"), ("x", "q"), ("y", "q"), ("z", "r")], [("p", 1, "retryable"), ("p", 2, "found"), ("q", 1, "null"), ("r", 1, "retryable"), ("r", 2, "retryable"), ("r", 3, "found")])
    assert got == {"w": ("classified", 1, 1, 2, False), "x": ("classified", 1, 1, 3, True), "y": ("classified", 1, 1, 1, True), "z": ("deferred", 1, 1, 2, False)}


def test_no_candidates(spark):
    assert waves(spark, [], [("x", 1, "found")], [], []) == {}


# ---- slices ----------------------------------------------------------------------------------------------------------


def test_counters_of_a_slice(spark):
    asked = [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("a", 2, 4), ("a", 2, 5), ("b", 3, 6), ("b", 4, 7), ("b", 4, 8)]
    answers = [(1, 1, "found"), (1, 2, "systemic"), (3, 6, "found"), (4, 7, "found"), (4, 7, "found"), (4, 8, "found")]
    kept, report = slices.run_slice(spark.createDataFrame(asked, "source_id string, batch_id bigint, id bigint"), spark.createDataFrame(answers, "batch_id bigint, id bigint, fetch string"), ("a", "b", "c"))
    got = {r.source_id: tuple(r)[1:] for r in report.collect()}
    assert got == {"a": (5, 1, 4, 1, 3, 1, 0, "paused"), "b": (3, 1, 0, 0, 0, 0, 1, "paused"), "c": (0, 0, 0, 0, 0, 0, 0, "complete")}
    assert {(r.id, r.fetch) for r in kept.collect()} == {(1, "found"), (2, "systemic"), (3, "missing"), (4, "missing"), (5, "missing"), (6, "found"), (7, "failed"), (8, "failed")}


# ---- deployment windows ----------------------------------------------------------------------------------------------

ACTIVATION, EXPIRY = 900_000, 900_000 + deployments.ACTIVE_BLOCKS


@pytest.mark.parametrize(
    "branch, spend, applied",
    [("m", ACTIVATION - 1, False), ("m", ACTIVATION, True), ("m", EXPIRY - 1, True), ("m", EXPIRY, False), ("none", ACTIVATION, False), ("null", ACTIVATION, False), ("twice", ACTIVATION + 5, True), ("m", None, False), (None, ACTIVATION, False)],
)
def test_window(spark, branch, spend, applied):
    large = {"outputs": [(1, b"\x51" * 35)], "inputs": [{"script": P2TR, "witness": [b"\x01", b"\x50aa"], "height": ACTIVATION}]}
    t, o, i = tx(spark, {"t": large})
    where = spark.createDataFrame([("m", ACTIVATION), ("twice", ACTIVATION), ("twice", ACTIVATION + 5), ("null", None)], "branch string, activation_height int")
    rows = deployments.consensus_details(t.withColumn("branch", F.lit(branch).cast("string")).withColumn("spend_height", F.lit(spend).cast("int")), o, i, where).collect()
    assert len(rows) == 7 and {r.rules_applied for r in rows} == {applied}
    broken = {r.rule for r in rows if r.verdict == "violate"}
    old = branch == "twice"  # its coin is older than the later activation
    assert broken == ({"output_size"} | (set() if old else {"taproot_annex"}) if applied else set())


def test_coins_from_before_and_coinbase(spark):
    spend = lambda height: {"outputs": [(1, P2WPKH)], "inputs": [{"script": P2WPKH, "sig": push(b"x" * 300), "witness": [b"y" * 300], "height": height}]}
    t, o, i = tx(spark, {"old": spend(ACTIVATION - 1), "new": spend(ACTIVATION), "unsure": spend(None), "mint": {**spend(ACTIVATION), "coinbase": True, "outputs": [(1, b"\x51" * 40)]}})
    where = spark.createDataFrame([("m", ACTIVATION)], "branch string, activation_height int")
    rows = deployments.consensus_details(t.withColumn("branch", F.lit("m")).withColumn("spend_height", F.lit(ACTIVATION + 9)), o, i, where).collect()
    verdict = lambda name: {(r.rule, r.verdict) for r in rows if r.txid == name and r.verdict != "pass"}
    assert verdict("old") == set() and ("element_size", "violate") in verdict("new") and ("element_size", "unknown") in verdict("unsure")
    assert verdict("mint") == {("output_size", "violate")}
