import pytest
from pyspark.sql import functions as F

from poolstrata.streaming import state


def run_stream(spark, tmp_path, batches, schema, fold, keys=("source_id",)):
    """Feed batches as files one at a time; the last row of each key."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    seen = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))

        def keep(df, _):
            seen.update({tuple(r[c] for c in keys): r.asDict() for r in df.collect()})

        fold(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_polls(spark, tmp_path):
    batches = [
        [("a", 1, False, None, None, "down"), ("b", 1, True, 10, 3, None)],
        [("a", 2, True, 20, 5, None), ("b", 2, False, None, None, "timeout")],
        [("a", 2, True, 99, 9, None), ("b", 1, True, 98, 9, None)],
    ]
    got = run_stream(spark, tmp_path, batches, state.POLL, state.source_status)
    a, b = got["a",], got["b",]
    assert (a["availability"], a["observed_at_ms"], a["n_entries"], a["last_error"], a["dropped"]) == ("ready", 20, 5, None, 1)
    assert (b["availability"], b["observed_at_ms"], b["last_error"], b["dropped"], b["response_revision"]) == ("stale", 10, "timeout", 1, 2)


def test_poll_failure_first(spark):
    polls = spark.createDataFrame([("a", 1, False, None, None, "down")], state.POLL)
    row = state.status_of_polls(polls).first()
    assert row.availability == "error" and row.observed_at_ms is None and not state.is_ready(state.status_of_polls(polls)).first().ready


def test_revisions(spark, tmp_path):
    batches = [[("a", 1, 1, 5)], [("a", 1, 1, 5), ("a", 1, 2, 0)], [("a", 1, 2, 3), ("a", 1, 4, 1)], [("a", 2, 1, 2), ("a", 1, 3, 1)], [("a", 1, 4, 1)]]
    got = run_stream(spark, tmp_path, batches, state.DELTA, state.revisions)["a",]
    assert (got["generation"], got["revision"], got["applied"], got["changed"], got["error"]) == (2, 1, 4, 11, None)


def test_revision_gap_is_an_error(spark, tmp_path):
    got = run_stream(spark, tmp_path, [[("a", 1, 1, 5), ("a", 1, 3, 5)]], state.DELTA, state.revisions)["a",]
    assert got["revision"] == 1 and got["error"] == "gap: 3 after 1"


def test_repeats_within_a_batch(spark, tmp_path):
    rows = [("a", 1, 1, 0), ("a", 1, 1, 4), ("a", 1, 1, 9), ("a", 1, 2, 0), ("a", 1, 2, 0), ("a", 0, 1, 3)]
    got = run_stream(spark, tmp_path, [rows, [("a", 1, 2, 2), ("a", 1, 1, 7), ("a", 1, 4, 1), ("a", 1, 4, 1)]], state.DELTA, state.revisions)["a",]
    assert (got["revision"], got["applied"], got["ignored"], got["changed"], got["error"]) == (2, 3, 5, 9, "gap: 4 after 2")  # generation 0 comes first and applies


def test_merge_and_memory(spark):
    cols = "source_id string, txid string, generation bigint, revision bigint, label string"
    now = spark.createDataFrame([("a", "x", 2, 1, "old"), ("a", "y", 1, 9, "gone")], cols)
    delta = spark.createDataFrame([("a", "x", 2, 2, "new"), ("a", "z", 2, 2, "z")], cols)
    assert {(r.txid, r.label) for r in state.merge_results(now, delta).collect()} == {("x", "new"), ("z", "z")}
    known = spark.createDataFrame([("p", 0, bytearray(b"1")), ("q", 0, bytearray(b"1"))], "prev_txid string, prev_vout bigint, script binary")
    answers = spark.createDataFrame([("p", 0, bytearray(b"2"), "found"), ("r", 0, None, "null"), ("s", 1, bytearray(b"3"), "found")], "prev_txid string, prev_vout bigint, script binary, fetch string")
    assert {r.prev_txid for r in state.remember_scripts(known, answers).collect()} == {"q", "s"}


def test_lifecycle_and_retry(spark):
    progress = spark.createDataFrame([("a", 1, 0), ("b", 1, 4), ("c", 2, 4)], "source_id string, generation bigint, unclassified bigint")
    paused = spark.createDataFrame([("c", 2, True), ("b", 0, True)], "source_id string, generation bigint, paused boolean")
    assert {r.source_id: r.lifecycle for r in state.lifecycle(progress, paused).collect()} == {"a": "complete", "b": "classifying", "c": "paused"}
    facts = spark.createDataFrame([("ready", 0), ("explicitly_missing", 1), ("pending", 2)], "fact_state string, attempts int")
    assert [(r.fact_state, r.attempts) for r in state.retry_set(facts).collect()] == [("explicitly_missing", 2)]
    assert state.changed_since(spark.createDataFrame([("a", 3), ("b", 5)], "source_id string, response_revision bigint"), 4).select(F.col("source_id")).first()[0] == "b"


@pytest.mark.parametrize("few", [(), (300,)])
def test_polls_follow_their_events_whatever_file_holds_them(spark, tmp_path, few):
    from poolstrata.plans.queries import polls
    from poolstrata.streaming.run import status_stream

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(9, -1, -1):  # the newest come first
        events.where(f"event_id div 100 = {k}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events.parquet")
    want = state.status_of_polls(polls(spark, "/root/testdata/sf0.001")).select("source_id", "generation", "last_error", "availability", "dropped", "response_revision")
    assert sorted(status_stream(spark, f"file://{tmp_path}", *few).collect()) == sorted(want.collect())
