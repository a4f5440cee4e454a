"""Keyed state of streams: one state row for each transaction of a source, kept by the ids' prefixes, and one revision for each source.

Both are ``transformWithState`` processors over the RocksDB store, so state lives on the executors' disks and in the checkpoint, and a
micro-batch touches only the keys that it has rows of. Rows carry ``seq``, the order of arrival within a source; a key's
rows of one micro-batch are taken in that order, so where micro-batches begin and end changes nothing. These rows are held while they
are put in order: a few for a transaction; for a source its polls, deltas and lifecycle changes, whose number the trigger's file limit bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import _status_of

CHANGE = "source_id string, txid string, seq bigint, at_ms bigint, kind string, generation bigint, revision bigint, wtxid string, label string"
RESULT = "source_id string, txid string, seq bigint, generation bigint, wtxid string, revision bigint, label string, present boolean"
HELD_STATE = "txid string, seq bigint, generation bigint, wtxid string, revision bigint, label string, due_ms bigint"
VARIANT_STATE = "seq bigint, generation bigint, wtxid string, revision bigint, label string, due_ms bigint"
EVENT = "source_id string, seq bigint, kind string, generation bigint, revision bigint, n_changed bigint, lifecycle string, error string"
RAISED = "source_id string, response_revision bigint, seq bigint, cause string, generation bigint, classification_revision bigint, lifecycle string, availability string, last_error string"
SOURCE_STATE = "response_revision bigint, generation bigint, classification_revision bigint, lifecycle string, last_error string"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within this keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


class CurrentResults(StatefulProcessor):
    """The current witness variant of one transaction of one source, and its result.

    A ``member`` row of a newer generation than the held one refreshes the transaction: the result stays if the variant is the same, else
    it goes; an older or equal generation is dropped. A ``result`` row counts if it is of the held generation and variant and of
    a newer revision; reports of a replaced generation or of another variant are dropped. A transaction that no generation has refreshed for
    ``keep_ms`` of arrival time has departed: its state goes when the watermark has passed that, and rows that
    arrive later find none, whether the timer has fired by then or not. What is held always has a timer at its due time or before: one that
    fires too early is set anew, so that a refresh costs no timer.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.variant = handle.getValueState("variant", VARIANT_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = held = self.variant.get()
        for row in sorted(rows, key=lambda r: r.seq):  # of one transaction: a few for each generation
            if held and row.at_ms >= held[5]:
                held = None
            held = self.member(held, row) if row.kind == "member" else self.result(held, row)
        if held == before:
            return
        if held is None:
            self.variant.clear()
            yield self.gone(key, before)
            return
        if before is None:
            self.handle.registerTimer(held[5])
        self.variant.update(held)
        yield Row(source_id=key[0], txid=key[1], seq=held[0], generation=held[1], wtxid=held[2], revision=held[3], label=held[4], present=True)

    def member(self, held: tuple | None, row: Row) -> tuple:
        if held and row.generation <= held[1]:
            return held
        same = held is not None and held[2] == row.wtxid
        return row.seq, row.generation, row.wtxid, 0, held[4] if same else None, row.at_ms + self.keep_ms

    def result(self, held: tuple | None, row: Row) -> tuple | None:
        if held is None or row.generation != held[1] or row.wtxid != held[2] or row.revision <= held[3]:
            return held
        return row.seq, held[1], held[2], row.revision, row.label, held[5]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.variant.get()
        if held is None:
            return
        if held[5] > max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()):
            self.handle.registerTimer(held[5])
            return
        self.variant.clear()
        yield self.gone(key, held)

    def gone(self, key, held: tuple) -> Row:
        return Row(source_id=key[0], txid=key[1], seq=held[0], generation=held[1], wtxid=held[2], revision=held[3], label=None, present=False)

    def close(self) -> None:
        pass


class ResultsByPrefix(CurrentResults):
    """``CurrentResults`` of the transactions of one source whose ids share a prefix: their states are read in one call and written in one, and a timer serves
    them all. It stands at the earliest due time or before: as arrival never runs back, what is held anew is due after what is held already."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.variant = handle.getListState("variant", HELD_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.all_held()
        after, seen = dict(before), {}
        for row in sorted(rows, key=lambda r: r.seq):
            held = after.get(row.txid)
            if held and row.at_ms >= held[5]:
                held = None
            after[row.txid] = self.member(held, row) if row.kind == "member" else self.result(held, row)
            seen[row.txid] = None
        changed = [txid for txid in seen if after[txid] != before.get(txid)]
        if not changed:
            return
        self.keep({txid: held for txid, held in after.items() if held is not None}, not before)
        for txid in changed:
            held = after[txid]
            if held is None:
                yield self.gone((key[0], txid), before[txid])
            else:
                yield Row(source_id=key[0], txid=txid, seq=held[0], generation=held[1], wtxid=held[2], revision=held[3], label=held[4], present=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now = self.all_held(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = [txid for txid, state in held.items() if state[5] <= now]
        left = {txid: state for txid, state in held.items() if state[5] > now}
        if due:
            self.keep(left, True)
        elif left:
            self.handle.registerTimer(min(state[5] for state in left.values()))
        for txid in due:
            yield self.gone((key[0], txid), held[txid])

    def all_held(self) -> dict[str, tuple]:
        return {row[0]: tuple(row[1:]) for row in self.variant.get()}

    def keep(self, held: dict[str, tuple], arm: bool) -> None:
        if not held:
            self.variant.clear()
            return
        self.variant.put([(txid, *state) for txid, state in held.items()])
        if arm:
            self.handle.registerTimer(min(state[5] for state in held.values()))


def current_results(changes: DataFrame, keep_ms: int, prefix: int = 3) -> DataFrame:
    """A row for each transaction that a micro-batch changes, ``present`` false where it departs. changes: a stream of ``CHANGE`` rows,
    whose ``at_ms``, the time of arrival, never runs back within the stream. prefix: how many characters of an id tell which transactions' states are kept
    together; a micro-batch writes those of the prefixes that it changes, and a checkpoint goes on with the number that it began with."""
    stream = changes.withColumns({"event_at": F.timestamp_millis("at_ms"), "prefix": F.substring("txid", 1, prefix)}).withWatermark("event_at", "0 seconds")
    return stream.groupBy("source_id", "prefix").transformWithState(ResultsByPrefix(keep_ms), RESULT, "Update", "EventTime")


class Revisions(StatefulProcessor):
    """One response revision for each source over all that changes what readers see: membership, failures of polls, classification and lifecycle.

    ``poll`` of a newer generation replaces the snapshot, clears the error and restarts the lifecycle; others are dropped. ``failure`` keeps
    the snapshot and sets the error. ``delta`` must be of the held generation and the next revision, and change something; repeats are
    dropped and gaps change nothing. ``lifecycle`` counts if it is of the held generation and another one than the held.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.source = handle.getValueState("source", SOURCE_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        revision, *held = self.source.get() if self.source.exists() else (0, None, 0, None, None)
        first = revision
        for row in sorted(rows, key=lambda r: r.seq):
            after = self.step(held, row)
            if after is None:
                continue
            revision, held = revision + 1, after
            generation, classified, lifecycle, error = held
            yield Row(source_id=key[0], response_revision=revision, seq=row.seq, cause=row.kind, generation=generation, classification_revision=classified, lifecycle=lifecycle, availability=_status_of(generation is not None, error), last_error=error)
        if revision > first:
            self.source.update((revision, *held))

    @staticmethod
    def step(held: list, row: Row) -> list | None:
        """What is held after a row that readers notice, or None."""
        generation, classified, lifecycle, error = held
        if row.kind == "failure":
            return [generation, classified, lifecycle, row.error]
        if row.kind == "poll":
            return [row.generation, 0, "classifying", None] if generation is None or row.generation > generation else None
        if generation is None or row.generation != generation:
            return None
        if row.kind == "delta":
            return [generation, row.revision, lifecycle, error] if row.revision == classified + 1 and row.n_changed > 0 else None
        return [generation, classified, row.lifecycle, error] if row.kind == "lifecycle" and row.lifecycle != lifecycle else None

    def close(self) -> None:
        pass


def response_revisions(events: DataFrame) -> DataFrame:
    """A row for each change of each source that readers notice, with the revision that it raises. events: a stream of ``EVENT`` rows."""
    return events.groupBy("source_id").transformWithState(Revisions(), RAISED, "Append", "None")
