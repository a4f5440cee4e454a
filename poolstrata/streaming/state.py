"""Streams that keep each source's current state: polls, progressive deltas, lifecycle.

State is one row a source (status) or one row a witness variant (results); lateness is judged by generations and revisions,
as the sources keep current state and no history.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import availability

LAST = 1 << 53
POLL = "source_id string, generation bigint, ok boolean, observed_at_ms bigint, n_entries bigint, error string"
STATUS = "source_id string, generation bigint, observed_at_ms bigint, n_entries bigint, last_error string, availability string, dropped bigint, response_revision bigint"
STATUS_STATE = "generation bigint, observed_at_ms bigint, n_entries bigint, last_error string, dropped bigint, response_revision bigint"
DELTA = "source_id string, generation bigint, revision bigint, n_changed bigint"
REVISION = "source_id string, generation bigint, revision bigint, applied bigint, ignored bigint, error string, changed bigint"
REVISION_STATE = "generation bigint, revision bigint, applied bigint, ignored bigint, error string, changed bigint"


def latest_good(polls: DataFrame) -> DataFrame:
    """The good snapshot of the highest generation of each source (works on batches and on streams)."""
    return polls.where("ok").groupBy("source_id").agg(F.max_by(F.struct("generation", "observed_at_ms", "n_entries"), "generation").alias("snapshot")).select("source_id", "snapshot.*")


def _status_of(has: bool, error: str | None) -> str:
    return ("stale" if error else "ready") if has else ("error" if error else "waiting")


def reduce_polls(part: pd.DataFrame) -> tuple[pd.DataFrame, int, tuple | None]:
    """What a part of a source's polls comes down to: the first good poll of each generation, how many good polls there are, and
    the last failure with the number of failures."""
    good = part[part["ok"]].sort_values("observed_at_ms", kind="stable")
    bad = part[~part["ok"].astype(bool)]
    at = bad["observed_at_ms"].fillna(LAST)  # a failure without a time comes last
    last = (int(at.max()), bad["error"].loc[at.idxmax()], len(bad)) if len(bad) else None
    return good.drop_duplicates("generation"), len(good), last


def fold_polls(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Polls of one source in the order they arrive: a good one of a newer generation replaces the snapshot and clears the error, one of
    an older or equal generation is dropped. A failure has no generation: it keeps the snapshot and sets the error. The response
    revision goes up with every change of what readers see. A batch is reduced part by part, so what is held is a row for each of its
    generations."""
    generation, observed, n, error, dropped, revision = state.get if state.exists else (-1, None, None, None, 0, 0)
    first, failed, failures = None, None, 0
    for part in batches:
        good, count, bad = reduce_polls(part)
        dropped += count
        first = good if first is None else pd.concat([first, good]).sort_values("observed_at_ms", kind="stable").drop_duplicates("generation")
        if bad:
            failed, failures = max(failed or bad[:2], bad[:2], key=lambda x: x[0]), failures + bad[2]
    accepted_at = -1
    for row in first.sort_values("observed_at_ms", kind="stable").itertuples(index=False):
        if row.generation > generation:
            generation, observed, n, error, accepted_at = int(row.generation), int(row.observed_at_ms), int(row.n_entries), None, int(row.observed_at_ms)
            dropped, revision = dropped - 1, revision + 1
    revision += failures
    if failed and failed[0] > accepted_at:
        error = failed[1]
    state.update((generation, observed, n, error, dropped, revision))
    yield pd.DataFrame([[key[0], generation, observed, n, error, _status_of(observed is not None, error), dropped, revision]], columns=[c.split(" ")[0] for c in STATUS.split(", ")]).astype({"observed_at_ms": "Int64", "n_entries": "Int64", "last_error": "object"})


def poll_checks() -> dict[str, Column]:
    """What a poll must have: a source, and a good one a generation, a time and a count that are no less than 0."""
    there = lambda name: ~F.coalesce(F.col("ok"), F.lit(False)) | (F.coalesce(F.col(name), F.lit(-1)) >= 0)
    return {"source": F.col("source_id").isNotNull(), "outcome": F.col("ok").isNotNull(), "generation": there("generation"), "observed_at": there("observed_at_ms"), "entries": there("n_entries")}


def valid_polls(polls: DataFrame) -> DataFrame:
    """Polls that may be folded (of batches and of streams)."""
    return polls.where(reduce(Column.__and__, poll_checks().values()))


def rejected_polls(polls: DataFrame) -> DataFrame:
    """The other polls, with the reasons."""
    return polls.withColumn("reasons", F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in poll_checks().items())))).where(F.size("reasons") > 0)


def source_status(polls: DataFrame) -> DataFrame:
    """Status rows of a stream of polls, by the guards above, or of a table of polls (``status_of_polls``). Polls that aren't valid take no part."""
    polls = valid_polls(polls)
    if not polls.isStreaming:
        return status_of_polls(polls)
    return polls.groupBy("source_id").applyInPandasWithState(fold_polls, STATUS, STATUS_STATE, "update", GroupStateTimeout.NoTimeout)


def status_of_polls(polls: DataFrame) -> DataFrame:
    """What ``source_status`` reaches after all polls of a table. A generation is accepted if its first good poll comes before
    those of all later generations; the window runs over one row for each generation of a source."""
    good = polls.where("ok").groupBy("source_id", "generation").agg(F.min_by(F.struct("observed_at_ms", "n_entries"), "observed_at_ms").alias("p"), F.count("*").alias("times"))
    later = Window.partitionBy("source_id").orderBy(F.desc("generation")).rowsBetween(Window.unboundedPreceding, -1)
    first_later = F.min("p.observed_at_ms").over(later)
    marked = good.withColumn("accepted", first_later.isNull() | (F.col("p.observed_at_ms") < first_later))
    held = marked.groupBy("source_id").agg(F.max("generation").alias("generation"), F.max_by("p", "generation").alias("p"), F.sum("times").alias("n_good"), F.count_if("accepted").alias("n_accepted"))
    every = polls.groupBy("source_id").agg(F.count_if(~F.col("ok")).alias("n_bad"), F.max(F.when(~F.col("ok"), F.struct(F.coalesce("observed_at_ms", F.lit(LAST)).alias("observed_at_ms"), "error"))).alias("bad"))
    g = every.join(held, "source_id", "left")
    error = F.when(F.col("p").isNull() | (F.col("bad.observed_at_ms") > F.col("p.observed_at_ms")), F.col("bad.error"))
    return g.select(
        "source_id", F.coalesce("generation", F.lit(-1)).cast("bigint").alias("generation"), F.col("p.observed_at_ms").alias("observed_at_ms"), F.col("p.n_entries").alias("n_entries"), error.alias("last_error"),
        availability(F.col("p").isNotNull(), error.isNotNull()).alias("availability"), F.coalesce(F.col("n_good") - F.col("n_accepted"), F.lit(0)).alias("dropped"), (F.coalesce("n_accepted", F.lit(0)) + F.col("n_bad")).alias("response_revision"),
    )


def reduce_deltas(parts: pd.DataFrame) -> pd.DataFrame:
    """One row for each generation and revision: how many reports it has, and the first that changes something (else 0)."""
    changing = parts["n_changed"].where(parts["n_changed"] > 0)
    grouped = parts.assign(n_changed=changing).groupby(["generation", "revision"], sort=True, as_index=False).agg(n_changed=("n_changed", "first"), times=("times", "sum"))
    return grouped.fillna({"n_changed": 0})


def fold_deltas(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Classification deltas of one source: the next revision of the current generation applies (and counts only if something
    changed), a repeat is ignored, a gap is an error; a new generation starts at revision 0; reports of a replaced one are
    ignored. A batch is reduced part by part, so what is held is a row for each of its revisions."""
    generation, revision, applied, ignored, error, changed = state.get if state.exists else (-1, 0, 0, 0, None, 0)
    rows = None
    for part in batches:
        part = reduce_deltas(part.assign(times=1))
        rows = part if rows is None else reduce_deltas(pd.concat([rows, part]))
    for row in rows.itertuples(index=False):
        if row.generation > generation:
            generation, revision, error = int(row.generation), 0, None
        if row.generation < generation or row.revision <= revision:
            ignored += int(row.times)
        elif row.revision > revision + 1:
            error = f"gap: {row.revision} after {revision}"
        elif row.n_changed > 0:
            revision, applied, ignored, changed = revision + 1, applied + 1, ignored + int(row.times) - 1, changed + int(row.n_changed)
        else:
            ignored += int(row.times)
    state.update((generation, revision, applied, ignored, error, changed))
    yield pd.DataFrame([[key[0], generation, revision, applied, ignored, error, changed]], columns=[c.split(" ")[0] for c in REVISION.split(", ")])


def revisions(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("source_id").applyInPandasWithState(fold_deltas, REVISION, REVISION_STATE, "update", GroupStateTimeout.NoTimeout)


def merge_results(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Upsert for foreachBatch: of each variant the row of the highest revision; rows of a replaced generation are dropped."""
    rows = current.unionByName(delta)
    newest = rows.groupBy("source_id").agg(F.max("generation").alias("generation"))
    kept = rows.join(F.broadcast(newest), ["source_id", "generation"])
    payload = [c for c in rows.columns if c not in ("source_id", "txid")]
    return kept.groupBy("source_id", "txid").agg(F.max_by(F.struct(*payload), "revision").alias("r")).select("source_id", "txid", "r.*")


def remember_scripts(known: DataFrame, answers: DataFrame) -> DataFrame:
    """Positive facts that persist: found scripts, old and new; nulls and failures never enter, contested outpoints leave."""
    from ..operators.quality import agreed_scripts

    found = answers.where("fetch = 'found'").select("prev_txid", "prev_vout", "script")
    return agreed_scripts(known.select("prev_txid", "prev_vout", "script").unionByName(found))


def retry_set(facts: DataFrame, most: int = 2) -> DataFrame:
    """Facts to ask for again in the next generation: explicitly missing or failed ones with attempts left."""
    return facts.where(F.col("fact_state").isin("explicitly_missing", "pending") & (F.col("attempts") < most)).withColumn("attempts", F.col("attempts") + 1)


def lifecycle(progress: DataFrame, paused: DataFrame) -> DataFrame:
    """classifying, complete or paused for each source's current generation."""
    stop = paused.where("paused").select("source_id", "generation").distinct().withColumn("_stop", F.lit(True))
    joined = progress.join(stop, ["source_id", "generation"], "left")
    return joined.withColumn("lifecycle", F.when(F.col("_stop"), "paused").when(F.col("unclassified") == 0, "complete").otherwise("classifying")).drop("_stop")


def changed_since(status: DataFrame, seen: int) -> DataFrame:
    return status.where(F.col("response_revision") > seen)


def is_ready(status: DataFrame) -> DataFrame:
    return status.agg(F.coalesce(F.bool_or(F.col("observed_at_ms").isNotNull()), F.lit(False)).alias("ready"))


def slice_report(classified: DataFrame) -> DataFrame:
    """Run counters of a classification slice: attempted, and facts by state."""
    return classified.groupBy("source_id").agg(F.count_distinct("txid").alias("attempted"), *(F.count_if(F.col("fact_state") == s).alias(s) for s in ("ready", "explicitly_missing", "pending")))
