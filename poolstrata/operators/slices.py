"""Classification slices: retry waves to a fixed point, and the counters of a slice, told by the write of the slice itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import placed, written
from .resolve import reconcile

#: A raw transaction is asked for again once for each variant and generation; a fact has two attempts. The same number serves both.
ATTEMPTS = 2
VARIANT = ["source_id", "txid", "wtxid"]
FACT = ["source_id", "prev_txid", "prev_vout"]


def raw_wave(variants: DataFrame, answers: DataFrame, wave: int, most: int = ATTEMPTS) -> DataFrame:
    """Variants after one wave of raw lookups: open ones are asked, and as long as a source has fresh ones open, only those."""
    turn = variants.where("raw = 'open'").groupBy("source_id").agg(F.min("priority").alias("turn"))
    asked = variants.join(F.broadcast(turn), "source_id", "left").withColumn("ask", F.when((F.col("raw") == "open") & (F.col("priority") == F.col("turn")), F.col("raw_asks") + 1))  # a row for each source
    answered = asked.join(answers.select("source_id", "wtxid", "ask", F.col("outcome").alias("_outcome")), ["source_id", "wtxid", "ask"], "left")
    outcome = F.coalesce("_outcome", F.lit("retryable"))  # no answer is a failed one
    after = F.when(outcome.isin("found", "null"), outcome).when(F.col("ask") >= most, "exhausted").otherwise("open")
    now = F.col("ask").isNotNull()
    return answered.select(*VARIANT, "priority", F.when(now, after).otherwise(F.col("raw")).alias("raw"), F.coalesce("ask", "raw_asks").cast("int").alias("raw_asks"), F.when(now, F.lit(wave)).otherwise(F.col("wave")).cast("int").alias("wave"))


def fact_wave(facts: DataFrame, wanted: DataFrame, answers: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """Facts after one wave of lookups: those wanted for the first time come in, and each that still waits is asked."""
    new = wanted.join(facts.select(*FACT), FACT, "left_anti").select(*FACT, F.lit("awaiting").alias("fact"), F.lit(0).cast("int").alias("fact_asks"))
    every = facts.unionByName(new).withColumn("ask", F.when(F.col("fact") == "awaiting", F.col("fact_asks") + 1))
    answered = every.join(answers.select(*FACT, "ask", F.col("outcome").alias("_outcome")), [*FACT, "ask"], "left")
    outcome = F.coalesce("_outcome", F.lit("retryable"))
    after = F.when(outcome == "found", "ready").when(outcome == "null", "explicitly_missing").when(F.col("ask") >= most, "deferred").otherwise("awaiting")
    now = F.col("ask").isNotNull()
    return answered.select(*FACT, F.when(now, after).otherwise(F.col("fact")).alias("fact"), F.coalesce("ask", "fact_asks").cast("int").alias("fact_asks"))


def retry_waves(candidates: DataFrame, raw_answers: DataFrame, needs: DataFrame, fact_answers: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """Candidates of a generation with what their lookups came to, after as many waves as it takes until none has anything left to ask.

    candidates: ``VARIANT`` and priority (0 fresh, 1 with a result that may be retried). needs: ``VARIANT`` and the outpoints that
    each spends. raw_answers (source_id, wtxid, ask, outcome) and fact_answers (``FACT``, ask, outcome) say what the n-th lookup gives: found, null
    or retryable; one that isn't there failed. Attempts are counted in the state of variants and facts, which each wave writes to the shared
    folder, and are bounded, so there are at most ``3 * most`` waves whatever the number of candidates. A fact that several variants need is
    asked once for all of them. What is needed and answered is written once and stays where it lies in every wave. status is classified, unavailable (no raw transaction) or deferred (a fact is out of attempts); a classified
    one with an explicitly missing fact is retryable in the next generation.
    """
    spark = candidates.sparkSession
    needs, fact_answers = placed(needs.select(*VARIANT, *FACT[1:]), "needs", VARIANT), placed(fact_answers.select(*FACT, "ask", "outcome"), "fact_answers", FACT)
    variants = written(candidates.select(*VARIANT, F.col("priority").cast("int").alias("priority"), F.lit("open").alias("raw"), F.lit(0).cast("int").alias("raw_asks"), F.lit(0).cast("int").alias("wave")), "variants")
    facts = spark.createDataFrame([], f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in needs.select(*FACT).schema)}, fact string, fact_asks int")
    for wave in range(1, 3 * most + 1):
        variants = written(raw_wave(variants, raw_answers, wave, most), "variants")
        found = variants.where((F.col("raw") == "found") & (F.col("wave") == wave)).select(*VARIANT)  # what those found before need is among the facts
        facts = written(fact_wave(facts, needs.join(found, VARIANT, "left_semi").select(*FACT).distinct(), fact_answers, most), "facts")
        if variants.where("raw = 'open'").isEmpty() and facts.where("fact = 'awaiting'").isEmpty():
            break
    met = needs.join(facts, FACT).groupBy(*VARIANT).agg(F.bool_or(F.col("fact") == "deferred").alias("deferred"), F.bool_or(F.col("fact") == "explicitly_missing").alias("missing"), F.sum("fact_asks").alias("fact_asks"))
    joined = variants.join(met, VARIANT, "left")
    got = F.col("raw") == "found"
    status = F.when(~got, "unavailable").when(F.col("deferred"), "deferred").otherwise("classified")
    return joined.select(
        *VARIANT, "priority", "raw", "raw_asks", "wave", F.when(got, F.coalesce("fact_asks", F.lit(0))).otherwise(0).cast("bigint").alias("fact_asks"),
        status.alias("status"), ((status == "classified") & F.coalesce("missing", F.lit(False))).alias("retryable"),
    )


COUNTERS = ("attempted", "found", "response_failures", "systemic_response_failures", "missing_responses", "all_missing_batches", "batch_failures")


def slice_of(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (source_id, batch_id, id) with fetch: what its response came to, ``missing`` where there is none, ``failed`` where its
    batch can't be trusted; and silent, on the first request of a batch of several that had no response at all.

    responses: batch_id, id, fetch (found, null, retryable, systemic). A batch holds a bounded number of requests.
    """
    matched, errors = reconcile(requests, responses.select("batch_id", "id", F.col("fetch").alias("outcome"), F.lit(None).cast("string").alias("value")))
    bad = errors.select("batch_id").distinct().withColumn("_bad", F.lit(True))
    fetch = F.when(F.col("_bad"), "failed").otherwise(F.coalesce("outcome", F.lit("missing")))
    batch = Window.partitionBy("batch_id")
    lead = F.col("id") == F.min("id").over(batch)
    rows = matched.join(bad, "batch_id", "left").withColumn("fetch", fetch)
    silent = lead & (F.count("*").over(batch) > 1) & F.min(F.col("fetch") == "missing").over(batch)
    return rows.select(*requests.columns, "fetch", silent.alias("silent"), (lead & (F.col("fetch") == "failed")).alias("batch_failed"))


def run_slice(requests: DataFrame, responses: DataFrame, sources: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The slice's rows, written to the shared folder, and a report for each source: its counters and the disposition. The counters are
    metrics that the write itself observes, so nothing is read twice. sources: their names, which a deployment's configuration bounds."""
    rows = slice_of(requests, responses)
    tests = {
        "attempted": F.lit(True), "found": F.col("fetch") == "found", "response_failures": F.col("fetch").isin("retryable", "systemic", "missing"), "systemic_response_failures": F.col("fetch") == "systemic",
        "missing_responses": F.col("fetch") == "missing", "all_missing_batches": F.col("silent"), "batch_failures": F.col("batch_failed"),
    }
    seen = Observation(f"slice-{uuid.uuid4().hex}")
    counted = [F.count_if((F.col("source_id") == s) & tests[name]).alias(f"{name}_{k}") for k, s in enumerate(sources) for name in COUNTERS]
    kept = written(rows.observe(seen, *counted), "slice")
    found = seen.get
    report = [(s, *(int(found[f"{name}_{k}"]) for name in COUNTERS)) for k, s in enumerate(sources)]
    frame = requests.sparkSession.createDataFrame(report, "source_id string, " + ", ".join(f"{n} bigint" for n in COUNTERS))
    paused = (F.col("batch_failures") > 0) | (F.col("systemic_response_failures") > 0) | (F.col("all_missing_batches") > 0)
    return kept, frame.withColumn("disposition", F.when(paused, "paused").when(F.col("found") == F.col("attempted"), "complete").otherwise("continue"))
