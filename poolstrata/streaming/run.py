"""Runs of the streams over landed files, each to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from .keyed import CHANGE, EVENT, RAISED, RESULT, current_results, response_revisions, rocksdb
from .state import revisions, source_status

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def status_stream(spark: SparkSession, sf_dir: str, most: int = 1 << 21) -> DataFrame:
    """Source status from the events table as a stream: each batch's rows are appended to a shared table, of which the row
    of the highest response revision counts. A batch that is written again replaces itself.

    A poll's place in the stream is its event's number, whichever file it lies in. So runs of ``most`` events land one after the other, and the
    stream takes up what has landed, as one micro-batch, before the next does: its parts are ordered by their times, and state carries on."""
    landed, checkpoint, out = shared_folder(spark, "events"), shared_folder(spark, "status-checkpoint"), shared_folder(spark, "status")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for part in in_order(spark.read.parquet(f"{sf_dir}/events.parquet"), most):
        part.write.mode("append").parquet(landed)
        events = spark.readStream.schema(EVENTS).parquet(landed)
        polls = events.select(
            F.concat(F.lit("node-"), (F.col("user_id") % 4).cast("string")).alias("source_id"), F.expr("event_id div 7").alias("generation"), (F.col("event_type") != "error").alias("ok"),
            (F.lit(1704067200000) + F.col("event_id") * 1000).alias("observed_at_ms"), (F.col("event_id") % 5000).alias("n_entries"), F.when(F.col("event_type") == "error", F.concat(F.lit("failure "), F.expr("event_id div 7").cast("string"))).alias("error"),
        )
        source_status(polls).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).drop("batch")
    newest = rows.groupBy("source_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "source_id"]), "response_revision").alias("r")).select("source_id", "r.*")
    return newest.select("source_id", "generation", "last_error", "availability", "dropped", "response_revision")


def in_order(events: DataFrame, most: int) -> list[DataFrame]:
    """The events in runs of about ``most``, by their numbers; those without one come last."""
    n, low, high = events.agg(F.count("*"), F.coalesce(F.min("event_id"), F.lit(0)), F.coalesce(F.max("event_id"), F.lit(0))).first()
    parts = max(1, -(-n // most))
    width = -(-(high - low + 1) // parts)
    number = F.col("event_id")
    tests = [(number >= low + k * width) & (number < low + (k + 1) * width) for k in range(parts)]
    return [events.where(test | number.isNull() if k == parts - 1 else test) for k, test in enumerate(tests)]


def revision_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions from deltas of the events table read as a stream: of each source the row that its last batch gave."""
    events = spark.readStream.schema(EVENTS).format("parquet").option("pathGlobFilter", "*.parquet").load(events_path(spark, sf_dir))
    deltas = events.select(
        F.concat(F.lit("node-"), (F.col("event_id") % 4).cast("string")).alias("source_id"), F.lit(3).cast("bigint").alias("generation"), F.expr("event_id div 4").alias("revision"),
        F.when(F.expr("event_id % 1009 = 1000"), 0).otherwise(F.col("event_id") % 7 + 1).cast("bigint").alias("n_changed"),
    )
    out = shared_folder(spark, "revisions")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = revisions(deltas).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", shared_folder(spark, "revisions-checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(out)
    payload = [c for c in rows.columns if c not in ("source_id", "batch")]
    return rows.groupBy("source_id").agg(F.max_by(F.struct(*payload), "batch").alias("r")).select("source_id", "r.*")


def land(parts: list[DataFrame], name: str) -> str:
    """A folder of the shared one that a file stream can watch, with the parts landed one after the other."""
    folder = shared_folder(parts[0].sparkSession, name)
    for part in parts:
        part.write.mode("append").parquet(folder)
    return folder


def to_the_end(spark: SparkSession, out: DataFrame, mode: str, schema: str, name: str) -> tuple[DataFrame, str]:
    """Run a stream over what has landed. Each micro-batch's rows replace what a failed try of it had written. Returns all rows with their
    ``batch``, and the folder of the checkpoint, which holds the state."""
    folder, checkpoint = shared_folder(spark, name), shared_folder(spark, f"{name}-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    with rocksdb(spark):
        out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch bigint").parquet(folder), checkpoint


def run_results(spark: SparkSession, landed: str, keep_ms: int, files: int = 4, prefix: int = 3) -> tuple[DataFrame, str]:
    """The current results after all changes in a folder: of each transaction that is present the row of its last change."""
    changes = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files).parquet(landed)
    rows, checkpoint = to_the_end(spark, current_results(changes, keep_ms, prefix), "update", RESULT, "results")
    payload = [c for c in rows.columns if c not in ("source_id", "txid", "batch")]
    newest = rows.groupBy("source_id", "txid").agg(F.max_by(F.struct(*payload), "batch").alias("r")).select("source_id", "txid", "r.*")
    return newest.where("present").drop("present"), checkpoint


def run_revisions(spark: SparkSession, landed: str, files: int = 4) -> tuple[DataFrame, str]:
    """Every revision that the events in a folder raise."""
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(landed)
    rows, checkpoint = to_the_end(spark, response_revisions(events), "append", RAISED, "raised")
    return rows.drop("batch"), checkpoint


def events_path(spark: SparkSession, sf_dir: str) -> str:
    """A folder that a file stream can watch: the table's own, or a copy where the table is a single file."""
    path = f"{sf_dir}/events.parquet"
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].endswith("/events.parquet"):
        folder = shared_folder(spark, "events")
        spark.read.parquet(path).write.parquet(folder)
        return folder
    return path
