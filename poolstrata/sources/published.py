"""Published snapshots and details: sinks, and the reader that checks what it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..schemas import ENTRY, FACTS, PUBLISHED, RESULT
from ..storage import written


def write_entries(entries: DataFrame, path: str) -> None:
    """Entries by source and generation, in txid order within files, so that a txid or prefix prunes row groups."""
    entries.repartition("source_id", "generation", F.substring("txid", 1, 1)).sortWithinPartitions("source_id", "txid").write.mode("append").partitionBy("source_id", "generation").parquet(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(path)


def snapshot_json(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """(source_id, generation, body): the compact JSON of each snapshot; a snapshot is bounded by the entry limit."""
    facts = [c for c in entries.columns if c not in ("source_id", "generation")]
    rows = entries.groupBy("source_id", "generation").agg(F.array_sort(F.collect_list(F.struct(*facts))).alias("transactions"), F.count("*").alias("count"), F.sum("vsize").alias("total_vsize"))
    joined = headers.join(rows, ["source_id", "generation"])
    names = ["source_id", "generation", "revision", "observed_at_ms", "tip_height", "tip_hash", "count", "total_vsize", "transactions"]
    return joined.select("source_id", "generation", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("body"))


def read_snapshots(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers (with reasons where a check fails) and entries of snapshot bodies. A body that isn't the schema's fails. Each is parsed once, and what was
    read is written: headers, totals and entries read that."""
    return checked(written(bodies.select(F.from_json("body", PUBLISHED, {"mode": "FAILFAST"}).alias("s")), "snapshots"))


def checked(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers with reasons, and entries, of snapshots ``s``."""
    entries = parsed.select("s.source_id", "s.generation", "s.observed_at_ms", F.posexplode("s.transactions").alias("position", "t")).select("source_id", "generation", "observed_at_ms", "position", "t.*")
    totals = entries.groupBy("source_id", "generation").agg(F.count("*").alias("n"), F.sum("vsize").alias("v"), F.bool_and(F.size(quality.reasons(quality.entry_checks())) == 0).alias("entries_ok"), F.bool_and(quality.coupled()).alias("coupled_ok"))
    headers = parsed.select("s.*").drop("transactions").join(totals, ["source_id", "generation"], "left")
    checks = {"count": F.col("count") == F.coalesce("n", F.lit(0)), "total_vsize": F.col("total_vsize") == F.coalesce("v", F.lit(0)), "entries": F.coalesce("entries_ok", F.lit(True)), "coupling": F.coalesce("coupled_ok", F.lit(True))}
    return headers.withColumn("reasons", quality.reasons(checks)).drop("n", "v", "entries_ok", "coupled_ok"), entries


HEADER = ("source_id", "generation", "revision", "observed_at_ms", "tip_height", "tip_hash", "count", "total_vsize", "transactions")
MEMBERS = (*(x.split(" ")[0] for x in FACTS.split(", ")), "structure", "classifications", "bip110")


def body_reason(body: str = "body", parsed: str = "parsed") -> Column:
    """Why a body is no snapshot of the schema, or NULL: it isn't a JSON object, has a member that the schema doesn't know (of the
    snapshot or of an entry), lacks one of the header's, or has a value of another type. A member that is there twice makes it no JSON."""
    tree = F.try_parse_json(body)
    unknown = F.size(F.array_except(F.json_object_keys(F.col(body)), F.array(*map(F.lit, HEADER)))) > 0
    # an entry's members by name: an array of entries is read as maps, whose values stay unread
    entries = F.try_variant_get(tree, "$.transactions", "array<map<string, variant>>")
    strange = F.exists(entries, lambda e: F.size(F.array_except(F.map_keys(e), F.array(*map(F.lit, MEMBERS)))) > 0)
    lacking = F.greatest(*(F.col(f"{parsed}.{name}").isNull() for name in HEADER))
    not_object = tree.isNull() | F.json_object_keys(F.col(body)).isNull()
    return F.when(not_object, "not_json").when(unknown | F.coalesce(strange, F.lit(False)), "unknown_member").when(F.col(f"{parsed}._corrupt").isNotNull(), "wrong_type").when(lacking, "missing_member")


def read_published(bodies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers (with reasons where a check fails) and entries of the bodies that are snapshots, and a reject row for each other: bodies' own
    columns but the body, and its reason. One body that doesn't parse stops nothing. A NULL body is not_json."""
    schema = PUBLISHED.removesuffix(">") + ", _corrupt: string>"
    parsed = bodies.withColumn("parsed", F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reasoned = parsed.withColumn("reason", body_reason())
    judged = written(reasoned.withColumn("parsed", F.when(F.col("reason").isNull(), F.col("parsed"))).drop("body"), "bodies")  # nobody reads a body again
    names = [name for name in judged.schema["parsed"].dataType.names if name != "_corrupt"]
    good = judged.where("reason is null").select(F.struct(*(F.col(f"parsed.{name}").alias(name) for name in names)).alias("s"))
    return *checked(good), judged.where("reason is not null").drop("parsed")


def write_details(details: DataFrame, path: str) -> None:
    """Details with full evidence, clustered by txid."""
    details.repartition("source_id", F.substring("txid", 1, 1)).sortWithinPartitions("txid").write.mode("append").partitionBy("source_id").parquet(path)


def source_status(headers: DataFrame, errors: DataFrame, lifecycle: DataFrame, progress: DataFrame) -> DataFrame:
    """One row for each source: availability, last error, lifecycle and progress."""
    from ..functions.columns import availability, caveat, unclassified_kind

    latest = headers.groupBy("source_id").agg(F.max("observed_at_ms").alias("snapshot_observed_at_ms"))
    out = lifecycle.join(latest, "source_id", "left").join(errors.select("source_id", "last_error"), "source_id", "left").join(progress, "source_id", "left")
    out = out.withColumn("availability", availability(F.col("snapshot_observed_at_ms").isNotNull(), F.col("last_error").isNotNull()))
    return out.withColumn("caveat", caveat("availability", "lifecycle")).withColumn("unclassified_kind", unclassified_kind("lifecycle"))
