"""Populations and partitions of a snapshot: by status, rule, signature, lens bucket and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import PROPERTY_LABELS
from ..functions import columns as C

PROFILE_ORDER = ("legacy", "segwit_v0", "taproot", "other", "mixed")


def population(*keys: str | Column):
    """count and vsize of groups."""
    return lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"))


def with_share(groups: DataFrame, entries: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """groups with share: their count against the whole population, unclassified entries included."""
    whole = entries.groupBy(*keys).agg(F.count("*").alias("_whole"))
    return groups.join(F.broadcast(whole), list(keys)).withColumn("share", F.col("n") / F.col("_whole")).drop("_whole")


def status_totals(entries: DataFrame) -> DataFrame:
    """count and vsize of each status, and how many of them have unknown rules."""
    named = entries.withColumn("status", F.coalesce("status", F.lit("unclassified")))
    return named.groupBy("source_id", "status").agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"), F.count_if(F.size("unknown_rules") > 0).alias("incomplete"))


def rule_population(entries: DataFrame) -> DataFrame:
    """Marginal: a transaction counts for each rule that it violates."""
    each = entries.select("source_id", "vsize", F.explode("violated_rules").alias("rule"))
    return with_share(population("source_id", "rule")(each), entries)


def signature_population(entries: DataFrame) -> DataFrame:
    """Disjoint: violating transactions by signature, with the place in signature order."""
    rows = entries.where("status = 'violating'").withColumn("signature", C.violation_signature("status", "violated_rules", "unknown_rules"))
    groups = rows.groupBy("source_id", "signature").agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"), F.first("violated_rules").alias("v"), F.first("unknown_rules").alias("u"))
    ordered = groups.withColumn("ord", C.signature_order("v", "u", "signature"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("ord"))  # at most 127 * 128 signatures a source
    return ordered.select("source_id", "signature", "n", "vsize", C.signature_label("v", "u").alias("label"), place.alias("place"))


def incomplete_violations(entries: DataFrame) -> DataFrame:
    return population("source_id")(entries.where((F.col("status") == "violating") & (F.size("unknown_rules") > 0)))


def status_population(entries: DataFrame, status: str) -> DataFrame:
    return with_share(population("source_id")(entries.where(F.col("status") == status)), entries)


def terrain(entries: DataFrame) -> DataFrame:
    """Five sections with regions inside: rows for regions, and section totals (region NULL)."""
    partial = F.size("unknown_rules") > 0
    section = F.when(F.col("status").isNull(), "unclassified").when(F.col("status") != "violating", F.col("status")).when(partial, "violating_partial").otherwise("violating_exact")
    rows = entries.select("source_id", "vsize", section.alias("section"), C.region_key("status", "violated_rules", "unknown_rules").alias("region"))
    both = rows.select("source_id", "vsize", "section", F.explode(F.array(F.col("region"), F.lit(None).cast("string"))).alias("region"))
    return population("source_id", "section", "region")(both)


def lens_bucket(kind: str = "properties", vocabulary: tuple[str, ...] = PROPERTY_LABELS) -> Column:
    return C.script_profile("state", "labels") if kind == "properties" else C.bucket_key("state", "labels", vocabulary)


def lens_buckets(entries: DataFrame, kind: str = "properties", vocabulary: tuple[str, ...] = PROPERTY_LABELS) -> DataFrame:
    """Partition by lens bucket: count, vsize, share by count, observed labels in catalog order, canonical place."""
    rows = entries.withColumn("bucket", lens_bucket(kind, vocabulary))
    seen = F.array_distinct(F.flatten(F.collect_set("labels")))
    groups = rows.groupBy("source_id", "bucket").agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"), F.filter(F.array(*map(F.lit, vocabulary)), lambda x: F.array_contains(seen, x)).alias("observed"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(bucket_order(F.col("bucket"))))
    return with_share(groups, entries).withColumn("place", place)


def bucket_order(bucket: Column) -> Column:
    """Canonical order: complete, partial, unavailable; then profiles in theirs, or label indexes compared one by one."""
    state = F.substring_index(bucket, ":", 1)
    body = F.when(bucket.contains(":"), F.substring_index(bucket, ":", -1)).otherwise("")
    rank = F.when(state == "complete", 0).when(state == "partial", 1).otherwise(2)
    profile = F.array_position(F.array(*(F.lit(f"profile_{p}") for p in PROFILE_ORDER)), body)
    indexes = F.transform(F.split(body, "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))
    return F.struct(rank.alias("state"), profile.alias("profile"), indexes.alias("indexes"), bucket.alias("key"))


def bucket_sections(entries: DataFrame, kind: str = "properties") -> DataFrame:
    """Buckets rolled up to sections by state; bucket NULL is the section's total."""
    rows = entries.select("source_id", "vsize", F.coalesce("state", F.lit("unavailable")).alias("section"), lens_bucket(kind).alias("bucket"))
    rolled = rows.rollup("source_id", "section", "bucket").agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"))
    return rolled.where("section is not null")


def label_population(entries: DataFrame) -> DataFrame:
    """Marginal: a transaction counts for each of its labels."""
    each = entries.select("source_id", "vsize", F.explode("labels").alias("label"))
    return with_share(population("source_id", "label")(each), entries)


def first_largest(groups: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The most populated key of each source; of equal ones the earliest in ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(key))
    return groups.groupBy("source_id").agg(F.max_by(key, F.struct("n", (-place).alias("early"))).alias(key))


def keep_largest(groups: DataFrame, weight: str, keep: int, place: str = "place", partition: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """groups with kept: the ``keep`` largest by weight; ties keep canonical order."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(weight), F.col(place)))
    return groups.withColumn("kept", rank <= keep)


def panel_groups(groups: DataFrame, weight: str, limit: int) -> DataFrame:
    """The ``limit`` largest buckets in canonical order and one overflow row for the rest, with its number of buckets."""
    marked = keep_largest(groups, weight, limit)
    name, first = F.when(F.col("kept"), F.col("bucket")).otherwise("overflow"), F.when(F.col("kept"), F.col("place")).otherwise(1 << 30)
    return marked.groupBy("source_id", name.alias("bucket"), first.alias("place")).agg(F.sum("n").alias("n"), F.sum("vsize").alias("vsize"), F.count("*").alias("buckets"))


def composition_bar(groups: DataFrame, weight: str, most: int = 8) -> DataFrame:
    """A bar's parts: all buckets where there are at most ``most``, else the most - 1 largest and an overflow, with shares."""
    sizes = groups.groupBy("source_id").agg(F.count("*").alias("_n"), F.sum(weight).alias("_total"))
    marked = keep_largest(groups.join(F.broadcast(sizes), "source_id"), weight, most - 1).withColumn("kept", F.col("kept") | (F.col("_n") <= most))
    name, first = F.when(F.col("kept"), F.col("bucket")).otherwise("overflow"), F.when(F.col("kept"), F.col("place")).otherwise(1 << 30)
    parts = marked.groupBy("source_id", name.alias("bucket"), first.alias("place"), "_total").agg(F.sum(weight).alias("weight"), F.count("*").alias("buckets"))
    return parts.withColumn("share", F.when(F.col("_total") > 0, F.col("weight") / F.col("_total")).otherwise(0.0)).drop("_total")

