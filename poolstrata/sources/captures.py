"""Landed captures of node answers, as tables: membership bodies, envelopes, batch responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ENVELOPE, MEMPOOL_BODY, SAFE_MAX


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Poll records (JSON lines) with their explicit schema."""
    return spark.read.schema(ENVELOPE).json(path)


def sats(btc: Column) -> Column:
    """Exact satoshis of a decimal amount; NULL beyond the safe range."""
    n = (btc * F.lit(100_000_000).cast("decimal(10,0)")).cast("bigint")
    return F.when(F.abs(n) <= SAFE_MAX, n)


def stable_tip(start: Column, end: Column) -> Column:
    """Same height and hash before and after the collection."""
    return F.coalesce((start["blocks"] == end["blocks"]) & (F.lower(start["bestblockhash"]) == F.lower(end["bestblockhash"])), F.lit(False))


def snapshot_headers(envelopes: DataFrame) -> DataFrame:
    """One header for each poll, with accepted and reasons."""
    tip = F.lower("end_tip.bestblockhash")
    checks = {
        "tip_moved": stable_tip(F.col("start_tip"), F.col("end_tip")), "tip_hash": F.coalesce(tip.rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "reported_size": F.coalesce(F.col("reported_size") >= 0, F.lit(False)), "window": F.coalesce(F.col("completed_ms") >= F.col("started_ms"), F.lit(False)),
    }
    reasons = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())))
    return envelopes.select(
        "source_id", "source_label", F.col("completed_ms").alias("generation"), "started_ms", "completed_ms", (F.col("completed_ms") - F.col("started_ms")).alias("duration_ms"), F.col("completed_ms").alias("observed_at_ms"),
        F.col("end_tip.blocks").alias("tip_height"), tip.alias("tip_hash"), "reported_size", reasons.alias("reasons"),
    ).withColumn("accepted", F.size("reasons") == 0)


def scan_members(envelopes: DataFrame) -> DataFrame:
    """Membership entries of the bodies: one row for each key, a repeated key's rows included (a check finds them later)."""
    each = envelopes.select("source_id", F.col("completed_ms").alias("generation"), F.posexplode(F.map_entries(F.from_json("body", MEMPOOL_BODY))).alias("position", "e"))
    v = F.col("e.value")
    return each.select(
        "source_id", "generation", "position", F.lower("e.key").alias("txid"), F.lower(v["wtxid"]).alias("wtxid"), v["vsize"].alias("vsize"), v["weight"].alias("weight"), sats(v["fees"]["base"]).alias("fee_sats"),
        (v["time"] * 1000).alias("entered_at_ms"), v["ancestorcount"].alias("ancestor_count"), v["ancestorsize"].alias("ancestor_vsize"), sats(v["fees"]["ancestor"]).alias("ancestor_fee_sats"),
        v["descendantcount"].alias("descendant_count"), v["descendantsize"].alias("descendant_vsize"), v["bip125-replaceable"].alias("replaceable"),
    )


SYSTEMIC = tuple([-28, *range(-32700, -32599)])


def batch_responses(bodies: DataFrame) -> DataFrame:
    """(batch_id, id, outcome, value, code) of every element of every batch body; one malformed row for a body that isn't an
    array. Outcomes: value, null, omitted, malformed, error; an error wins over a value."""
    parsed = bodies.select("batch_id", F.try_parse_json("body").alias("v")).withColumn("list", F.try_variant_get("v", "$", "array<variant>"))
    broken = parsed.where("list is null").select("batch_id", F.lit(None).cast("bigint").alias("id"), F.lit("malformed").alias("outcome"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("code"))
    each = parsed.where("list is not null").select("batch_id", F.explode("list").alias("x"))
    error, result = F.try_variant_get("x", "$.error", "variant"), F.try_variant_get("x", "$.result", "variant")
    shown = each.select("batch_id", F.try_variant_get("x", "$.id", "bigint").alias("id"), error.alias("error"), result.alias("result"), F.try_variant_get("x", "$.error.code", "bigint").alias("code"))
    real_error = F.col("error").isNotNull() & ~F.is_variant_null("error")
    outcome = F.when(F.col("id").isNull(), "malformed").when(real_error, F.when(F.col("code").isNotNull(), "error").otherwise("malformed")).when(F.col("result").isNull(), "omitted").when(F.is_variant_null("result"), "null").otherwise("value")
    out = shown.select("batch_id", "id", outcome.alias("outcome"), F.when(outcome == "value", F.col("result").cast("string")).alias("value"), F.when(real_error, F.col("code")).alias("code"))
    return out.unionByName(broken)


def raw_transaction_outcomes(responses: DataFrame) -> DataFrame:
    """responses with fetch (found, retryable, systemic) and raw, the transaction's bytes."""
    raw = F.when((F.col("outcome") == "value") & F.col("value").rlike("^([0-9a-fA-F]{2})+$"), F.unhex("value"))
    fetch = F.when(raw.isNotNull(), "found").when(F.col("code").isin(*SYSTEMIC), "systemic").otherwise("retryable")
    return responses.withColumn("raw", raw).withColumn("fetch", fetch)


def utxo_outcomes(responses: DataFrame) -> DataFrame:
    """responses with fetch (found, null, retryable, systemic) and script. A null answer is a fact of its own."""
    text = F.get_json_object("value", "$.scriptPubKey.hex")
    script = F.when((F.col("outcome") == "value") & text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text))
    fetch = F.when(script.isNotNull(), "found").when(F.col("outcome") == "null", "null").when(F.col("code").isin(*SYSTEMIC), "systemic").otherwise("retryable")
    return responses.withColumn("script", script).withColumn("fetch", fetch)


def batch_health(responses: DataFrame) -> DataFrame:
    """batch_id and paused: a systemic failure, or a batch of several none of which answered, stops the generation."""
    g = responses.groupBy("batch_id").agg(F.count("*").alias("n"), F.bool_or(F.col("fetch") == "systemic").alias("systemic"), F.bool_and(F.col("outcome").isin("omitted", "malformed")).alias("silent"))
    return g.select("batch_id", (F.col("systemic") | ((F.col("n") > 1) & F.col("silent"))).alias("paused"))
