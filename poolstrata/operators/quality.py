"""Checks: each is a predicate or a join that names what is wrong; rejected rows keep their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import RULES
from ..functions.columns import c
from ..schemas import SAFE_MAX

ENTRY_LIMIT = 200_000
UNSIGNED = ("vsize", "weight", "fee_sats", "entered_at_ms", "ancestor_count", "ancestor_vsize", "descendant_count", "descendant_vsize")


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail; a check that is NULL fails."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def entry_checks() -> dict[str, Column]:
    safe = F.lit(True)
    for name in UNSIGNED:
        safe = safe & F.col(name).between(0, SAFE_MAX)
    return {
        "vsize_positive": F.col("vsize") > 0,
        "safe_integers": safe & (F.abs("ancestor_fee_sats") <= SAFE_MAX),
        "weight_range": (F.col("weight") > 0) & (F.col("weight") <= 4 * F.col("vsize")),
        "counts_positive": (F.col("ancestor_count") >= 1) & (F.col("descendant_count") >= 1),
        "relatives_include_self": (F.col("ancestor_vsize") >= F.col("vsize")) & (F.col("descendant_vsize") >= F.col("vsize")),
        "ids": F.col("txid").rlike("^[0-9a-f]{64}$") & F.col("wtxid").rlike("^[0-9a-f]{64}$"),
    }


def with_entry_reasons(entries: DataFrame) -> DataFrame:
    return entries.withColumn("reasons", reasons(entry_checks()))


def duplicate_ids(entries: DataFrame) -> DataFrame:
    """(source_id, kind, id, n) of ids that a source holds more than once."""
    each = entries.select("source_id", F.explode(F.array(F.struct(F.lit("txid").alias("kind"), F.col("txid").alias("id")), F.struct(F.lit("wtxid").alias("kind"), F.col("wtxid").alias("id")))).alias("x"))
    return each.groupBy("source_id", "x.kind", "x.id").agg(F.count("*").alias("n")).where("n > 1")


def snapshot_limits(headers: DataFrame, counts: DataFrame, limit: int = ENTRY_LIMIT) -> DataFrame:
    """headers with ``accepted``: size not negative and entries within the limit, which rejects the whole snapshot."""
    joined = headers.join(counts, ["source_id", "generation"], "left")
    return joined.withColumn("accepted", (F.col("reported_size") >= 0) & (F.coalesce("n_entries", F.lit(0)) <= limit) & (F.col("reported_size") <= limit))


def order_violations(entries: DataFrame) -> DataFrame:
    """Entries that don't follow the one before them in txid order within their file order ``position``."""
    w = Window.partitionBy("source_id", "generation").orderBy("position")
    return entries.withColumn("before", F.lag("txid").over(w)).where(F.col("before") >= F.col("txid")).drop("before")


def window_checks() -> dict[str, Column]:
    return {
        "completed_after_started": F.col("completed_ms") >= F.col("started_ms"),
        "duration": F.col("duration_ms") == F.col("completed_ms") - F.col("started_ms"),
        "observed_is_completed": F.col("observed_at_ms") == F.col("completed_ms"),
    }


def source_checks() -> dict[str, Column]:
    return {
        "source_id": F.col("source_id").rlike("^[A-Za-z0-9._-]{1,64}$") & ~F.col("source_id").isin(".", ".."),
        "source_label": (F.trim("source_label") != "") & (F.octet_length("source_label") <= 128),
    }


def structure_ok(structure: Column | str = "structure") -> Column:
    s = c(structure)
    safe = F.lit(True)
    for name in ("op_return_bytes", "output_sats", "witness_bytes"):
        safe = safe & s[name].between(0, SAFE_MAX)
    return (s["input_count"] >= 1) & (s["output_count"] >= 1) & safe


def result_reasons(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Result rows (long form, with ``position``) that break the result contract, with reasons."""
    vocabulary = catalog.groupBy("classifier_id").agg(F.array_sort(F.collect_list(F.struct("label_ord", "label_key"))).alias("v"), F.first("ord").alias("ord"))
    vocabulary = vocabulary.select("classifier_id", "ord", F.col("v.label_key").alias("vocabulary"))
    checks = {
        "declared_classifier": F.col("ord").isNotNull(),
        "catalog_order": F.col("position") == F.col("ord"),
        "complete_has_labels": (F.col("state") != "complete") | ((F.size("labels") >= 1) & (F.size("missing_facts") == 0)),
        "partial_has_missing": (F.col("state") != "partial") | (F.size("missing_facts") >= 1),
        "primary_is_label": F.col("primary_label").isNull() | F.array_contains("labels", F.col("primary_label")),
        "labels_declared": F.size(F.array_except("labels", "vocabulary")) == 0,
        "labels_distinct": F.size(F.array_distinct("labels")) == F.size("labels"),
    }
    joined = results.join(F.broadcast(vocabulary), "classifier_id", "left")
    return joined.withColumn("reasons", reasons(checks)).where(F.size("reasons") > 0).select(*results.columns, "reasons")


def rule_detail_reasons(details: DataFrame, assessments: DataFrame, owner: str | None = None) -> DataFrame:
    """Transactions whose seven rule rows don't agree with themselves or with the published assessment. owner: a column of both that txid
    determines; rows that are dealt by it already meet where they are."""
    keys, own = ["source_id", "txid"], [owner] if owner else []
    order = F.array(*map(F.lit, RULES))
    rows = details.select(*own, *keys, F.struct("number", "rule", "verdict", "evidence_count", "missing_count").alias("_row"))
    told = assessments.select(*own, *keys, F.struct("bip110").alias("_told"))
    # rows without an id are no other's equals
    side = lambda n: F.when(F.col("source_id").isNull() | F.col("txid").isNull(), n).alias("_side")
    met = rows.select("*", side(1)).unionByName(told.select("*", side(2)), allowMissingColumns=True).groupBy(*own, *keys, "_side").agg(F.array_sort(F.collect_list("_row")).alias("_rows"), F.collect_list("_told").alias("_all_told"))
    joined = met.select(*keys, F.when(F.size("_rows") > 0, F.col("_rows")).alias("rows"), F.explode_outer("_all_told").alias("_told")).select(*keys, "rows", "_told.bip110")
    violated = F.transform(F.filter("rows", lambda r: r["verdict"] == "violate"), lambda r: r["rule"])
    unknown = F.transform(F.filter("rows", lambda r: r["missing_count"] > 0), lambda r: r["rule"])
    status = F.when(F.size(violated) > 0, "violating").when(F.size(unknown) > 0, "indeterminate").otherwise("compatible")
    checks = {
        "seven_rules": F.col("rows")["rule"] == order,
        "verdict_has_evidence": F.forall("rows", lambda r: (r["verdict"] == "violate") == (r["evidence_count"] > 0)),
        "unknown_has_missing": F.forall("rows", lambda r: (r["verdict"] != "unknown") | (r["missing_count"] > 0)),
        "pass_is_clean": F.forall("rows", lambda r: (r["verdict"] != "pass") | (r["missing_count"] == 0)),
        "status": F.col("bip110.status") == status,
        "violated_rules": F.col("bip110.violated_rules") == violated,
        "unknown_rules": F.col("bip110.unknown_rules") == unknown,
        "primary_is_violated": F.col("bip110.primary_rule").isNull() | F.array_contains(violated, F.col("bip110.primary_rule")),
    }
    return joined.withColumn("reasons", reasons(checks)).where(F.size("reasons") > 0).select(*keys, "reasons")


def assessment_ok(a: Column | str = "bip110") -> Column:
    s = c(a)
    v, u = F.size(s["violated_rules"]), F.size(s["unknown_rules"])
    return (
        F.when(s["status"] == "compatible", (v == 0) & (u == 0) & s["primary_rule"].isNull())
        .when(s["status"] == "violating", (v > 0) & (s["primary_rule"].isNull() | F.array_contains(s["violated_rules"], s["primary_rule"])))
        .when(s["status"] == "indeterminate", (v == 0) & (u > 0) & s["primary_rule"].isNull())
        .otherwise(F.lit(False))
    )


def coupled(entry: tuple[str, str, str] = ("structure", "bip110", "classifications")) -> Column:
    """Structure, assessment and results are all there or all absent (no results may be an empty array)."""
    s, a, r = entry
    has = F.coalesce(F.size(c(r)) > 0, F.lit(False))
    return (c(s).isNotNull() == has) & (c(a).isNotNull() == has)


def compact_detail_differences(entries: DataFrame, details: DataFrame) -> DataFrame:
    """Classified entries whose compact row isn't the detail row of the same witness variant."""
    keys = ["source_id", "txid", "wtxid"]
    e = entries.where(F.col("structure").isNotNull()).select(*keys, F.struct("structure", "bip110", "classifications").alias("compact"))
    d = details.select(*keys, F.struct("structure", "bip110", "classifications").alias("detail"))
    return e.join(d, keys, "full_outer").where(~F.col("compact").eqNullSafe(F.col("detail"))).select(*keys, F.col("compact").isNull().alias("only_detail"), F.col("detail").isNull().alias("only_compact"))


def summary_differences(published: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of a published summary that differ from the one recomputed, either side's absence included."""
    p, r = published.select(*keys, F.struct(*values).alias("published")), recomputed.select(*keys, F.struct(*values).alias("recomputed"))
    return p.join(r, keys, "full_outer").where(~F.col("published").eqNullSafe(F.col("recomputed")))


def status_checks() -> dict[str, Column]:
    has = F.col("snapshot_observed_at_ms").isNotNull()
    return {
        "snapshot": F.when(F.col("availability").isin("waiting", "error"), ~has).otherwise(has),
        "error_text": F.when(F.col("availability").isin("stale", "error"), F.col("last_error").isNotNull()).otherwise(F.col("last_error").isNull()),
        "progress": ~has | (F.col("classified") + F.col("unclassified") == F.col("count")),
    }


def catalog_reasons(catalog: DataFrame) -> DataFrame:
    """Classifier ids or label keys that repeat or are misspelt."""
    lenses = catalog.select("classifier_id", "ord").distinct().groupBy("classifier_id").count().where("count > 1").select("classifier_id", F.lit("id_repeats").alias("reason"))
    labels = catalog.groupBy("classifier_id", "label_key").count().where("count > 1").select("classifier_id", F.lit("label_repeats").alias("reason"))
    syntax = catalog.where(~F.col("label_key").rlike("^[a-z0-9_]{1,64}$") | ~F.col("classifier_id").rlike("^[a-z0-9_]{1,64}$")).select("classifier_id", F.lit("key_syntax").alias("reason"))
    return lenses.unionByName(labels).unionByName(syntax).distinct()


def detail_matches(detail: DataFrame, snapshot: DataFrame) -> DataFrame:
    """detail rows with ``matches``: same source, observation, txid and variant, and the same revision, or a newer one with
    equal results."""
    keys = ["source_id", "txid"]
    s = snapshot.select(*keys, *(F.col(n).alias(f"s_{n}") for n in ("observed_at_ms", "wtxid", "revision", "classifications", "bip110")))
    same = (F.col("observed_at_ms") == F.col("s_observed_at_ms")) & (F.col("wtxid") == F.col("s_wtxid"))
    equal = F.col("classifications").eqNullSafe(F.col("s_classifications")) & F.col("bip110").eqNullSafe(F.col("s_bip110"))
    ok = same & ((F.col("revision") == F.col("s_revision")) | ((F.col("revision") > F.col("s_revision")) & equal))
    return detail.join(s, keys, "left").select(*detail.columns, F.coalesce(ok, F.lit(False)).alias("matches"))


def user_filter(min_fee_rate: float = 0.0, min_vsize: int = 0, max_age_ms: int | None = None) -> Column:
    from ..functions.columns import age_ms, fee_rate

    keep = (fee_rate() >= min_fee_rate) & (F.col("vsize") >= min_vsize)
    return keep if max_age_ms is None else keep & (age_ms("observed_at_ms") <= max_age_ms)


def txid_is(text: str) -> Column:
    wanted = text.strip().lower()
    return F.col("txid") == wanted if len(wanted) == 64 and set(wanted) <= set("0123456789abcdef") else F.lit(False)


def txid_prefix(text: str) -> Column:
    return F.col("txid").startswith(text.strip().lower())


def policy_filter(text: str = "all") -> Column:
    """Predicate of a filter's text: all, status:x, rule:x, signature:x; what isn't one of these is all."""
    from ..catalog import STATUSES
    from ..functions.columns import violation_signature

    kind, _, value = text.partition(":")
    if kind == "status" and value in (*STATUSES, "unclassified"):
        return F.coalesce(F.col("status"), F.lit("unclassified")) == value
    if kind == "rule" and value in RULES:
        return F.coalesce(F.array_contains("violated_rules", value), F.lit(False))
    if kind == "signature" and value:
        return F.coalesce(violation_signature("status", "violated_rules", "unknown_rules") == value, F.lit(False))
    return F.lit(True)


def has_label(label: str, labels: str = "labels") -> Column:
    return F.coalesce(F.array_contains(labels, label), F.lit(False))


def agreed_scripts(observations: DataFrame, owner: str | None = None) -> DataFrame:
    """(prev_txid, prev_vout, script) for outpoints all of whose observed scripts are equal; contested ones are trusted in
    neither form. owner: a column that prev_txid determines; rows that are dealt by it already are compared where they are, and it stays."""
    g = observations.where(F.col("script").isNotNull()).groupBy(*([owner] if owner else []), "prev_txid", "prev_vout")
    return g.agg(F.min("script").alias("script"), F.max("script").alias("_other")).where(F.col("script") == F.col("_other")).drop("_other")
