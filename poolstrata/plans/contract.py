"""Queries of the published contract: sinks read back, checks of what was published, lookups, lifecycle, all panels at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import testdata as D
from ..catalog import CATALOG, PROPERTY_LABELS, RULES, catalog_frame
from ..functions import columns as C
from ..operators import buckets, compare, distributions, lenses, quality
from ..sources import captures, published
from ..storage import shared_folder, written
from ..streaming import state
from ..streaming.run import revision_stream
from .chain import frames

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def every(n: int, then: Column, otherwise: Column, k: str = "k") -> Column:
    """A value that every n-th row has spoilt."""
    return F.when(F.col(k) % n == 0, then).otherwise(otherwise)


def reasons_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.array_join("reasons", ",").alias("reasons"))


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def compact(spark, sf_dir, dealt: bool = False) -> DataFrame:
    """Classified entries as they are published: structure, one result, assessment."""
    return with_results(D.classified(spark, sf_dir, dealt).where("structure is not null"))


def with_results(rows: DataFrame) -> DataFrame:
    """rows of classified entries with one result and the assessment as they are published, in place of their parts."""
    result = F.struct(F.lit("transaction_properties").alias("classifier_id"), "state", F.lit(None).cast("string").alias("primary_label"), "labels", lenses.facts_missing(F.col("state") == "partial", "input_script_pubkeys").alias("missing_facts"))
    verdict = F.struct("status", F.try_element_at("violated_rules", F.lit(1)).alias("primary_rule"), "violated_rules", "unknown_rules")
    return rows.select(*(c for c in rows.columns if c not in ("status", "violated_rules", "unknown_rules", "state", "labels")), F.array(result).alias("classifications"), verdict.alias("bip110"))


# ---- captures and sinks ----------------------------------------------------------------------------------------------


def utxo_responses(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    answer = (
        F.when(k % 6 == 0, ',"result":{"scriptPubKey":{"hex":"0014ab"}}').when(k % 6 == 1, ',"result":null').when(k % 6 == 2, "").when(k % 6 == 3, ',"error":{"code":-28}')
        .when(k % 6 == 4, ',"result":null,"error":{"code":-5}').otherwise(',"result":{"scriptPubKey":{"hex":"xyz"}}')
    )
    body = F.concat(F.lit('{"jsonrpc":"2.0","id":'), k.cast("string"), F.when(F.expr("o_orderkey div 40 % 9 = 0"), "").otherwise(answer), F.lit("}"))
    bodies = D.table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 40").alias("batch_id"), body.alias("x")).groupBy("batch_id").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("x")), F.lit("]")).alias("body"))
    return captures.utxo_outcomes(captures.batch_responses(bodies))


@query
def utxo_answers(spark, sf_dir):
    """Answers about outputs, by kind; a batch in nine leaves everything out."""
    return utxo_responses(spark, sf_dir).groupBy("outcome", "fetch").agg(F.count("*").alias("n"), F.count("script").alias("scripts"))


@query
def batch_pauses(spark, sf_dir):
    """Batches that stop their generation."""
    return captures.batch_health(utxo_responses(spark, sf_dir))


@query
def entries_read_back(spark, sf_dir):
    """Entries written by source and generation, and read again by a prefix of the txid."""
    path = shared_folder(spark, "entries")
    published.write_entries(D.entries(spark, sf_dir).drop("k"), path)
    rows = published.read_entries(spark, path)
    return rows.groupBy("source_id", F.substring("txid", 1, 1).alias("prefix")).agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"), F.min("wtxid").alias("first_wtxid"))


@query
def details_read_back(spark, sf_dir):
    """Details with their assessment, clustered by txid, read again."""
    path = shared_folder(spark, "details")
    published.write_details(compact(spark, sf_dir).select("source_id", "txid", "wtxid", "structure", "classifications", "bip110"), path)
    return spark.read.parquet(path).groupBy("source_id", F.col("bip110.status").alias("status")).agg(F.count("*").alias("n"), F.sum("structure.output_sats").alias("output_sats"), F.sum(F.size(F.col("classifications")[0]["labels"])).alias("labels"))


def snapshot_bodies(spark, sf_dir) -> DataFrame:
    """A body for each source and 1,000 orders, as a generation of its own."""
    known = lambda name: F.when(F.col("structure").isNotNull(), F.col(name)).alias(name)
    rows = with_results(D.classified(spark, sf_dir))
    entries = rows.select(*(c for c in rows.columns if c not in ("classifications", "bip110")), known("classifications"), known("bip110"))
    entries = entries.withColumn("generation", F.expr("k div 1000")).select("source_id", "generation", *(f.strip().split(" ")[0] for f in published.FACTS.split(",")), "structure", "classifications", "bip110")
    headers = entries.select("source_id", "generation").distinct().select("*", F.lit(2).cast("bigint").alias("revision"), F.lit(D.NOW).cast("bigint").alias("observed_at_ms"), F.lit(900000).cast("bigint").alias("tip_height"), F.sha2(F.lit("tip"), 256).alias("tip_hash"))
    return published.snapshot_json(headers, entries)


@query
def snapshots_read_back(spark, sf_dir):
    """Snapshots as JSON, read with their checks; every third generation's total is changed on the way."""
    bodies = snapshot_bodies(spark, sf_dir)
    total = F.concat(F.lit('"total_vsize":'), F.get_json_object("body", "$.total_vsize"))
    heads, entries = published.read_snapshots(bodies.withColumn("body", F.when(F.col("generation") % 3 == 1, F.replace(F.col("body"), total, F.concat(total, F.lit("9")))).otherwise(F.col("body"))))
    counts = entries.groupBy("source_id", "generation").agg(F.count("*").alias("n"), F.count("structure").alias("structured"))
    return heads.join(counts, ["source_id", "generation"]).select("source_id", "generation", F.array_join("reasons", ",").alias("reasons"), "n", "structured")


@query
def published_status(spark, sf_dir):
    """Each customer as a source: availability, lifecycle, caveat, what the unclassified are."""
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("node-"), F.col("c_custkey").cast("string")).alias("source_id"))
    headers = c.where("k % 4 > 0").select("source_id", (F.lit(D.NOW) + F.col("k")).alias("observed_at_ms"))
    errors = c.where("k % 3 = 0").select("source_id", F.lit("down").alias("last_error"))
    life = c.select("source_id", F.when(F.col("k") % 5 == 0, "paused").when(F.col("k") % 5 == 1, "complete").otherwise("classifying").alias("lifecycle"))
    progress = c.select("source_id", F.col("k").alias("classified"))
    return published.source_status(headers, errors, life, progress).select("source_id", "snapshot_observed_at_ms", "last_error", "availability", "lifecycle", "caveat", "unclassified_kind", "classified")


# ---- checks ----------------------------------------------------------------------------------------------------------


@query
def order_violations(spark, sf_dir):
    """Entries of the file order of k that don't follow in txid order."""
    rows = D.entries(spark, sf_dir).where("k % 3 = 0").withColumn("position", F.col("k"))
    return quality.order_violations(rows).select("source_id", "txid", F.col("position").cast("bigint").alias("position"))


@query
def header_checks(spark, sf_dir):
    """Windows and names of sources, each customer as one."""
    k = F.col("c_custkey")
    h = D.table(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(k % 7 == 0, "..").when(k % 7 == 1, "no spaces").when(k % 7 == 2, F.repeat(F.lit("x"), 65)).otherwise(F.concat(F.lit("node-"), k.cast("string"))).alias("source_id"), F.when(k % 11 == 0, "  ").when(k % 11 == 1, F.repeat(F.lit("é"), 65)).otherwise("Label").alias("source_label"),
        (1000 + k % 2).alias("started_ms"), (1001 - k % 3).alias("completed_ms"), ((1001 - k % 3) - (1000 + k % 2) + F.when(k % 13 == 0, 1).otherwise(0)).alias("duration_ms"), (1001 - k % 3 + F.when(k % 17 == 0, 1).otherwise(0)).alias("observed_at_ms"),
    )
    return reasons_of(h.withColumn("reasons", quality.reasons(quality.window_checks() | quality.source_checks())), ["k"])


@query
def structure_checks(spark, sf_dir):
    """Structures that can't be, some spoilt first."""
    rows = compact(spark, sf_dir)
    spoilt = rows.withColumn("structure", F.struct(every(13, F.lit(0).cast("bigint"), F.col("structure.input_count")).alias("input_count"), "structure.output_count", every(17, F.lit(-1).cast("bigint"), F.col("structure.op_return_bytes")).alias("op_return_bytes"), every(19, F.lit(1 << 53), F.col("structure.output_sats")).alias("output_sats"), "structure.witness_bytes"))
    return spoilt.where(~quality.structure_ok()).select("source_id", "txid")


@query
def result_checks(spark, sf_dir):
    """Results that break the contract."""
    rows = compact(spark, sf_dir).select("source_id", "txid", "k", F.col("classifications")[0].alias("r")).select("source_id", "txid", "k", "r.*")
    rows = rows.withColumn("position", every(23, F.lit(1), F.lit(0))).withColumn("classifier_id", every(29, F.lit("unheard_of"), F.col("classifier_id"))).withColumn("primary_label", every(31, F.lit("not_there"), F.col("primary_label")))
    rows = rows.withColumn("missing_facts", every(37, empty("string"), F.col("missing_facts"))).withColumn("labels", F.when(F.col("k") % 41 == 0, F.concat("labels", F.array(F.lit("p2xx")))).when(F.col("k") % 43 == 0, empty("string")).otherwise(F.col("labels")))
    return reasons_of(quality.result_reasons(rows, catalog_frame(spark)), ["source_id", "txid"])


@query
def rule_detail_checks(spark, sf_dir):
    """Rule rows against assessments; some counts and statuses are spoilt first."""
    rows = compact(spark, sf_dir, dealt=True)
    rule = F.explode(F.transform(F.array(*map(F.lit, RULES)), lambda r, n: F.struct((n + 1).alias("number"), r.alias("rule"))))
    each = rows.select("source_id", "txid", "k", "bip110", rule.alias("x")).select("source_id", "txid", "k", "bip110", "x.*")
    hit, miss = F.array_contains("bip110.violated_rules", F.col("rule")), F.array_contains("bip110.unknown_rules", F.col("rule"))
    details = each.where("not (k % 47 = 0 and number = 7)").select("k", "source_id", "txid", "number", "rule", F.when(hit, "violate").when(miss, "unknown").otherwise("pass").alias("verdict"), (F.when(hit, 1).otherwise(0) + F.when((F.col("k") % 53 == 0) & (F.col("number") == 1) & ~hit, 1).otherwise(0)).alias("evidence_count"), F.when(miss, 1).otherwise(0).alias("missing_count"))
    told = rows.withColumn("bip110", F.struct(every(59, F.lit("compatible"), F.col("bip110.status")).alias("status"), "bip110.primary_rule", "bip110.violated_rules", "bip110.unknown_rules"))
    return reasons_of(quality.rule_detail_reasons(details, told, "k"), ["source_id", "txid"])


@query
def assessment_checks(spark, sf_dir):
    """Assessments that contradict themselves."""
    rows = compact(spark, sf_dir)
    a = F.struct(every(7, F.lit("compatible"), F.col("bip110.status")).alias("status"), every(11, F.lit("output_size"), F.col("bip110.primary_rule")).alias("primary_rule"), "bip110.violated_rules", "bip110.unknown_rules")
    return rows.withColumn("bip110", a).where(~quality.assessment_ok()).select("source_id", "txid")


@query
def coupling_checks(spark, sf_dir):
    """Entries with a part of their results missing, and compact rows that aren't their details'."""
    rows = compact(spark, sf_dir)
    torn = rows.withColumn("structure", F.when(F.col("k") % 61 > 0, F.col("structure"))).withColumn("classifications", F.when(F.col("k") % 67 == 0, empty(published.RESULT)).otherwise(F.col("classifications")))
    loose = torn.where(~quality.coupled()).select("source_id", "txid", F.lit("coupling").alias("what"))
    details = rows.where("k % 71 > 0").withColumn("wtxid", every(73, F.sha2("wtxid", 256), F.col("wtxid"))).withColumn("bip110", F.when(F.col("k") % 79 > 0, F.col("bip110")))
    differ = quality.compact_detail_differences(rows, details)
    kind = F.when(F.col("only_detail"), "only_detail").when(F.col("only_compact"), "only_compact").otherwise("differs")
    return loose.unionByName(differ.select("source_id", "txid", kind.alias("what"))).groupBy("source_id", "what").agg(F.count("*").alias("n"), F.min("txid").alias("first_txid"))


@query
def summary_checks(spark, sf_dir):
    """A published summary by status against the one recomputed from the entries; some rows are changed or left out."""
    fresh = buckets.status_totals(D.classified(spark, sf_dir))
    told = fresh.where("not (source_id = 'node-b' and status = 'compatible')").withColumn("n", F.col("n") + F.when((F.col("source_id") == "node-c") & (F.col("status") == "violating"), 1).otherwise(0))
    got = quality.summary_differences(told, fresh, ["source_id", "status"], ["n", "vsize", "incomplete"])
    return got.select("source_id", "status", F.col("published.n").alias("published_n"), F.col("recomputed.n").alias("recomputed_n"))


@query
def status_contract(spark, sf_dir):
    """Status rows that contradict themselves, each customer as a source."""
    k = F.col("c_custkey")
    rows = D.table(spark, sf_dir, "customer").select(
        k.alias("k"), F.element_at(F.array(*map(F.lit, ("waiting", "ready", "stale", "error"))), (k % 4 + 1).cast("int")).alias("availability"), F.when(k % 3 > 0, k).alias("snapshot_observed_at_ms"), F.when(k % 5 > 2, "down").alias("last_error"),
        (k % 100).alias("classified"), F.lit(7).alias("unclassified"), (k % 100 + 7 + F.when(k % 19 == 0, 1).otherwise(0)).alias("count"),
    )
    return reasons_of(rows.withColumn("reasons", quality.reasons(quality.status_checks())), ["k"])


@query
def catalog_checks(spark, sf_dir):
    """Labels that results use, as a catalog: what repeats or is misspelt."""
    used = D.classified(spark, sf_dir).select(F.explode("labels").alias("label_key"), "k").groupBy("label_key").agg(F.min("k").alias("k"))
    one = used.select(F.concat(F.lit("lens_"), (F.col("k") % 3).cast("string")).alias("classifier_id"), F.lit(0).alias("ord"), F.col("label_key"))
    more = used.select(F.lit("lens_x").alias("classifier_id"), F.lit(1).alias("ord"), F.upper("label_key").alias("label_key")).unionByName(used.select(F.lit("lens_y").alias("classifier_id"), (F.length("label_key") % 2).cast("int").alias("ord"), F.substring("label_key", 1, 3).alias("label_key")))
    return quality.catalog_reasons(one.unionByName(more))


@query
def detail_match(spark, sf_dir):
    """Details against the snapshot: older, newer with equal and with other results, another variant."""
    rows = compact(spark, sf_dir).withColumn("revision", F.lit(5))
    details = rows.withColumn("revision", 4 + F.col("k") % 3).withColumn("wtxid", every(83, F.sha2("wtxid", 256), F.col("wtxid"))).withColumn("bip110", F.when(F.col("k") % 4 > 0, F.col("bip110")))
    return quality.detail_matches(details.where("k % 89 > 0"), rows.where("k % 97 > 0")).groupBy("source_id", "matches").agg(F.count("*").alias("n"), F.min("txid").alias("first_txid"))


@query
def exact_txid(spark, sf_dir):
    """One transaction by its id, typed with spaces and capitals; half an id finds nothing."""
    rows = D.entries(spark, sf_dir)
    wanted = rows.agg(F.min("txid")).first()[0]
    return rows.where(quality.txid_is(f" {wanted.upper()} ") | quality.txid_is(wanted[:32])).select("source_id", "txid", "vsize")


# ---- columns, lookups and populations --------------------------------------------------------------------------------


@query
def bucket_names(spark, sf_dir):
    """Buckets by the labels' places in the catalog, and their names."""
    rows = D.classified(spark, sf_dir).withColumn("bucket", C.bucket_key("state", "labels", PROPERTY_LABELS))
    return rows.groupBy("source_id", "bucket").agg(F.count("*").alias("n")).withColumn("name", C.bucket_label("bucket", PROPERTY_LABELS))


def compared(spark, sf_dir) -> DataFrame:
    return compare.compare(D.classified(spark, sf_dir), "node-a", "node-b", ("wtxid", "vsize", "fee_sats", "status", "violated_rules", "unknown_rules"))


@query
def shown_side(spark, sf_dir):
    """One row for each transaction of two sources, the chosen side's where both have it."""
    parts = [compare.long_form(compared(spark, sf_dir), side).select(F.lit(side).alias("chosen"), "region", "side", "vsize") for side in ("left", "right")]
    return reduce(DataFrame.unionByName, parts).groupBy("chosen", "region", "side").agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"))


@query
def region_place(spark, sf_dir):
    """Where a transaction stands in the comparison, and its place in its region."""
    rows = compared(spark, sf_dir)
    wanted = D.entries(spark, sf_dir).agg(F.max("txid")).first()[0]
    return compare.lookup(rows, f" {wanted.upper()}").select("txid", "region", "place", F.col("left.vsize").alias("left_vsize"), F.col("right.vsize").alias("right_vsize"))


@query
def population_of_a_filter(spark, sf_dir):
    """Count and size of a policy filter in each region and side."""
    long = compare.long_form(compared(spark, sf_dir))
    sides = [("common", "left"), ("common", "right"), ("left_only", "left"), ("right_only", "right")]
    parts = [compare.policy_population(long, r, s, t)[0].select(F.lit(r).alias("region"), F.lit(s).alias("side"), F.lit(t).alias("filter"), "n", "vsize") for r, s in sides for t in ("all", "status:violating", "rule:op_success")]
    return reduce(DataFrame.unionByName, parts)


@query
def status_shares(spark, sf_dir):
    """One status' population with its share of all."""
    rows = D.classified(spark, sf_dir)
    return reduce(DataFrame.unionByName, (buckets.status_population(rows, s).withColumn("status", F.lit(s)) for s in ("compatible", "violating", "indeterminate")))


@query
def incomplete_violations(spark, sf_dir):
    """Violating transactions with unknown rules."""
    return buckets.incomplete_violations(D.classified(spark, sf_dir))


def panel_rows(panels: dict[str, DataFrame], **names: str) -> DataFrame:
    """All panels in long form: how many cells each has and their weight."""
    weights = {"composition": "weight", "panel_groups": names.get("groups", "n")}
    parts = [p.groupBy("source_id").agg(F.count("*").alias("cells"), F.sum(weights.get(name, "weight")).cast("bigint").alias("weight")).withColumn("panel", F.lit(name)) for name, p in panels.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def nine_panels(spark, sf_dir):
    """All panels of every source by count, each with its cells and weight."""
    return panel_rows(distributions.all_panels(D.classified(spark, sf_dir)))


@query
def nine_panels_of_a_scope(spark, sf_dir):
    """The panels of what two sources have in common, left side, by vsize."""
    keep = tuple(c for c in D.classified(spark, sf_dir).columns if c not in ("source_id", "txid", "generation", "k"))
    long = compare.long_form(compare.compare(D.classified(spark, sf_dir), "node-a", "node-b", keep))
    return panel_rows(compare.scope_panels(long, "common", "left"), groups="vsize")


@query
def scopes(spark, sf_dir):
    """G1: how many rows each scope of a side has."""
    long = compare.long_form(compared(spark, sf_dir))
    parts = [compare.scope(long, name, side).agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), F.lit(side).alias("side"), "n") for name in ("all", "common", "left_only", "right_only") for side in ("left", "right")]
    return reduce(DataFrame.unionByName, parts)


# ---- results of all lenses -------------------------------------------------------------------------------------------


@query
def results_by_lens(spark, sf_dir):
    """Every transaction's results looked up by lens."""
    t, o, i, spent = frames(spark, sf_dir, family=True, matches=True)
    got = lenses.classify(t, o, i, spent=spent)
    shown = got.select("source_id", "txid", "structure.output_count", "bip110.status", *(lenses.result_of(x.classifier_id)["state"].alias(x.classifier_id) for x in CATALOG[:4]), lenses.result_of("nothing").isNull().alias("none"))
    return shown.groupBy("source_id", *(x.classifier_id for x in CATALOG[:4]), "status", "none").agg(F.count("*").alias("n"), F.sum("output_count").alias("outputs"))


# ---- state -----------------------------------------------------------------------------------------------------------


@query
def revision_fold(spark, sf_dir):
    """I4: deltas of events as a stream, run to its end: the first that changes nothing leaves a gap after it."""
    return revision_stream(spark, sf_dir)


@query
def lifecycles(spark, sf_dir):
    """Lifecycle of each supplier as a source, its readiness, and whether a reader has seen its revision."""
    s = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("node-"), F.col("s_suppkey").cast("string")).alias("source_id"), (F.col("s_suppkey") % 3).alias("generation"))
    progress = s.select("source_id", "k", "generation", (F.col("k") % 4).alias("unclassified"), F.when(F.col("k") % 5 > 0, F.col("k")).alias("observed_at_ms"), (F.col("k") % 50).alias("response_revision"))
    paused = s.select("source_id", (F.col("k") % 2).alias("generation"), (F.col("k") % 7 == 0).alias("paused"))
    return state.changed_since(state.lifecycle(progress, paused), 2).select("source_id", "lifecycle", "response_revision", F.lit(state.is_ready(progress).first()["ready"]).alias("ready"))


@query
def retries(spark, sf_dir):
    """I8: facts to ask for again, by attempts so far."""
    facts = D.tx_inputs(spark, sf_dir).select("k", F.when(F.col("utxo_outcome") == "found", "ready").when(F.col("utxo_outcome") == "null", "explicitly_missing").otherwise("pending").alias("fact_state"), (F.col("k") % 4).alias("attempts"))
    return state.retry_set(facts).groupBy("fact_state", F.col("attempts").cast("bigint").alias("attempts")).agg(F.count("*").alias("n"))
