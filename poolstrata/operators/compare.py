"""Two-source comparison. Both sides keep their own rows throughout; nothing is merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import RULES
from ..functions import columns as C

FACTS = ("wtxid", "vsize", "fee_sats")


class NotComparable(ValueError):
    """The two sides are one source, or one of them has no snapshot."""


def compare(entries: DataFrame, left: str, right: str, keep: tuple[str, ...] = FACTS) -> DataFrame:
    """txid, region, same_wtxid, and the kept columns of either side: a full outer equi-join on txid."""
    if left == right:
        raise NotComparable("a source can't be compared with itself")
    keep = tuple(dict.fromkeys(("wtxid", *keep)))
    side = lambda name, s: entries.where(F.col("source_id") == s).select("txid", F.struct(*keep).alias(name))
    joined = side("left", left).join(side("right", right), "txid", "full_outer")
    region = F.when(F.col("right").isNull(), "left_only").when(F.col("left").isNull(), "right_only").otherwise("common")
    same = F.when(region == "common", F.col("left.wtxid") == F.col("right.wtxid"))
    return joined.select("txid", region.alias("region"), same.alias("same_wtxid"), "left", "right")


def require_snapshots(entries: DataFrame, left: str, right: str) -> None:
    have = {r[0] for r in entries.where(F.col("source_id").isin(left, right)).select("source_id").distinct().collect()}
    if {left, right} - have:
        raise NotComparable(f"no snapshot of {sorted({left, right} - have)}")


def totals(compared: DataFrame) -> DataFrame:
    """One row: union, regions, and each side's counts and vsizes, all and common."""
    common = F.col("region") == "common"
    return compared.agg(
        F.count("*").alias("n_union"), F.count_if(common).alias("n_common"), F.count_if(F.col("region") == "left_only").alias("n_left_only"), F.count_if(F.col("region") == "right_only").alias("n_right_only"),
        F.coalesce(F.sum("left.vsize"), F.lit(0)).alias("left_vsize"), F.coalesce(F.sum("right.vsize"), F.lit(0)).alias("right_vsize"),
        F.coalesce(F.sum(F.when(common, F.col("left.vsize"))), F.lit(0)).alias("common_left_vsize"), F.coalesce(F.sum(F.when(common, F.col("right.vsize"))), F.lit(0)).alias("common_right_vsize"),
    )


def differing_variants(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_if(~F.col("same_wtxid")).alias("n_differing"))


def sampling(headers: DataFrame, left: str, right: str) -> DataFrame:
    """Skew of the two observations, the earlier side, overlap or separation of the windows, and whether tips agree."""
    facts = F.struct("observed_at_ms", "started_ms", "completed_ms", "tip_height", "tip_hash")
    latest = lambda name: F.max_by(F.when(F.col("source_id") == name, facts), F.when(F.col("source_id") == name, F.col("observed_at_ms")))
    both = headers.where(F.col("source_id").isin(left, right)).agg(latest(left).alias("l"), latest(right).alias("r")).where("l is not null and r is not null")
    overlap = F.least("l.completed_ms", "r.completed_ms") - F.greatest("l.started_ms", "r.started_ms")
    return both.select(
        F.abs(F.col("l.observed_at_ms") - F.col("r.observed_at_ms")).alias("skew_ms"),
        F.when(F.col("l.observed_at_ms") < F.col("r.observed_at_ms"), "left").when(F.col("l.observed_at_ms") > F.col("r.observed_at_ms"), "right").otherwise("same").alias("earlier"),
        F.greatest(overlap, F.lit(0)).alias("overlap_ms"), F.greatest(-overlap, F.lit(0)).alias("separation_ms"), ((F.col("l.tip_height") == F.col("r.tip_height")) & (F.col("l.tip_hash") == F.col("r.tip_hash"))).alias("same_tip"),
    )


def long_form(compared: DataFrame, common_side: str | None = None) -> DataFrame:
    """One row for each side that holds a transaction: region, side, row_key and the side's columns. common_side keeps one
    side's rows of what is common."""
    sides = F.array_compact(F.array(*(F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("side"), F.col(s).alias("facts"))) for s in ("left", "right"))))
    rows = compared.select("txid", "region", F.explode(sides).alias("x")).select("txid", "region", "x.side", "x.facts.*")
    key = F.when(F.col("region") == "common", F.concat(F.lit("common_"), F.col("side"))).otherwise(F.col("region"))
    rows = rows.withColumn("row_key", key)
    return rows if common_side is None else rows.where(F.col("side") == C.comparison_side("region", F.lit(common_side)))


def policy_slices(long: DataFrame) -> DataFrame:
    """(row_key, kind, name, n, vsize): population, statuses, rules (zero filled) and signatures of the four source-local rows."""
    status = F.coalesce("status", F.lit("unclassified"))
    signature = C.violation_signature("status", "violated_rules", "unknown_rules")
    tags = F.concat(
        F.array(F.struct(F.lit("population").alias("kind"), F.lit("all").alias("name")), F.struct(F.lit("status").alias("kind"), status.alias("name"))),
        F.coalesce(F.transform("violated_rules", lambda r: F.struct(F.lit("rule").alias("kind"), r.alias("name"))), F.expr("cast(array() as array<struct<kind: string, name: string>>)")),
        F.when(signature.isNotNull(), F.array(F.struct(F.when(signature.startswith("exact"), "exact").otherwise("partial").alias("kind"), signature.alias("name")))).otherwise(F.expr("cast(array() as array<struct<kind: string, name: string>>)")),
    )
    counted = long.select("row_key", "vsize", F.explode(tags).alias("t")).groupBy("row_key", "t.kind", "t.name").agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"))
    names = [("status", s) for s in ("compatible", "violating", "indeterminate", "unclassified")] + [("rule", r) for r in RULES] + [("population", "all")]
    grid = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in names))
    keys = F.array(*map(F.lit, ("common_left", "common_right", "left_only", "right_only")))
    fixed = long.sparkSession.range(1).select(F.explode(keys).alias("row_key")).select("row_key", F.explode(grid).alias("g")).select("row_key", "g.*")
    filled = fixed.join(counted, ["row_key", "kind", "name"], "full_outer")
    return filled.select("row_key", "kind", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("vsize", F.lit(0)).alias("vsize"))


def policy_matrix(long: DataFrame, top: int = 3) -> DataFrame:
    """Rows of the matrix: status counts, exact and partial violations, the ``top`` exact signatures and what is beyond them."""
    signature = C.violation_signature("status", "violated_rules", "unknown_rules")
    rows = long.withColumn("signature", signature)
    counts = rows.groupBy("row_key").agg(
        *(F.count_if(F.coalesce("status", F.lit("unclassified")) == s).alias(s) for s in ("compatible", "violating", "indeterminate", "unclassified")),
        F.count_if(F.col("signature").startswith("exact")).alias("exact"), F.count_if(F.col("signature").startswith("partial")).alias("partial"),
    )
    exact = rows.where(F.col("signature").startswith("exact")).groupBy("row_key", "signature").agg(F.count("*").alias("n"), F.first(C.gray_rank(C.rule_mask("violated_rules"))).alias("g"))
    ranked = exact.withColumn("r", F.row_number().over(Window.partitionBy("row_key").orderBy(F.desc("n"), "g", "signature")))
    best = ranked.groupBy("row_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "signature", "n")))), lambda x: F.concat_ws("=", x["signature"], x["n"].cast("string"))), ",").alias("dominant"),
        F.count_if(F.col("r") > top).alias("other_combos"), F.coalesce(F.sum(F.when(F.col("r") > top, F.col("n"))), F.lit(0)).alias("other_n"),
    )
    return counts.join(best, "row_key", "left").select(*counts.columns, F.coalesce("dominant", F.lit("")).alias("dominant"), F.coalesce("other_combos", F.lit(0)).alias("other_combos"), F.coalesce("other_n", F.lit(0)).alias("other_n"))


def policy_population(long: DataFrame, region: str, side: str, text: str = "all", n: int = 12) -> tuple[DataFrame, DataFrame]:
    """Count and vsize of a filter within one region and side, and its n largest transactions."""
    from .quality import policy_filter

    rows = long.where((F.col("region") == region) & (F.col("side") == side) & policy_filter(text))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("vsize"), F.lit(0)).alias("vsize")), rows.orderBy(F.desc("vsize"), "txid").limit(n)


def policy_samples(long: DataFrame, n: int = 12) -> DataFrame:
    """The n largest transactions of every region, side and status."""
    w = Window.partitionBy("region", "side", "status").orderBy(F.desc("vsize"), "txid")
    named = long.withColumn("status", F.coalesce("status", F.lit("unclassified")))
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def scope(long: DataFrame, name: str, side: str) -> DataFrame:
    """Rows of a side within all, common, left_only or right_only; empty where the scope is the other side's."""
    rows = long.where(F.col("side") == side)
    return rows if name == "all" else rows.where(F.col("region") == name)


def scope_panels(long: DataFrame, name: str, side: str) -> dict[str, DataFrame]:
    """The nine panels of a scope, by vsize, properties lens, four groups."""
    from .distributions import all_panels

    return all_panels(scope(long, name, side).withColumn("source_id", F.col("side")), metric="vsize", limit=4)


def lookup(compared: DataFrame, txid: str) -> DataFrame:
    """Where a txid stands: its region, and its place in that region by txid (counted, not sorted)."""
    hit = compared.where(F.col("txid") == txid.strip().lower())
    before = compared.where(F.col("txid") < txid.strip().lower()).groupBy("region").agg(F.count("*").alias("place"))
    return hit.join(before, "region", "left").select("txid", "region", F.coalesce("place", F.lit(0)).alias("place"), "left", "right")
