"""Snapshots: carry-forward, materialisation, work sets, totals, summaries and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..catalog import STATUSES

VARIANT = ["source_id", "txid", "wtxid"]


def met(results: DataFrame, membership: DataFrame, owner: str | None) -> tuple[DataFrame, WindowSpec]:
    """Rows of both, told apart by ``_member``, and the window of a variant. owner: a column of both that txid determines; rows
    that are dealt by it already meet where they are, and a variant's text doesn't move."""
    own = [owner] if owner else []
    rows = results.withColumn("_member", F.lit(False)).unionByName(membership.select(*own, *VARIANT, F.lit(True).alias("_member")), allowMissingColumns=True)
    return rows, Window.partitionBy(*own, *VARIANT)


def is_known() -> Column:
    """Whether a variant has all of its ids; one without is no other's equal."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in VARIANT))


def carry_forward(results: DataFrame, membership: DataFrame, owner: str | None = None) -> DataFrame:
    """Results whose exact witness variant survives in the new membership."""
    rows, variant = met(results, membership, owner)
    return rows.withColumn("_kept", F.max("_member").over(variant) & is_known()).where("_kept and not _member").select(*results.columns)


def materialise(membership: DataFrame, results: DataFrame, owner: str | None = None) -> DataFrame:
    """Membership with the results of the exact variant, NULL where there are none. owner: a column of both that determines a source's variant, by which
    they meet where they lie; results carry no other ids then."""
    return membership.join(results, [owner, "source_id"] if owner else VARIANT, "left")


def work_set(membership: DataFrame, results: DataFrame, owner: str | None = None) -> DataFrame:
    """Entries to classify: fresh ones (priority 0), then those whose result may be retried (1)."""
    rows, variant = met(results.select(*([owner] if owner else []), *VARIANT, "retryable", "attempts"), membership, owner)
    again = F.coalesce(F.max(F.expr("not _member and retryable and attempts < 2")).over(variant), F.lit(False))
    asked = rows.withColumns({"_held": F.max(~F.col("_member")).over(variant) & is_known(), "_again": again & is_known()}).where("_member and (not _held or _again)")
    return asked.select(*VARIANT, F.when(F.col("_held"), 1).otherwise(0).alias("priority"))


def totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_id").agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"))


def policy_summary(entries: DataFrame) -> DataFrame:
    """Counts of each policy status and of the unclassified, and progress."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return entries.groupBy("source_id").agg(*counts, F.count_if(F.col("status").isNull()).alias("unclassified"), F.count("status").alias("classified"))


def lens_summary(entries: DataFrame, catalog: DataFrame, classifier_id: str) -> DataFrame:
    """source_id, label, n, with zero for declared labels that don't occur, and the lens's complete, partial and unclassified
    counts beside them."""
    states = entries.groupBy("source_id").agg(F.count_if(F.col("state") == "complete").alias("complete"), F.count_if(F.col("state") == "partial").alias("partial"), F.count_if(F.col("state").isNull()).alias("unclassified"))
    counts = entries.select("source_id", F.explode("labels").alias("label")).groupBy("source_id", "label").agg(F.count("*").alias("n"))
    vocabulary = catalog.where(F.col("classifier_id") == classifier_id).select(F.col("label_key").alias("label"), "label_ord")
    grid = states.crossJoin(F.broadcast(vocabulary))  # sources times a few labels
    return grid.join(counts, ["source_id", "label"], "left").select("source_id", "label", F.coalesce("n", F.lit(0)).alias("n"), "complete", "partial", "unclassified")


def label_map(summary: DataFrame) -> DataFrame:
    """The wire shape of a lens summary: one map for each source."""
    return summary.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("label_counts"))


def lookup(keys: DataFrame, headers: DataFrame, entries: DataFrame, details: DataFrame) -> DataFrame:
    """keys (source_id, txid) with outcome waiting, not_present, unclassified or ready."""
    s = headers.select("source_id").distinct().withColumn("has_snapshot", F.lit(True))
    e = entries.select("source_id", "txid", "wtxid")
    d = details.select("source_id", "txid", "wtxid").distinct().withColumn("has_detail", F.lit(True))
    joined = keys.join(F.broadcast(s), "source_id", "left").join(e, ["source_id", "txid"], "left").join(d, ["source_id", "txid", "wtxid"], "left")
    outcome = F.when(F.col("has_snapshot").isNull(), "waiting").when(F.col("wtxid").isNull(), "not_present").when(F.col("has_detail").isNull(), "unclassified").otherwise("ready")
    return joined.select(*keys.columns, outcome.alias("outcome"))


#: Rows that a page's search may leave to be sorted, and how many characters of the id each step tells apart (hex: 4,096 counts).
NARROW, STEP = 1 << 17, 3


def page(entries: DataFrame, number: int, size: int = 100) -> DataFrame:
    """One page in txid order, its number clamped to what there is, with the places of its first and last match.

    Counts by the ids' first characters tell in which range of ids the page lies; larger ranges are told apart by more
    characters. Only rows of that range are sorted, and where entries are clustered by txid only they are read."""
    total, number, low, high, before = seek(entries, number, size)
    rows = entries.where((F.col("txid") >= low) & (F.substring("txid", 1, len(high)) <= high)).orderBy("txid").offset(number * size - before).limit(size)
    return rows.withColumn("page", F.lit(number)).withColumn("first_match", F.lit(min(total, number * size + 1))).withColumn("last_match", F.lit(min(total, (number + 1) * size)))


def seek(entries: DataFrame, number: int, size: int) -> tuple[int, int, str, str, int]:
    """(rows in all, the page's number, first and last prefix of the ids that hold the page, rows before these)."""
    known: dict[str, list[tuple[str, int]]] = {}

    def locate(index: int) -> tuple[str, int]:
        """The prefix of few enough ids among which the row with that number is, and how many rows come before them."""
        prefix, before = "", 0
        while True:
            if prefix not in known:
                known[prefix] = prefix_counts(entries, prefix, len(prefix) + STEP)
            for longer, n in known[prefix]:
                if before + n > index:
                    break
                before += n
            if n <= NARROW or len(longer) >= 64 or longer == prefix:
                return longer, before
            prefix = longer

    known[""] = prefix_counts(entries, "", STEP)
    total = sum(n for _, n in known[""])
    number = min(max(0, number), max(0, -(-total // size) - 1))
    if not total:
        return 0, number, "", "", 0
    low, before = locate(number * size)
    return total, number, low, locate(min(total, (number + 1) * size) - 1)[0], before


def prefix_counts(entries: DataFrame, prefix: str, length: int) -> list[tuple[str, int]]:
    rows = entries.where(F.startswith("txid", F.lit(prefix))) if prefix else entries.where("txid is not null")
    return [(r["p"], r["n"]) for r in rows.groupBy(F.substring("txid", 1, length).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]


def sample(entries: DataFrame, n: int = 8, pinned: str | None = None, groups: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """The n largest of each group by vsize, then txid; a pinned transaction outside them takes the last place."""
    order = [F.desc("vsize"), F.col("txid")]
    w = Window.partitionBy(*groups).orderBy(*order)
    top = entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    if pinned is None:
        return top
    pin = F.col("txid") == pinned
    both = top.unionByName(entries.where(pin).withColumn("rank", F.lit(n + 1))).dropDuplicates([*groups, "txid"])
    again = Window.partitionBy(*groups).orderBy(F.when(pin, 0).otherwise(1), *order)
    kept = both.withColumn("_place", F.row_number().over(again)).where(F.col("_place") <= n).drop("_place", "rank")
    return kept.withColumn("rank", F.row_number().over(w))
