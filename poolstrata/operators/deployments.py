"""Consensus rules within a deployment's window of blocks, for each branch of the chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import RULES
from .lenses import keys_of, rule_details, told_by

#: Fixed value: blocks for which the rules stay active, from the activation height (inclusive) to the expiry height (exclusive).
ACTIVE_BLOCKS = 52_416


def active_from(heights: Column | str, spend_height: Column | str, blocks: int = ACTIVE_BLOCKS) -> Column:
    """The activation height whose window holds the spend height, the latest if several do; NULL outside all windows."""
    spend = F.col(spend_height) if isinstance(spend_height, str) else spend_height
    return F.array_max(F.filter(heights, lambda h: (spend >= h) & (spend < h + blocks)))


def with_window(transactions: DataFrame, deployments: DataFrame, blocks: int = ACTIVE_BLOCKS) -> DataFrame:
    """transactions (with branch and spend_height) and activation_height. deployments: branch, activation_height, a row for each time
    that the rules were activated there. A branch without any, or with a NULL height only, has no window."""
    heights = deployments.groupBy("branch").agg(F.collect_set("activation_height").alias("_heights"))  # a branch has few
    joined = transactions.join(F.broadcast(heights), "branch", "left")  # a row for each branch: transactions stay where they are
    return joined.withColumn("activation_height", active_from("_heights", "spend_height", blocks)).drop("_heights")


def consensus_details(transactions: DataFrame, outputs: DataFrame, inputs: DataFrame, deployments: DataFrame, blocks: int = ACTIVE_BLOCKS) -> DataFrame:
    """Rows of ``rule_details`` as consensus, with rules_applied: outside every window of its branch a transaction passes each rule, and
    within one only coins that were created from the activation height on can break the rules of inputs.

    transactions carry branch and spend_height (of the next block, or of the block), inputs creation_height. Only the transactions within a
    window are checked.
    """
    keys, by = keys_of(transactions), told_by(transactions)
    placed = with_window(transactions, deployments, blocks)
    active = placed.where("activation_height is not null")
    checked = rule_details(active, outputs, inputs.join(active.select(*by, "activation_height"), by), F.col("activation_height"))
    names = F.array(*map(F.lit, RULES))
    idle = placed.where("activation_height is null").select(*keys, F.explode(F.sequence(F.lit(1), F.lit(len(RULES)))).alias("number")).withColumn("rule", F.element_at(names, F.col("number")))
    blank = {"verdict": F.lit("pass"), "evidence_count": F.lit(0).cast("bigint"), "missing_count": F.lit(0).cast("bigint")}
    passed = idle.select(*(F.col(f.name) if f.name in idle.columns else blank.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in checked.schema))
    return checked.withColumn("rules_applied", F.lit(True)).unionByName(passed.withColumn("rules_applied", F.lit(False)))
