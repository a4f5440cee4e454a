"""Fact resolution: each input's spent script from a parent in the same mempool, else from the confirmed set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import matched

TERMINAL = ("ready", "explicitly_missing")


def distinct_outpoints(inputs: DataFrame) -> DataFrame:
    """One lookup for each outpoint, however many transactions spend or try to spend it."""
    return inputs.select("source_id", "prev_txid", "prev_vout").distinct()


def resolve_outpoints(outpoints: DataFrame, membership: DataFrame, outputs: DataFrame, utxo: DataFrame) -> DataFrame:
    """Distinct outpoints with is_parent, script and fact_state.

    outputs: (txid, vout, script) of raw transactions that were found; utxo: (prev_txid, prev_vout, outcome, script).
    A parent whose raw transaction was found proves its scripts, and one without the output stays pending. A parent not
    found falls back to the confirmed answer: found is proof, null is not. Other outpoints take the confirmed answer.
    """
    asked = outpoints.groupBy("prev_txid").agg(F.collect_set(F.struct("source_id", "prev_vout")).alias("_asked"))
    met = with_answers(asked, membership, by_transaction(outputs, "txid", "vout", "raw_outputs", ["script"]), by_transaction(utxo, "prev_txid", "prev_vout", "confirmed", ["outcome", "script"]))
    rows = met.select("*", F.explode("_asked").alias("_x")).select("*", "_x.source_id", "_x.prev_vout")
    return rows.select("source_id", "prev_txid", "prev_vout", *told()).select("source_id", "prev_txid", "prev_vout", "is_parent", *fact_columns())


def known_spends(spends: DataFrame, membership: DataFrame, outputs: DataFrame, utxo: DataFrame) -> DataFrame:
    """spends (prev_txid, prev_vout and whatever else) with what is known of each outpoint, whichever source asks: ``_known``, for facts_for."""
    return known_by(spends, membership, by_transaction(outputs, "txid", "vout", "raw_outputs", ["script"]), by_transaction(utxo, "prev_txid", "prev_vout", "confirmed", ["outcome", "script"]))


def known_by(spends: DataFrame, membership: DataFrame, outputs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """known_spends with outputs and answers by transaction. Outpoints are made distinct and looked up once; what is known of a hot one is fanned
    out by a join of its own."""
    asked = spends.groupBy("prev_txid").agg(F.collect_set("prev_vout").alias("_asked"))
    rows = with_answers(asked, membership, outputs, confirmed).select("*", F.explode("_asked").alias("prev_vout"))
    known = rows.select("prev_txid", "prev_vout", F.struct("_members", *told(None)).alias("_known"))
    return spends.join(matched(known), ["prev_txid", "prev_vout"], "left")


def facts_for(rows: DataFrame) -> DataFrame:
    """Rows of known_spends that each name the source_id that asks, with is_parent, script and fact_state."""
    asks = F.coalesce(F.array_contains("_known._members", F.col("source_id")), F.lit(False)).alias("is_parent")
    seen = rows.select("*", asks, *(F.col(f"_known.{n}").alias(n) for n in KNOWN))
    return seen.select(*rows.columns, "is_parent", *fact_columns()).drop("_known")


def for_askers(rows: DataFrame) -> DataFrame:
    """Rows of known_spends as each kind of asker sees them, with is_parent, script and fact_state: one for the sources that have the spent transaction, where
    any has it, and one for the others. What lenses make of a spent script is made of these, once for all sources; ``told_to`` picks a source's."""
    kinds = F.when(F.size("_known._members") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    seen = rows.select("*", F.explode(kinds).alias("is_parent"), F.col("_known._members").alias("_members"), *(F.col(f"_known.{n}").alias(n) for n in KNOWN))
    return seen.select(*(c for c in rows.columns if c != "_known"), "_members", "is_parent", *fact_columns())


def told_to(rows: DataFrame) -> DataFrame:
    """Of for_askers' rows that name the source_id that asks those that are for it."""
    return rows.where(F.coalesce(F.array_contains("_members", F.col("source_id")), F.lit(False)) == F.col("is_parent")).drop("_members")


def by_transaction(rows: DataFrame, txid: str, vout: str, name: str, values: list[str]) -> DataFrame:
    """A row for each transaction, with what is known of its outputs (as many as fit in it) as an array."""
    return rows.groupBy(F.col(txid).alias("prev_txid")).agg(F.collect_list(F.struct(F.col(vout).alias("vout"), *values)).alias(name))


def with_answers(asked: DataFrame, membership: DataFrame, outputs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """asked with what is known of the transaction prev_txid: the sources that have it, its outputs and confirmed answers. All four are dealt by
    that id, once; tables that are bucketed by it stay where they are."""
    members = membership.groupBy(F.col("txid").alias("prev_txid")).agg(F.collect_set("source_id").alias("_members"))
    return asked.join(matched(members), "prev_txid", "left").join(matched(outputs), "prev_txid", "left").join(matched(confirmed), "prev_txid", "left")


def at_vout(rows: str) -> Column:
    return F.try_element_at(F.filter(rows, lambda x: x["vout"] == F.col("prev_vout")), F.lit(1))


#: What the answers say of an outpoint, whoever asks.
KNOWN = ("parent_script", "raw_found", "outcome", "utxo_script")


def told(source: str | None = "source_id") -> list[Column]:
    """What the answers say of one outpoint, for fact_columns; without a source, what they say to any."""
    answer = at_vout("confirmed")
    parent = [] if source is None else [F.coalesce(F.array_contains("_members", F.col(source)), F.lit(False)).alias("is_parent")]
    known = at_vout("raw_outputs")["script"], F.col("raw_outputs").isNotNull(), answer["outcome"], answer["script"]
    return [*parent, *(x.alias(n) for x, n in zip(known, KNOWN, strict=True))]


def fact_columns() -> list[Column]:
    raw_found, found = F.coalesce("raw_found", F.lit(False)), F.col("outcome") == "found"
    by_parent = F.col("is_parent") & F.col("parent_script").isNotNull()
    by_utxo = found & (~F.col("is_parent") | ~raw_found)
    state = F.when(by_parent, "ready").when(by_utxo, "ready").when(~F.col("is_parent") & (F.col("outcome") == "null"), "explicitly_missing").otherwise("pending")
    script = F.when(by_parent, F.col("parent_script")).when(by_utxo, F.col("utxo_script"))
    return [script.alias("script"), state.alias("fact_state")]


def resolve_inputs(inputs: DataFrame, membership: DataFrame, outputs: DataFrame, utxo: DataFrame) -> DataFrame:
    """inputs with is_parent, script and fact_state: outpoints are resolved once and fanned out again."""
    facts = resolve_outpoints(inputs, membership, outputs, utxo)
    return inputs.join(matched(facts), ["source_id", "prev_txid", "prev_vout"], "left")


def terminal_candidates(resolved: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys (source_id and txid) of transactions all of whose facts are ready or explicitly missing."""
    return resolved.groupBy(*(keys or ["source_id", "txid"])).agg(F.bool_and(F.col("fact_state").isin(*TERMINAL)).alias("ok")).where("ok").drop("ok")


def reconcile(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses by request id, and batch errors.

    The first has a row for each request, its response NULL where none came. The second names batches with a duplicate, an
    unexpected or more responses than requests; their rows aren't to be trusted.
    """
    key = ["batch_id", "id"]
    answers = responses.groupBy(*key).agg(F.count("*").alias("n"), F.first("outcome").alias("outcome"), F.first("value").alias("value"))
    matched = requests.join(answers.drop("n"), key, "left")
    repeated = answers.where("n > 1").select("batch_id", F.lit("duplicate").alias("reason"))
    strange = answers.join(requests, key, "left_anti").select("batch_id", F.lit("unexpected").alias("reason"))
    sizes = requests.groupBy("batch_id").agg(F.count("*").alias("asked")).join(responses.groupBy("batch_id").agg(F.count("*").alias("got")), "batch_id")
    excess = sizes.where("got > asked").select("batch_id", F.lit("excess").alias("reason"))
    return matched, repeated.unionByName(strange).unionByName(excess).distinct()
