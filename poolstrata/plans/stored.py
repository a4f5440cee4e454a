"""Queries over stored facts, bodies that don't parse, pages by seeking and lenses that need each other, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import testdata as D
from ..catalog import CATALOG, FAMILIES, Lens
from ..operators import lenses, resolve, snapshot
from ..sources import facts, published
from ..storage import matched, shared_folder, written
from .chain import confirmed, frames, in_bytes, members, spends
from .contract import snapshot_bodies

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ---- facts -----------------------------------------------------------------------------------------------------------


@query
def stored_facts(spark, sf_dir):
    """Outpoints resolved against raw outputs and confirmed answers that are stored by transaction and don't move."""
    entry = members(spark, sf_dir)
    outputs, answers = facts.store_outputs(in_bytes(D.tx_outputs(spark, sf_dir)), 8), facts.store_confirmed(confirmed(spark, sf_dir), 8)
    known = facts.known_stored(spends(spark, sf_dir), in_bytes(entry), outputs, answers)
    got = resolve.facts_for(entry.join(matched(known), "k"))
    return got.groupBy("source_id", "is_parent", "fact_state").agg(F.count("*").alias("n"), F.count("script").alias("scripts"))


#: Batches of answers: which inputs each asks for, and whose script it reports wrongly.
BATCHES = ((1, "k % 2 = 0", "false"), (2, "k % 3 = 0", "k % 19 = 0"), (3, "k % 5 = 0", "false"))


def batch_of(spark, sf_dir, where: str, wrong: str) -> DataFrame:
    rows = D.tx_inputs(spark, sf_dir).where(f"not from_mempool and {where}")
    script = F.when(F.col("utxo_outcome") == "found", F.when(F.expr(wrong), F.unhex(F.lit("51"))).otherwise(F.unhex("utxo_script_hex")))
    return rows.select(F.unhex("prev_txid").alias("prev_txid"), "prev_vout", F.col("utxo_outcome").alias("fetch"), script.alias("script"))


@query
def fact_memory_table(spark, sf_dir):
    """Three batches of answers into the bucketed memory, of which the second and the first come again at the end."""
    path = shared_folder(spark, "memory")
    for number, where, wrong in (*BATCHES, BATCHES[1], BATCHES[0]):
        facts.remember(batch_of(spark, sf_dir, where, wrong), number, path, 16)
    return facts.remembered(spark, path).select(F.lower(F.hex("prev_txid")).alias("prev_txid"), "prev_vout", F.lower(F.hex("script")).alias("script_hex"), "batch")


# ---- bodies and pages ------------------------------------------------------------------------------------------------

#: Which of seven faults a body has; two are none.
FAULT = "(generation * 3 + ascii(substr(source_id, 6, 1)) - 97) % 7"


@query
def spoilt_bodies(spark, sf_dir):
    """Bodies of which most are spoilt: each of these is a row with its reason, and the others are read."""
    body, fault = F.col("body"), F.expr(FAULT)
    swap = lambda old, new: F.regexp_replace(body, F.lit(old), F.lit(new))
    spoilt = (
        F.when(fault == 1, F.left(body, F.length(body) - 20)).when(fault == 2, swap('"tip_height":900000', '"tip_height":"high"')).when(fault == 3, swap('"revision":', '"odd":1,"revision":'))
        .when(fault == 4, swap('"wtxid":', '"odd":1,"wtxid":')).when(fault == 5, swap('"tip_hash":"[0-9a-f]*",', "")).otherwise(body)
    )
    heads, entries, rejects = published.read_published(snapshot_bodies(spark, sf_dir).withColumn("body", spoilt))
    read = entries.groupBy("source_id", "generation").agg(F.count("*").alias("n")).join(heads.select("source_id", "generation", F.array_join("reasons", ",").alias("reason")), ["source_id", "generation"])
    return read.select("source_id", "generation", "reason", "n").unionByName(rejects.select("source_id", "generation", "reason", F.lit(0).cast("bigint").alias("n")))


@query
def seek_page(spark, sf_dir):
    """a page of all transactions, found by counts of id prefixes; nothing but the page's range is sorted."""
    rows = D.entries(spark, sf_dir).select("txid", "vsize").distinct()
    return snapshot.page(written(rows, "page"), 7).select("txid", "vsize", *(F.col(c).cast("bigint").alias(c) for c in ("page", "first_match", "last_match")))


# ---- lenses ----------------------------------------------------------------------------------------------------------


def family_mix(transactions: DataFrame, outputs: DataFrame, inputs: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    own = F.size(F.array_intersect("labels", F.array(*map(F.lit, FAMILIES))))
    label = F.when(own <= 1, "one_family").otherwise("many_families")
    return given["transaction_properties"].select(*lenses.keys_of(transactions), "state", label.alias("primary_label"), F.array(label).alias("labels"), "missing_facts")


def mix_width(transactions: DataFrame, outputs: DataFrame, inputs: DataFrame, given: dict[str, DataFrame]) -> DataFrame:
    sure = (F.col("primary_label") == "one_family") & (F.col("state") == "complete")
    label = F.when(sure, "narrow").otherwise("wide")
    return given["family_mix"].select(*lenses.keys_of(transactions), "state", label.alias("primary_label"), F.array(label).alias("labels"), "missing_facts")


#: Two lenses beside the catalog's; the first of them reads the second's labels, which reads the properties lens's.
MIX_LENSES = [
    Lens("mix_width", "1", "exact", "single_label", ("raw_transaction",), ("narrow", "wide"), mix_width, ("family_mix",)),
    Lens("family_mix", "1", "exact", "single_label", ("raw_transaction",), ("one_family", "many_families"), family_mix, ("transaction_properties",)),
]


@query
def dependent_lenses(spark, sf_dir):
    """Registered lenses that read other lenses' labels, planned by their needs."""
    t, o, i, spent = frames(spark, sf_dir, family=True, matches=True)
    got = lenses.classify(t, o, i, [*CATALOG, *MIX_LENSES], spent)
    label = lambda name: lenses.result_of(name)["primary_label"].alias(name)
    shown = got.select("source_id", lenses.result_of("family_mix")["state"].alias("state"), label("family_mix"), label("mix_width"), F.size("classifications").cast("bigint").alias("results"))
    return shown.groupBy("source_id", "state", "family_mix", "mix_width", "results").agg(F.count("*").alias("n"))


# ---- SQL -------------------------------------------------------------------------------------------------------------


def queries(known: dict[str, str], with_entry: str, with_classified: str, inputs: str) -> dict[str, str]:
    """DuckDB SQL, on the texts of the derived tables and of the queries that are there already."""
    script = lambda wrong: f"case when {wrong} then '51' else utxo_script_hex end"
    (_, in1, _), (_, in2, wrong2), (_, in3, _) = BATCHES
    families = ", ".join(f"'{f}'" for f in FAMILIES)
    return {
        "stored_facts": known["prevout_facts"],
        "fact_memory_table": inputs + f""", f as (select distinct prev_txid, prev_vout, k, vin, utxo_script_hex from inputs where not from_mempool and utxo_outcome = 'found'),
          one as (select *, case when {in1} then utxo_script_hex end as s1, case when {in1} then 1 end as b1 from f),
          two as (select *, case when not ({in2}) then s1 when s1 is null or s1 = {script(wrong2)} then {script(wrong2)} end as s2, case when not ({in2}) or s1 = {script(wrong2)} then b1 else 2 end as b2 from one),
          three as (select *, case when not ({in3}) then s2 when s2 is null or s2 = utxo_script_hex then utxo_script_hex end as s3, case when not ({in3}) or s2 = utxo_script_hex then b2 else 3 end as b3 from two)
          select prev_txid, prev_vout, s3 as script_hex, cast(b3 as bigint) as batch from three where s3 is not null""",
        "spoilt_bodies": with_classified + f""", g as (select source_id, k // 1000 as generation, count(*) as n from classified group by all), r as (select *, case {FAULT} when 1 then 'not_json' when 2 then 'wrong_type' when 3 then 'unknown_member' when 4 then 'unknown_member' when 5 then 'missing_member' else '' end as reason from g)
          select source_id, generation, reason, case when reason = '' then n else 0 end as n from r""",
        "seek_page": with_entry + ", d as (select distinct txid, vsize from entry), m as (select *, row_number() over (order by txid) - 1 as i, count(*) over () as total from d), p as (select *, least(7, greatest(0, (total + 99) // 100 - 1)) as page from m) select txid, vsize, cast(page as bigint) as page, cast(least(total, page * 100 + 1) as bigint) as first_match, cast(least(total, (page + 1) * 100) as bigint) as last_match from p where i // 100 = page",
        "dependent_lenses": f"with p as ({known['properties_labels']}), m as (select source_id, state, case when len(list_filter(string_split(labels, ','), lambda x: x in ({families}))) <= 1 then 'one_family' else 'many_families' end as family_mix from p) select source_id, state, family_mix, case when family_mix = 'one_family' and state = 'complete' then 'narrow' else 'wide' end as mix_width, cast({len(CATALOG) + 2} as bigint) as results, count(*) as n from m group by all",
    }
