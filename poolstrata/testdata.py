"""Chain-shaped tables derived from the driver's ``orders``, ``lineitem`` and ``events`` by integer arithmetic and SHA-256.

The expressions are text that Spark SQL and DuckDB both run; what differs between them is filled in ({sha}, {str}, {div}).
Queries use the DataFrames below; the SQL oracles use the same base tables as common table expressions and compute the
operators' results on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import matched

SPARK = {"sha": lambda x: f"sha2({x}, 256)", "str": "string", "div": "div", "big": "bigint"}
DUCK = {"sha": lambda x: f"sha256({x})", "str": "varchar", "div": "//", "big": "bigint"}
SOURCES = {"node-a": "k % 10 < 8", "node-b": "k % 10 >= 2", "node-c": "k % 4 = 0"}
OBSERVED = {"node-a": 1704067200000, "node-b": 1704067203000, "node-c": 1704067190000}
NOW = 1704067200000


def entry_columns(d: dict) -> dict[str, str]:
    """Membership facts of order k."""
    sha, div = d["sha"], d["div"]
    s = f"cast(k as {d['str']})"
    vsize = "(65 + (7919 * k) % 3000)"
    return {
        "txid": sha(f"concat('tx:', {s})"),
        "wtxid": f"case when k % 2 = 0 then {sha(f'concat(chr(116), chr(120), chr(58), {s})')} when source_id = 'node-b' and k % 37 = 0 then {sha(f'concat(chr(119), chr(98), chr(58), {s})')} else {sha(f'concat(chr(119), chr(58), {s})')} end",
        "vsize": vsize,
        "weight": f"4 * {vsize} - k % 4",
        "fee_sats": f"({vsize} * ((131 * k) % 2000)) {div} 10",
        "entered_at_ms": f"{NOW} - (104729 * k) % 345600000 + (case when k % 101 = 0 then 900000000 else 0 end)",
        "ancestor_count": "1 + (case when k % 5 = 0 then k % 13 else 0 end)",
        "ancestor_vsize": f"{vsize} + 150 * (case when k % 5 = 0 then k % 13 else 0 end)",
        "ancestor_fee_sats": f"({vsize} * ((131 * k) % 2000)) {div} 10 + 400 * (case when k % 5 = 0 then k % 13 else 0 end) - (case when k % 97 = 0 then 5000000 else 0 end)",
        "descendant_count": "1 + (case when k % 7 = 0 then k % 11 else 0 end)",
        "descendant_vsize": f"{vsize} + 120 * (case when k % 7 = 0 then k % 11 else 0 end)",
        "replaceable": "k % 3 = 0",
    }


#: State of an entry's results, for the bucket and panel queries: status, rule masks, lens state and labels.
RESULT_COLUMNS = {
    "status": "case when k % 50 = 7 then null when k % 16 = 1 then 'violating' when k % 25 = 2 then 'indeterminate' else 'compatible' end",
    "violated_mask": "case when k % 50 = 7 or k % 16 <> 1 then 0 else (k * 37) % 127 + 1 end",
    "unknown_mask": "case when k % 50 = 7 then 0 when k % 16 = 1 then (case when k % 48 = 1 then (k * 11) % 64 * 2 else 0 end) when k % 25 = 2 then 126 else 0 end",
    "properties_state": "case when k % 50 = 7 then null when k % 14 = 3 then 'partial' else 'complete' end",
    "family_a": "k % 13",
    "family_b": "case when k % 3 = 0 then (k * 5) % 13 else k % 13 end",
    "input_count": "1 + k % 12",
    "output_count": "1 + (k * 3) % 17",
    "op_return_bytes": "case when k % 9 = 0 then k % 90 else 0 end",
    "output_sats": "((k * 7919) % 100000) * 100000",
}
#: Family of each residue that family_a and family_b take.
RESIDUE_FAMILIES = ("p2pk", "bare_multisig", "p2pkh", "p2sh", "p2wsh", "p2tr", "p2a", "unknown_witness_program", "op_return", "p2wpkh", "p2tr", "p2wpkh", "unknown_script")
SCRIPT_HEX = (
    "concat('2102', h, 'ac')", "concat('512102', h, '2103', g, '52ae')", "concat('76a914', substr(h, 1, 40), '88ac')", "concat('a914', substr(h, 1, 40), '87')", "concat('0020', h)", "concat('5120', h)",
    "'51024e73'", "'5204deadbeef'", "'6a5d0401020304'", "'6a086f6d6e6900000001'", "concat('6a4c50', repeat('ab', 80))", "concat('6a4c51', repeat('ab', 81))", "concat('0014', substr(h, 1, 40))", "'ff00'",
)


def script_case(d: dict) -> str:
    cases = " ".join(f"when {n} then {text}" for n, text in enumerate(SCRIPT_HEX))
    return f"case (case when part % 131 = 7 then 13 else part % 13 end) {cases} end"


def source_entries_sql(d: dict) -> str:
    facts = ", ".join(f"cast({e} as {d['big']}) as {n}" if n not in ("txid", "wtxid", "replaceable") else f"{e} as {n}" for n, e in entry_columns(d).items())
    parts = " union all ".join(f"select o_orderkey as k, '{s}' as source_id from orders where {w.replace('k ', 'o_orderkey ')}" for s, w in SOURCES.items())
    return f"select source_id, k, {facts} from ({parts}) t"


def outputs_sql(d: dict) -> str:
    return (
        f"select k, txid, cast(row_number() over (partition by k order by line, part, supp) - 1 as {d['big']}) as vout, value_sats, {script_case(d)} as script_hex from "
        f"(select l_orderkey as k, {d['sha']('concat(' + chr(39) + 'tx:' + chr(39) + ', cast(l_orderkey as ' + d['str'] + '))')} as txid, l_linenumber as line, l_partkey as part, l_suppkey as supp, "
        f"cast(round(100 * l_extendedprice) as {d['big']}) as value_sats, {d['sha']('cast(l_partkey as ' + d['str'] + ')')} as h, {d['sha']('cast(l_suppkey as ' + d['str'] + ')')} as g from lineitem) t"
    )


def inputs_sql(d: dict, per_order: str) -> str:
    """per_order: rows (k, vin), which each dialect unnests in its own way."""
    s = lambda x: f"cast({x} as {d['str']})"
    prev = "(31 * k + 17 * vin) % greatest(k, 1)"
    tx = d["sha"](f"concat('tx:', {s(prev)})")
    utxo = d["sha"](f"concat('utxo:', {s('k')}, ':', {s('vin')})")
    return (
        f"select k, {d['sha'](f'concat(chr(116), chr(120), chr(58), {s(chr(107))})')} as txid, cast(vin as {d['big']}) as vin, (k + vin) % 3 = 0 as from_mempool, "
        f"case when (k + vin) % 3 = 0 then {tx} else {utxo} end as prev_txid, cast(case when (k + vin) % 3 = 0 then vin % 3 else 0 end as {d['big']}) as prev_vout, "
        f"cast(case when k % 5 = 0 then 4294967293 else 4294967295 end as {d['big']}) as sequence, cast(case when k % 7 < 4 then 1 + k % 3 else 0 end as int) as witness_items, "
        f"case when (k + vin) % 29 = 0 then 'retryable' when (13 * k + vin) % 11 = 0 then 'null' else 'found' end as utxo_outcome, "
        f"case when (k * 7 + vin) % 5 = 0 then concat('5120', {d['sha'](f'concat(chr(117), {s(chr(107))}, chr(58), {s(chr(118) + chr(105) + chr(110))})')}) else concat('0014', substr({d['sha'](f'concat(chr(117), {s(chr(107))}, chr(58), {s(chr(118) + chr(105) + chr(110))})')}, 1, 40)) end as utxo_script_hex from ({per_order}) t"
    )


# ---- Spark side ------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_keys(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """k of every order; dealt: spread by k while a row is one number, so that what is made of it is made everywhere and meets by k where it is."""
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return k.repartition("k") if dealt else k


def entries(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Membership of all sources: source_id, generation, k and the facts."""
    return entries_of(order_keys(spark, sf_dir, dealt))


def entries_of(orders: DataFrame) -> DataFrame:
    """Membership of the sources that have these orders (k), made where the orders lie."""
    sources = F.array_compact(F.array(*(F.when(F.expr(where), F.lit(name)) for name, where in SOURCES.items())))
    rows = orders.select("k", F.explode(sources).alias("source_id"))
    facts = [F.expr(e).cast("bigint").alias(n) if n not in ("txid", "wtxid", "replaceable") else F.expr(e).alias(n) for n, e in entry_columns(SPARK).items()]
    return matched(rows.select("source_id", F.lit(1).cast("bigint").alias("generation"), "k", *facts))


def families_of(residue: str):
    return F.element_at(F.array(*map(F.lit, RESIDUE_FAMILIES)), (F.col(residue) + 1).cast("int"))


def classified(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Entries with results: status, rule lists, properties lens (state, labels), structure; NULL where unclassified."""
    from .catalog import FAMILIES
    from .functions.columns import rules_of_mask

    rows = entries(spark, sf_dir, dealt).select("*", *(F.expr(e).alias(n) for n, e in RESULT_COLUMNS.items()))
    both = F.array(families_of("family_a"), families_of("family_b"))
    labels = F.filter(F.array(*map(F.lit, FAMILIES)), lambda x: F.array_contains(both, x))
    structure = F.struct(*(F.col(n).cast("bigint").alias(n) for n in ("input_count", "output_count", "op_return_bytes", "output_sats")), F.lit(0).cast("bigint").alias("witness_bytes"))
    known = F.col("properties_state").isNotNull()
    return rows.select(
        "source_id", "generation", "k", *entry_columns(SPARK), F.lit(NOW).cast("bigint").alias("observed_at_ms"), "status",
        F.when(known, rules_of_mask(F.col("violated_mask").cast("int"))).alias("violated_rules"), F.when(known, rules_of_mask(F.col("unknown_mask").cast("int"))).alias("unknown_rules"),
        F.col("properties_state").alias("state"), F.when(known, labels).alias("labels"), F.when(known, structure).alias("structure"),
    )


def txid_of(k: str):
    return F.sha2(F.concat(F.lit("tx:"), F.col(k).cast("string")), 256).alias("txid")


def tx_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, txid, vout, value_sats, script (and its hex) of every transaction."""
    w = F.row_number().over(Window.partitionBy("k").orderBy("line", "part", "supp")) - 1
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.round(100 * F.col("l_extendedprice")).cast("bigint").alias("value_sats"))
    # numbers are dealt by the window, and texts made of them where they are then
    numbered = lines.withColumn("vout", w.cast("bigint")).withColumns({"h": F.sha2(F.col("part").cast("string"), 256), "g": F.sha2(F.col("supp").cast("string"), 256)})
    return matched(numbered.select("k", txid_of("k"), "vout", "value_sats", F.expr(script_case(SPARK)).alias("script_hex")).withColumn("script", F.unhex("script_hex")))


def tx_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, txid, vin, outpoint, sequence, witness size, and the confirmed lookup's answer of every input."""
    per_order = "select k, explode(sequence(0, cast(k % 12 as int))) as vin from {orders}"
    return matched(spark.sql(inputs_sql(SPARK, per_order), orders=order_keys(spark, sf_dir, dealt=True)))


def base_ctes(*names: str) -> str:
    """WITH clause of base tables for an oracle."""
    texts = {
        "entry": source_entries_sql(DUCK),
        "outputs": outputs_sql(DUCK),
        "inputs": inputs_sql(DUCK, "select o_orderkey as k, unnest(range(0, o_orderkey % 12 + 1)) as vin from orders"),
        "classified": "select *, " + ", ".join(f"{e} as {n}" for n, e in RESULT_COLUMNS.items()) + " from entry",
    }
    return "with " + ", ".join(f"{n} as ({texts[n]})" for n in names) + " "

