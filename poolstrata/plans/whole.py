"""The whole way of a snapshot as one query, coinbase transactions, a pinned sample and the cipher's known texts; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import testdata as D
from ..functions import scripts as S
from ..operators import lenses, resolve, snapshot
from ..sources import published, transactions
from ..storage import OWNER, matched, shared_folder, written
from .chain import frames, in_bytes, raw_transactions

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def end_to_end(spark, sf_dir):
    """Raw bytes decoded, their facts resolved, terminal transactions classified, the snapshot published and
    read back, and its statuses counted. Decoded ids are those of the bytes, so parents are confirmed coins here."""
    raw = raw_transactions(spark, sf_dir).withColumnRenamed("k", OWNER)
    told = transactions.with_coinbase(transactions.decoded(raw, [OWNER])).withColumn("replaceable", S.explicit_rbf("inputs"))
    decoded = written(told.select(OWNER, F.col("asked_txid").alias("txid"), F.col("asked_wtxid").alias("wtxid"), F.col("reason").isNull().alias("good"), "version", "is_coinbase", "replaceable", "inputs", "outputs"), "decoded")
    good, ids = decoded.where("good"), decoded.select(OWNER, "txid", "wtxid")
    facts = [c for c in D.entry_columns(D.SPARK) if c not in ("txid", "wtxid", "replaceable")]
    entries = matched(D.entries_of(decoded.select(F.col(OWNER).alias("k"))).select(F.col("k").alias(OWNER), "source_id", "generation", *facts).join(ids, OWNER))
    outputs, spent = transactions.exploded_outputs(good, [OWNER]), transactions.exploded_inputs(good, [OWNER])
    answers = D.tx_inputs(spark, sf_dir).select(F.unhex("prev_txid").alias("prev_txid"), "prev_vout", "utxo_outcome", F.unhex("utxo_script_hex").alias("utxo")).repartition("prev_txid")
    answers = answers.groupBy("prev_txid", "prev_vout").agg(F.min("utxo_outcome").alias("outcome"), F.min("utxo").alias("utxo"))
    confirmed = answers.select("prev_txid", "prev_vout", "outcome", F.when(F.col("outcome") == "found", F.col("utxo")).alias("script"))
    of_raw = in_bytes(transactions.exploded_outputs(good, ["txid"]).select("txid", "vout", "script"))
    known = resolve.known_spends(spent.withColumn("prev_txid", F.unhex("prev_txid")), in_bytes(entries), of_raw, confirmed)
    asked = written(lenses.input_matches(lenses.with_family(resolve.for_askers(known))), "inputs")
    candidates = entries.select(OWNER, "source_id").join(good.select(OWNER, "version", "is_coinbase"), OWNER)
    inputs = resolve.told_to(candidates.select(OWNER, "source_id").join(asked, OWNER))
    by = [OWNER, "source_id"]
    ready = written(candidates.join(resolve.terminal_candidates(inputs, by), by, "left_semi"), "terminal")
    terminal = matched(ready.join(ids, OWNER))
    results = lenses.classify(terminal, outputs, inputs, spent=spent).drop("txid", "wtxid").join(good.select(OWNER, "replaceable"), OWNER)
    folder = shared_folder(spark, "entries")
    published.write_entries(snapshot.materialise(entries, results, OWNER).drop(OWNER).withColumn("replaceable", F.coalesce("replaceable", F.lit(False))), folder)
    read = published.read_entries(spark, folder)
    labels = lenses.result_of("transaction_properties")["labels"]
    has = lambda label: F.count_if(F.coalesce(F.array_contains(labels, label), F.lit(False))).alias(label)
    return read.groupBy("source_id", F.coalesce("bip110.status", F.lit("unclassified")).alias("status")).agg(F.count("*").alias("n"), F.sum("vsize").alias("vsize"), F.count_if("replaceable").alias("replaceable"), has("p2tr"), has("p2wpkh"), has("signals_rbf"))


@query
def coinbase_labels(spark, sf_dir):
    """H2, H4 of coinbase transactions: their inputs prove nothing, so they are no coinjoin and no other shape, and break no rule of inputs."""
    t, o, i, spent = frames(spark, sf_dir, matches=True)
    by = lenses.told_by(t)
    minted = t.select(*lenses.keys_of(t), "version", F.expr("owner % 31 = 0").alias("is_coinbase"))
    shape = lenses.transaction_shape(minted, o, i, lenses.data_protocols(minted, lenses.detections(o, spent)))
    status = lenses.assessed_rules(lenses.rule_rows(minted, o, i)).select(*by, F.col("bip110.status").alias("status"))
    rows = shape.join(status, by).join(minted.select(*by, "is_coinbase"), by)
    return rows.groupBy("source_id", "is_coinbase", "state", F.array_join("labels", ",").alias("labels"), "status").agg(F.count("*").alias("n"))


PINNED = 33


@query
def pinned_sample(spark, sf_dir):
    """of each source the eight largest, of which the last gives way to the pinned transaction where it is none of them."""
    pinned = D.table(spark, sf_dir, "orders").where(f"o_orderkey = {PINNED}").select(F.sha2(F.concat(F.lit("tx:"), F.col("o_orderkey").cast("string")), 256)).first()
    return snapshot.sample(D.entries(spark, sf_dir), 8, pinned[0] if pinned else "").select("source_id", "txid", "vsize", F.col("rank").cast("bigint").alias("rank"))


#: Published texts of the cipher, as key, plain text and enciphered bytes in hex.
CIPHERED = (("Key", "Plaintext", "bbf316e8d940af0ad3"), ("Wiki", "pedia", "1021bf0420"), ("Secret", "Attack at dawn", "45a01f645fc35b383552544b9bf5"))


@query
def cipher_constants(spark, sf_dir):
    """Each order deciphers one of the published texts."""
    pick = lambda n: F.element_at(F.array(*(F.lit(x[n]) for x in CIPHERED)), (F.col("o_orderkey") % len(CIPHERED) + 1).cast("int"))
    rows = D.table(spark, sf_dir, "orders").select("o_orderkey", S.arc4_apply(pick(0).cast("binary"), F.unhex(pick(2))).cast("string").alias("plain"))
    return rows.groupBy((F.col("o_orderkey") % len(CIPHERED)).alias("which"), "plain").agg(F.count("*").alias("n"))


def queries(known: dict[str, str], with_entry: str, base: str, family: str, resolved: str, rules: str) -> dict[str, str]:
    """DuckDB SQL. base: the derived tables; family: a script's family; resolved and rules: candidates, their inputs and verdicts."""
    plain = ", ".join(f"({k}, '{text}')" for k, (_, text, _) in enumerate(CIPHERED))
    return {
        "end_to_end": base + f""", u as (select prev_txid, prev_vout, min(utxo_outcome) as outcome, min(utxo_script_hex) as hex from inputs group by all),
          known as (select i.k, i.vin, i.sequence, u.outcome, case when u.outcome = 'found' then u.hex end as script_hex from inputs i join u using (prev_txid, prev_vout)),
          fit as (select k, bool_or(sequence < 4294967294) as rbf, bool_or(script_hex is null) as blind from known where k % 53 <> 0 and k in (select k from outputs) group by k having bool_and(outcome <> 'retryable')),
          large as (select distinct k from outputs where length(script_hex) / 2 > case when script_hex like '6a%' then 83 else 34 end),
          fam as (select k, {family} as family from outputs union select k, {family} from known where script_hex is not null),
          s as (select e.source_id, e.vsize, f.k as done, f.rbf, case when f.k is null then 'unclassified' when l.k is not null then 'violating' when f.blind then 'indeterminate' else 'compatible' end as status,
            f.k is not null and (e.k, 'p2tr') in (select (k, family) from fam) as tr, f.k is not null and (e.k, 'p2wpkh') in (select (k, family) from fam) as wpkh from entry e left join fit f on f.k = e.k left join large l on l.k = e.k where e.k in (select k from outputs))
          select source_id, status, count(*) as n, cast(sum(vsize) as bigint) as vsize, count(*) filter (rbf) as replaceable, count(*) filter (tr) as p2tr, count(*) filter (wpkh) as p2wpkh, count(*) filter (rbf) as signals_rbf from s group by all""",
        "coinbase_labels": f"""with shown as ({known['shape_labels']}), key as ({with_entry}select source_id, txid, k from entry), plain as (select s.*, k, k % 31 = 0 as is_coinbase from shown s join key using (source_id, txid)),
          kept as (select source_id, k, is_coinbase, case when is_coinbase then 'partial' else state end as state, case when is_coinbase then array_to_string(list_filter(string_split(labels, ','), lambda x: x not in ('possible_coinjoin', 'other_shape')), ',') else labels end as labels from plain),
          verdict as ({resolved}{rules} select source_id, k, bool_or(e > 0 and (number = 1 or k % 31 <> 0)) as v, bool_or(m > 0 and k % 31 <> 0) as u from verdicts group by all)
          select source_id, is_coinbase, state, labels, case when v then 'violating' when u then 'indeterminate' else 'compatible' end as status, count(*) as n from kept join verdict using (source_id, k) group by all""",
        "pinned_sample": with_entry + f", r as (select source_id, k, txid, vsize, row_number() over (partition by source_id order by vsize desc, txid) as place from entry), p as (select source_id, place from r where k = {PINNED}), s as (select r.* from r left join p using (source_id) where r.place <= case when p.place > 8 then 7 else 8 end or r.place = p.place) select source_id, txid, vsize, row_number() over (partition by source_id order by vsize desc, txid) as rank from s",
        "cipher_constants": f"select o_orderkey % {len(CIPHERED)} as which, plain, count(*) as n from orders join (values {plain}) p(which, plain) on p.which = o_orderkey % {len(CIPHERED)} group by all",
    }
