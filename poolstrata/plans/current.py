"""Queries over keyed state, retry waves, slices and deployment windows, and their DuckDB SQL.

What the two share is the text that derives a query's input from the driver's tables ({orders}, {events} and {lineitem} stand for them);
the results are computed apart: the SQL folds each key's rows one by one, in a recursive query, where Spark keeps state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import testdata as D
from ..operators import deployments, lenses, slices
from ..streaming.run import land, run_results, run_revisions
from .chain import frames

QUERIES = {}
SQL = {}
KEEP_MS = 900_000
GENERATIONS = 4


def query(f):
    QUERIES[f.__name__] = f
    return f


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{name: D.table(spark, sf_dir, name) for name in ("orders", "events", "lineitem") if f"{{{name}}}" in text})


def in_duck(text: str) -> str:
    for spark, duck in (("{orders}", "orders"), ("{events}", "events"), ("{lineitem}", "lineitem"), (" div ", " // "), ("as string)", "as varchar)")):
        text = text.replace(spark, duck)
    return text


# ---- current results -------------------------------------------------------------------------------------------------

#: Changes of four generations: members, late members of the generation before, results, newer and older revisions, stale reports.
BASE = f"select o_orderkey as k, g.g as g, concat('node-', cast(o_orderkey % 3 as string)) as source_id, concat('t', cast(o_orderkey as string)) as txid, concat('w', cast(o_orderkey as string), ':', cast(case when o_orderkey % 4 = 0 and g.g >= 3 then 1 else 0 end as string)) as variant from {{orders}} cross join (values {', '.join(f'({g})' for g in range(1, GENERATIONS + 1))}) g(g)"
PARTS = (
    ("(k * 7 + g * g * 5) % 11 < 8", 1, "'member'", "g", "0", "variant", "null"),
    ("k % 13 = 5 and g > 1", 2, "'member'", "g - 1", "0", "'late'", "null"),
    ("(k + g) % 3 <> 0", 10, "'result'", "g", "1 + k % 5", "case when k % 17 = 3 then 'other' else variant end", "concat('L', cast((k * g) % 8 as string))"),
    ("k % 6 = 1", 20, "'result'", "g", "2 + k % 5", "variant", "concat('R', cast((k + g) % 8 as string))"),
    ("k % 6 = 2", 30, "'result'", "g", "k % 5", "variant", "'old'"),
    ("k % 5 = 2 and g > 1", 40, "'result'", "g - 1", "99", "variant", "'stale'"),
)
CHANGES = " union all ".join(
    f"select source_id, txid, cast(g * 1000 + {at} as bigint) as seq, cast({D.NOW} + (g * 1000 + {at}) * 600 as bigint) as at_ms, {kind} as kind, cast({generation} as bigint) as generation, cast({revision} as bigint) as revision, {wtxid} as wtxid, cast({label} as string) as label from ({BASE}) b where {where}"
    for where, at, kind, generation, revision, wtxid, label in PARTS
)


def changes_landed(spark: SparkSession, sf_dir: str) -> str:
    rows = derived(spark, sf_dir, CHANGES)
    return land([rows.where(F.expr(f"seq div 1000 = {g}")).repartition(4, "txid") for g in range(1, GENERATIONS + 1)], "changes")


@query
def result_stream(spark, sf_dir):
    """A stream of membership and deltas into keyed state; transactions that no generation refreshes depart."""
    return run_results(spark, changes_landed(spark, sf_dir), KEEP_MS, prefix=4)[0]  # ids here are a letter and a decimal number


SQL["result_stream"] = f"""with recursive ev as ({in_duck(CHANGES)}), n as (select *, row_number() over (partition by source_id, txid order by seq) as i from ev),
f as (
  select distinct source_id, txid, 0::bigint as i, null::bigint as seq, null::bigint as generation, null::varchar as wtxid, null::bigint as revision, null::varchar as label, null::bigint as due from ev
  union all
  select source_id, txid, i, case when taken or reported then now_seq when alive then seq end, case when taken then now_generation when alive then generation end, case when taken then now_wtxid when alive then wtxid end,
    case when taken then 0 when reported then now_revision when alive then revision end, case when taken then case when alive and wtxid = now_wtxid then label end when reported then now_label when alive then label end,
    case when taken then at_ms + {KEEP_MS} when alive then due end
  from (
    select *, kind = 'member' and (not alive or now_generation > generation) as taken, kind = 'result' and alive and now_generation = generation and now_wtxid = wtxid and now_revision > revision as reported
    from (select f.source_id, f.txid, n.i, f.seq, f.generation, f.wtxid, f.revision, f.label, f.due, n.seq as now_seq, n.at_ms, n.kind, n.generation as now_generation, n.revision as now_revision, n.wtxid as now_wtxid, n.label as now_label,
      f.due is not null and n.at_ms < f.due as alive from f join n on n.source_id = f.source_id and n.txid = f.txid and n.i = f.i + 1)))
select source_id, txid, seq, generation, wtxid, revision, label from f
where due > (select max(at_ms) from ev) and i = (select max(i) from n where n.source_id = f.source_id and n.txid = f.txid)"""


# ---- response revisions ----------------------------------------------------------------------------------------------

#: Polls, failures, deltas and lifecycle changes of three sources, interleaved; deltas are numbered, with repeats, gaps and empty ones.
EVENTS = """select source_id, event_id as seq, kind, case when kind = 'poll' and n % 7 = 6 then generation - 1 when kind = 'delta' and n % 41 = 17 then generation - 1 else generation end as generation,
 cast(case when kind <> 'delta' then 0 when event_id % 89 = 7 then row_number() over (partition by source_id, generation, kind order by event_id) - 1 else row_number() over (partition by source_id, generation, kind order by event_id) end as bigint) as revision,
 cast(case when event_id % 97 = 5 then 0 else 1 + event_id % 9 end as bigint) as n_changed, case when kind = 'lifecycle' then case when event_id % 5 < 2 then 'paused' when event_id % 5 < 4 then 'complete' else 'classifying' end end as lifecycle,
 case when kind = 'failure' then concat('failure ', cast(event_id as string)) end as error
 from (select event_id, concat('node-', cast(event_id % 3 as string)) as source_id, event_id div 3 as n, event_id div 216 as generation,
  case (event_id div 3) % 12 when 0 then 'poll' when 5 then 'failure' when 7 then 'lifecycle' when 8 then 'lifecycle' else 'delta' end as kind from {events}) e"""


def events_landed(spark: SparkSession, sf_dir: str, parts: int = 4) -> str:
    """The events in files that hold them in order; how many there are and where they are cut is no matter."""
    rows = derived(spark, sf_dir, EVENTS)
    last = rows.agg(F.max("seq")).first()[0] or 0
    step = last // parts + 1
    return land([rows.where((F.col("seq") >= k * step) & (F.col("seq") < (k + 1) * step)).repartition(2, "source_id") for k in range(parts)], "events")


@query
def response_revision_stream(spark, sf_dir):
    """Every change of what readers see raises its source's one revision, whatever its kind."""
    return run_revisions(spark, events_landed(spark, sf_dir), 2)[0]


SQL["response_revision_stream"] = f"""with recursive ev as ({in_duck(EVENTS)}), n as (select *, row_number() over (partition by source_id order by seq) as i from ev),
f as (
  select distinct source_id, 0::bigint as i, 0::bigint as response_revision, null::bigint as seq, null::varchar as cause, null::bigint as generation, 0::bigint as classified, null::varchar as lifecycle, null::varchar as last_error, false as raised from ev
  union all
  select source_id, i, response_revision + cast(raised as bigint), now_seq, kind, case when raised and kind = 'poll' then now_generation else generation end,
    case when raised and kind = 'poll' then 0 when raised and kind = 'delta' then now_revision else classified end, case when raised and kind = 'poll' then 'classifying' when raised and kind = 'lifecycle' then now_lifecycle else lifecycle end,
    case when raised and kind = 'poll' then null when kind = 'failure' then now_error else last_error end, raised
  from (
    select f.source_id, n.i, f.response_revision, f.generation, f.classified, f.lifecycle, f.last_error, n.seq as now_seq, n.kind, n.generation as now_generation, n.revision as now_revision, n.lifecycle as now_lifecycle, n.error as now_error,
      coalesce(case n.kind when 'failure' then true when 'poll' then f.generation is null or n.generation > f.generation when 'delta' then n.generation = f.generation and n.revision = f.classified + 1 and n.n_changed > 0
        else n.generation = f.generation and n.lifecycle is distinct from f.lifecycle end, false) as raised
    from f join n on n.source_id = f.source_id and n.i = f.i + 1))
select source_id, response_revision, seq, cause, generation, classified as classification_revision, lifecycle, case when generation is null then 'error' when last_error is not null then 'stale' else 'ready' end as availability, last_error from f where raised"""


# ---- retry waves -----------------------------------------------------------------------------------------------------

ASKS = "(values (1), (2)) a(ask)"
WAVE = {
    "candidates": "select concat('node-', cast(o_orderkey % 3 as string)) as source_id, concat('t', cast(o_orderkey as string)) as txid, concat('w', cast(o_orderkey as string)) as wtxid, case when o_orderkey % 4 = 1 then 1 else 0 end as priority from {orders}",
    # the first of 11 lookups of the second kind has no answer at all
    "raw": f"select concat('node-', cast(o_orderkey % 3 as string)) as source_id, concat('w', cast(o_orderkey as string)) as wtxid, a.ask, case when (o_orderkey * 3 + a.ask * 5) % 7 < 2 then 'retryable' when (o_orderkey * 3 + a.ask * 5) % 7 = 2 then 'null' else 'found' end as outcome from {{orders}} cross join {ASKS} where (o_orderkey + 5 * a.ask) % 11 <> 0",
    "needs": "select distinct concat('node-', cast(l_orderkey % 3 as string)) as source_id, concat('t', cast(l_orderkey as string)) as txid, concat('w', cast(l_orderkey as string)) as wtxid, concat('p', cast(l_partkey as string)) as prev_txid, cast(0 as bigint) as prev_vout from {lineitem}",
    "facts": f"select distinct concat('node-', cast(l_orderkey % 3 as string)) as source_id, concat('p', cast(l_partkey as string)) as prev_txid, cast(0 as bigint) as prev_vout, a.ask, case when (l_partkey * 5 + a.ask * 3 + l_orderkey % 3) % 29 < 3 then 'retryable' when (l_partkey * 5 + a.ask * 3 + l_orderkey % 3) % 29 < 5 then 'null' else 'found' end as outcome from {{lineitem}} cross join {ASKS}",
}


@query
def retry_waves(spark, sf_dir):
    """Lookups in waves, fresh variants first, until none has an attempt left."""
    got = slices.retry_waves(*(derived(spark, sf_dir, WAVE[name]) for name in ("candidates", "raw", "needs", "facts")))
    return got.select("source_id", "txid", *(F.col(c).cast("bigint").alias(c) for c in ("priority", "raw_asks", "wave", "fact_asks")), "raw", "status", "retryable")


def closed(name: str, keys: str) -> str:
    """What two lookups at most come to, without waves: outcome and attempts."""
    return f"select {keys}, coalesce(max(outcome) filter (ask = 1), 'retryable') as one, coalesce(max(outcome) filter (ask = 2), 'retryable') as two from {name} group by {keys}"


SQL["retry_waves"] = f"""with c as ({in_duck(WAVE["candidates"])}), ra as ({in_duck(WAVE["raw"])}), nd as ({in_duck(WAVE["needs"])}), fa as ({in_duck(WAVE["facts"])}),
r as ({closed("ra", "source_id, wtxid")}), x as ({closed("fa", "source_id, prev_txid")}),
v as (select c.*, coalesce(one, 'retryable') as one, coalesce(two, 'retryable') as two from c left join r using (source_id, wtxid)),
w as (select *, case when one <> 'retryable' then one when two <> 'retryable' then two else 'exhausted' end as raw, case when one <> 'retryable' then 1 else 2 end as raw_asks from v),
fresh as (select source_id, max(raw_asks) as waves from w where priority = 0 group by source_id),
fact as (select source_id, prev_txid, case when one <> 'retryable' then one when two <> 'retryable' then two else 'deferred' end as fact, case when one <> 'retryable' then 1 else 2 end as asks from x),
met as (select nd.source_id, nd.txid, bool_or(fact = 'deferred') as deferred, bool_or(fact = 'null') as missing, sum(asks) as asks from nd join fact using (source_id, prev_txid) group by all),
s as (select w.*, case when raw <> 'found' then 'unavailable' when coalesce(deferred, false) then 'deferred' else 'classified' end as status, coalesce(missing, false) as missing, case when raw = 'found' then coalesce(asks, 0) else 0 end as fact_asks,
  raw_asks + case when priority = 1 then coalesce(waves, 0) else 0 end as wave from w left join fresh using (source_id) left join met using (source_id, txid))
select source_id, txid, cast(priority as bigint) as priority, cast(raw_asks as bigint) as raw_asks, cast(wave as bigint) as wave, cast(fact_asks as bigint) as fact_asks, raw, status, status = 'classified' and missing as retryable from s"""


# ---- slices ----------------------------------------------------------------------------------------------------------

#: Orders ask in batches of 64; some batches stay silent, some answer twice or what nobody asked.
SLICE = {
    "requests": "select concat('node-', cast((o_orderkey div 64) % 4 as string)) as source_id, o_orderkey div 64 as batch_id, o_orderkey as id from {orders}",
    "responses": "select o_orderkey div 64 as batch_id, case when o_orderkey % 64 = 9 and (o_orderkey div 64) % 5 = 2 then o_orderkey - 1 when o_orderkey % 64 = 11 and (o_orderkey div 64) % 17 = 3 then o_orderkey + 1000000000 else o_orderkey end as id,"
    " case when o_orderkey % 640 = 77 then 'systemic' when o_orderkey % 19 = 4 then 'retryable' else 'found' end as answer from {orders} where (o_orderkey div 64) % 7 <> 4 and o_orderkey % 23 <> 1",
}
SLICE_SOURCES = ("node-0", "node-1", "node-2", "node-3", "node-4")


@query
def slice_counters(spark, sf_dir):
    """Counters that the slice's write observes, and its disposition; node-4 asks for nothing."""
    return slices.run_slice(derived(spark, sf_dir, SLICE["requests"]), derived(spark, sf_dir, SLICE["responses"]).withColumnRenamed("answer", "fetch"), SLICE_SOURCES)[1]


SQL["slice_counters"] = f"""with q as ({in_duck(SLICE["requests"])}), p as ({in_duck(SLICE["responses"])}),
bad as (select batch_id from p group by batch_id, id having count(*) > 1 union select batch_id from p where id not in (select id from q)),
m as (select q.*, case when q.batch_id in (select batch_id from bad) then 'failed' else coalesce(p.answer, 'missing') end as answer from q left join (select batch_id, id, min(answer) as answer from p group by all) p using (batch_id, id)),
b as (select source_id, batch_id, count(*) > 1 and bool_and(answer = 'missing') as silent, bool_or(answer = 'failed') as failed from m group by all),
s as (select source_id, count(*) as attempted, count(*) filter (answer = 'found') as found, count(*) filter (answer in ('retryable', 'systemic', 'missing')) as response_failures, count(*) filter (answer = 'systemic') as systemic_response_failures, count(*) filter (answer = 'missing') as missing_responses from m group by all),
t as (select source_id, count(*) filter (silent) as all_missing_batches, count(*) filter (failed) as batch_failures from b group by all),
z as (select n.source_id, coalesce(attempted, 0) as attempted, coalesce(found, 0) as found, coalesce(response_failures, 0) as response_failures, coalesce(systemic_response_failures, 0) as systemic_response_failures, coalesce(missing_responses, 0) as missing_responses, coalesce(all_missing_batches, 0) as all_missing_batches, coalesce(batch_failures, 0) as batch_failures
  from (values {", ".join(f"('{s}')" for s in SLICE_SOURCES)}) n(source_id) left join s using (source_id) left join t using (source_id))
select *, case when batch_failures + systemic_response_failures + all_missing_batches > 0 then 'paused' when found = attempted then 'complete' else 'continue' end as disposition from z"""


# ---- deployment windows ----------------------------------------------------------------------------------------------

#: Activation heights: one branch's window has opened, another's has closed and opened again, the third has none.
DEPLOYED = (("b0", 905_000), ("b1", 880_000), ("b1", 945_000), ("b2", None))


@query
def consensus_window(spark, sf_dir):
    """H5, H4: consensus before, in and after the windows of three branches, coinbase transactions among them."""
    transactions, outputs, inputs, _ = frames(spark, sf_dir, matches=True)
    keys, by = lenses.keys_of(transactions), lenses.told_by(transactions)
    placed = transactions.select(*keys, "version", F.expr("owner % 31 = 0").alias("is_coinbase"), F.expr("concat('b', cast(owner % 3 as string))").alias("branch"), F.expr("cast(900000 + (owner * 97) % 60000 as int)").alias("spend_height"))
    height = F.when(~F.substring("prev_txid", 4, 1).isin("0", "1", "2"), 879000 + 17 * F.conv(F.substring("prev_txid", 1, 3), 16, 10).cast("int"))
    got = deployments.consensus_details(placed, outputs, inputs.withColumn("creation_height", height), spark.createDataFrame(DEPLOYED, "branch string, activation_height int"))
    named = got.join(placed.select(*by, "branch", "is_coinbase"), by)
    return named.groupBy("source_id", "branch", "is_coinbase", "rules_applied", "rule", "verdict").agg(F.count("*").alias("n"), F.sum("evidence_count").alias("evidence"))


def consensus_sql(rows: str) -> str:
    """rows: the tables of candidates, their hits and verdicts."""
    return rows + """, place as (select source_id, k, concat('b', cast(k % 3 as varchar)) as branch, k % 31 = 0 as is_coinbase, 900000 + (k * 97) % 60000 as spend from cand),
win as (select p.*, case branch when 'b0' then case when spend >= 905000 and spend < 905000 + 52416 then 905000 end when 'b1' then case when spend >= 945000 then 945000 when spend < 880000 + 52416 then 880000 end end as active from place p),
hgt as (select h.source_id, h.k, h.number, w.active, case when h.number = 1 then 9000000 when substr(prev_txid, 4, 1) not in ('0', '1', '2') then 879000 + 17 * cast('0x' || substr(prev_txid, 1, 3) as int) end as height
  from hit h join win w on w.source_id = h.source_id and w.k = h.k where w.active is not null and (h.number = 1 or not w.is_coinbase)),
ev as (select source_id, k, number, count(*) filter (height >= active) as e, count(*) filter (height is null) as m from hgt group by all)
select v.source_id, w.branch, w.is_coinbase, w.active is not null as rules_applied, v.rule,
  case when coalesce(ev.e, 0) > 0 then 'violate' when w.active is not null and case when w.is_coinbase then 0 else v.m end + coalesce(ev.m, 0) > 0 then 'unknown' else 'pass' end as verdict, count(*) as n, cast(sum(coalesce(ev.e, 0)) as bigint) as evidence
from verdicts v join win w on w.source_id = v.source_id and w.k = v.k left join ev on ev.source_id = v.source_id and ev.k = v.k and ev.number = v.number group by all"""
