"""DuckDB SQL for the contract's queries."""

from __future__ import annotations

from ..testdata import NOW, base_ctes
from . import oracles as O

WITH_ENTRY, WITH_CLASSIFIED = base_ctes("entry"), base_ctes("entry", "classified")
KNOWN = "from classified where properties_state is not null"
#: What a row's reasons are, from (name, whether it holds) pairs in order.
REASONS = lambda *checks: "concat_ws(',', " + ", ".join(f"case when not coalesce({ok}, false) then '{name}' end" for name, ok in checks) + ")"
FIRST_RULE = "case when violated_mask = 0 then -1 else cast(log2(violated_mask & -violated_mask) as int) end"


def cut(mask: str) -> str:
    """A mask without its last rule where that row is left out."""
    return f"(case when k % 47 = 0 then {mask} & 63 else {mask} end)"


def of_panel(sql: str, panel: str, weight: str = "weight") -> str:
    return f"select source_id, count(*) as cells, cast(sum({weight}) as bigint) as weight, '{panel}' as panel from ({sql}) group by source_id"


def of_scope(sql: str) -> str:
    """A panel's SQL over what two sources have in common, the first one's rows, weighed by vsize, with four groups and the rest."""
    entry = WITH_ENTRY.rstrip()
    scope = entry.replace("with entry as", "with whole as", 1) + ", entry as (select * from whole where source_id = 'node-a' and txid in (select txid from whole where source_id = 'node-b'))"
    weighed = sql.replace("count(*) as weight", "cast(sum(vsize) as bigint) as weight").replace("count(*) as n from", "sum(vsize) as n from").replace("1 as w from", "vsize as w from")
    for column in ('as "row"', "as band"):
        weighed = weighed.replace(f"{column} from classified", f"{column}, vsize from classified").replace(f"{column} from entry", f"{column}, vsize from entry")
    return weighed.replace("least(count(*), 7)", "least(count(*), 5)").replace("end from entry), g", "end, vsize from entry), g").replace(entry, scope)


def queries(sql: dict[str, str]) -> dict[str, str]:
    utxo = "with u as (select o_orderkey as k, o_orderkey // 40 as batch_id, o_orderkey // 40 % 9 = 0 as out from orders), r as (select *, case when out or k % 6 = 2 then 'omitted' when k % 6 = 1 then 'null' when k % 6 in (3, 4) then 'error' else 'value' end as outcome, case when out or k % 6 = 2 then 'retryable' when k % 6 = 0 then 'found' when k % 6 = 1 then 'null' when k % 6 = 3 then 'systemic' else 'retryable' end as \"fetch\" from u) "
    reduced = sql["policy_assessments"]
    verdict = reduced[: reduced.rfind("select a.source_id, case when v")] + "select a.source_id, e.txid, case when v then 'violating' when u then 'indeterminate' else 'compatible' end as status, case when u then 'partial' else 'complete' end as knots_bip110 from a join entry e on e.source_id = a.source_id and e.k = a.k"
    status = "case when violated_mask > 0 then 'violating' when unknown_mask > 0 then 'indeterminate' else 'compatible' end"
    seen = f"(case when {cut('violated_mask')} > 0 then 'violating' when {cut('unknown_mask')} > 0 then 'indeterminate' else 'compatible' end)"
    structure_ok = "(case when k % 13 = 0 then 0 else input_count end) >= 1 and output_count >= 1 and (case when k % 17 = 0 then -1 else op_return_bytes end) between 0 and 9007199254740991 and (case when k % 19 = 0 then 9007199254740992 else output_sats end) between 0 and 9007199254740991"
    assessed = f"select *, case when k % 7 = 0 then 'compatible' else status end as said, case when k % 11 = 0 then 0 else {FIRST_RULE} end as first_rule {KNOWN}"
    assessed_ok = "case said when 'compatible' then violated_mask = 0 and unknown_mask = 0 and first_rule < 0 when 'violating' then violated_mask > 0 and (first_rule < 0 or (violated_mask >> greatest(first_rule, 0)) & 1 = 1) when 'indeterminate' then violated_mask = 0 and unknown_mask > 0 and first_rule < 0 else false end"
    places = f"select c.source_id, c.k, string_agg(cast(ord as varchar), '.' order by ord) as places, string_agg(label, ' + ' order by ord) as names from fam c join {O.LABEL} l on l.label = c.family group by all"
    ancestor = sql["ancestor_fee_spectrum"].replace("vsize as w from", "1 as w from")
    bars = O.WITH_CLASSIFIED + O.BUCKETS.replace("{", "{{").replace("}", "}}") + ", g as (select source_id, bucket, count(*) as n from bucketed group by all) select source_id, {cells} as cells, cast(sum(n) as bigint) as weight, '{panel}' as panel from g group by source_id"
    panels = [
        bars.format(cells="least(count(*), 8)", panel="composition"), bars.format(cells="least(count(*), 7)", panel="panel_groups"), of_panel(ancestor, "ancestor_fee_spectrum"),
        *(of_panel(sql[n], n) for n in ("entanglement", "fee_spectrum", "joint_density", "age_mosaic", "data_spectrum", "complexity_density", "value_spectrum")),
    ]
    named = "'node-' || "
    return {
        "utxo_answers": utxo + "select outcome, \"fetch\", count(*) as n, count(*) filter (\"fetch\" = 'found') as scripts from r group by all",
        "batch_pauses": utxo + "select batch_id, bool_or(\"fetch\" = 'systemic') or count(*) > 1 and bool_and(outcome = 'omitted') as paused from r group by all",
        "entries_read_back": WITH_ENTRY + "select source_id, substr(txid, 1, 1) as prefix, count(*) as n, cast(sum(vsize) as bigint) as vsize, min(wtxid) as first_wtxid from entry group by all",
        "details_read_back": O.WITH_CLASSIFIED + O.BUCKETS + f", l as (select source_id, k, count(*) as labels from fam group by all) select c.source_id, status, count(*) as n, cast(sum(output_sats) as bigint) as output_sats, cast(sum(coalesce(labels, 0)) as bigint) as labels {KNOWN.replace('classified', 'classified c left join l on l.source_id = c.source_id and l.k = c.k')} group by all",
        "snapshots_read_back": WITH_CLASSIFIED + "select source_id, k // 1000 as generation, case when k // 1000 % 3 = 1 then 'total_vsize' else '' end as reasons, count(*) as n, count(properties_state) as structured from classified group by all",
        "published_status": f"select {named} c_custkey as source_id, case when c_custkey % 4 > 0 then {NOW} + c_custkey end as snapshot_observed_at_ms, case when c_custkey % 3 = 0 then 'down' end as last_error, case when c_custkey % 4 > 0 then case when c_custkey % 3 = 0 then 'stale' else 'ready' end when c_custkey % 3 = 0 then 'error' else 'waiting' end as availability, case c_custkey % 5 when 0 then 'paused' when 1 then 'complete' else 'classifying' end as lifecycle, case when c_custkey % 4 > 0 and c_custkey % 3 = 0 then 'stale' when c_custkey % 5 = 0 then 'paused' else 'none' end as caveat, case when c_custkey % 5 > 1 then 'pending' else 'unavailable' end as unclassified_kind, c_custkey as classified from customer",
        "order_violations": WITH_ENTRY + "select source_id, txid, k as position from (select *, lag(txid) over (partition by source_id order by k) as before from entry where k % 3 = 0) where before >= txid",
        "header_checks": "with c as (select c_custkey as k from customer) select k, " + REASONS(("completed_after_started", "1001 - k % 3 >= 1000 + k % 2"), ("duration", "k % 13 > 0"), ("observed_is_completed", "k % 17 > 0"), ("source_id", "k % 7 > 2"), ("source_label", "k % 11 > 1")) + " as reasons from c",
        "structure_checks": WITH_CLASSIFIED + f"select source_id, txid {KNOWN} and not ({structure_ok})",
        "result_checks": WITH_CLASSIFIED + "select * from (select source_id, txid, " + REASONS(("declared_classifier", "k % 29 > 0"), ("catalog_order", "k % 29 > 0 and k % 23 > 0"), ("complete_has_labels", "properties_state <> 'complete' or k % 43 > 0 or k % 41 = 0"), ("partial_has_missing", "properties_state <> 'partial' or k % 37 > 0"), ("primary_is_label", "k % 31 > 0"), ("labels_declared", "k % 29 > 0 and k % 41 > 0")) + f" as reasons {KNOWN}) where reasons <> ''",
        "rule_detail_checks": WITH_CLASSIFIED + "select * from (select source_id, txid, " + REASONS(("seven_rules", "k % 47 > 0"), ("verdict_has_evidence", "k % 53 > 0 or violated_mask & 1 = 1"), ("status", f"(case when k % 59 = 0 then 'compatible' else {status} end) = {seen}"), ("violated_rules", f"violated_mask = {cut('violated_mask')}"), ("unknown_rules", f"unknown_mask = {cut('unknown_mask')}"), ("primary_is_violated", f"violated_mask = 0 or {cut('violated_mask')} > 0")) + f" as reasons {KNOWN}) where reasons <> ''",
        "assessment_checks": WITH_CLASSIFIED + f", a as ({assessed}) select source_id, txid from a where not coalesce({assessed_ok}, false)",
        "coupling_checks": WITH_CLASSIFIED + f", c as (select * {KNOWN}), w as (select source_id, txid, 'coupling' as what from c where k % 61 = 0 or k % 67 = 0 union all select source_id, txid, 'only_compact' from c where k % 71 = 0 or k % 73 = 0 union all select source_id, txid, 'only_detail' from c where k % 71 > 0 and k % 73 = 0 union all select source_id, txid, 'differs' from c where k % 71 > 0 and k % 73 > 0 and k % 79 = 0) select source_id, what, count(*) as n, min(txid) as first_txid from w group by all",
        "summary_checks": WITH_CLASSIFIED + ", g as (select source_id, coalesce(status, 'unclassified') as status, count(*) as n from classified group by all) select source_id, status, case when source_id = 'node-c' then n + 1 end as published_n, n as recomputed_n from g where source_id = 'node-b' and status = 'compatible' or source_id = 'node-c' and status = 'violating'",
        "status_contract": "with c as (select c_custkey as k, c_custkey % 3 > 0 as has, c_custkey % 4 as a from customer) select k, " + REASONS(("snapshot", "case when a in (0, 3) then not has else has end"), ("error_text", "case when a in (2, 3) then k % 5 > 2 else k % 5 <= 2 end"), ("progress", "not has or k % 19 > 0")) + " as reasons from c",
        "catalog_checks": O.WITH_CLASSIFIED + O.BUCKETS + ", u as (select distinct family from fam) select 'lens_x' as classifier_id, 'key_syntax' as reason from u having count(*) > 0 union all select 'lens_y', 'id_repeats' from u having count(distinct length(family) % 2) > 1 union all select 'lens_y', 'label_repeats' from u having count(*) > count(distinct substr(family, 1, 3))",
        "detail_match": WITH_CLASSIFIED + f"select source_id, k % 97 > 0 and k % 83 > 0 and (k % 3 = 1 or k % 3 = 2 and k % 4 > 0) as matches, count(*) as n, min(txid) as first_txid {KNOWN} and k % 89 > 0 group by all",
        "exact_txid": WITH_ENTRY + "select source_id, txid, vsize from entry where txid = (select min(txid) from entry)",
        "bucket_names": O.WITH_CLASSIFIED + O.BUCKETS + f", pl as ({places}), b as (select c.source_id, case when properties_state is null then 'unavailable' else properties_state || ':' || coalesce(places, 'none') end as bucket, case when properties_state is null then 'Unavailable' else coalesce(names, 'No labels') end as name from classified c left join pl on pl.source_id = c.source_id and pl.k = c.k) select source_id, bucket, count(*) as n, name from b group by all",
        "shown_side": O.SIDES + ", s as (select unnest(['left', 'right']) as chosen) select chosen, region, side, count(*) as n, cast(sum(vsize) as bigint) as vsize from keyed, s where region = 'common' and side = chosen or region = side || '_only' group by all",
        "region_place": O.SIDES + ", w as (select max(txid) as wanted from entry) select txid, region, (select count(distinct b.txid) from keyed b where b.region = a.region and b.txid < a.txid) as place, max(vsize) filter (side = 'left') as left_vsize, max(vsize) filter (side = 'right') as right_vsize from keyed a, w where txid = wanted group by txid, region",
        "population_of_a_filter": O.SIDES + ", s as (select * from (values ('common', 'left'), ('common', 'right'), ('left_only', 'left'), ('right_only', 'right')) s(region, side), (values ('all'), ('status:violating'), ('rule:op_success')) f(filter)) select s.region, s.side, filter, count(k.txid) as n, cast(coalesce(sum(k.vsize), 0) as bigint) as vsize from s left join keyed k on k.region = s.region and k.side = s.side and (filter = 'all' or filter = 'status:violating' and status = 'violating' or filter = 'rule:op_success' and properties_state is not null and (violated_mask >> 5) & 1 = 1) group by all",
        "status_shares": WITH_CLASSIFIED + ", w as (select source_id, count(*) as whole from classified group by all) select c.source_id, count(*) as n, cast(sum(vsize) as bigint) as vsize, count(*) / any_value(whole) as share, status from classified c join w on w.source_id = c.source_id where status in ('compatible', 'violating', 'indeterminate') group by c.source_id, status",
        "incomplete_violations": WITH_CLASSIFIED + f"select source_id, count(*) as n, cast(sum(vsize) as bigint) as vsize {KNOWN} and status = 'violating' and unknown_mask > 0 group by all",
        "nine_panels": " union all ".join(f"select * from ({panel})" for panel in panels),
        "nine_panels_of_a_scope": " union all ".join(f"select 'left' as source_id, cells, weight, panel from ({of_scope(panel)})" for panel in panels),
        "scopes": O.SIDES + ", s as (select * from (values ('all'), ('common'), ('left_only'), ('right_only')) n(scope), (values ('left'), ('right')) d(side)) select scope, s.side, count(k.txid) as n from s left join keyed k on k.side = s.side and (scope = 'all' or scope = region) group by all",
        "results_by_lens": f"select p.source_id, p.state as transaction_properties, s.state as transaction_shape, 'complete' as data_protocols, v.knots_bip110, v.status, true as none, count(*) as n, cast(sum(output_count) as bigint) as outputs from ({sql['properties_labels']}) p join ({sql['shape_labels']}) s on s.source_id = p.source_id and s.txid = p.txid join ({verdict}) v on v.source_id = p.source_id and v.txid = p.txid join ({sql['structure_facts']}) f on f.source_id = p.source_id and f.txid = p.txid group by all",
        "revision_fold": "with d as (select 'node-' || (event_id % 4) as source_id, event_id // 4 as revision, case when event_id % 1009 = 1000 then 0 else event_id % 7 + 1 end as n_changed from events), z as (select source_id, min(revision) filter (n_changed = 0 and revision > 0) as stop, max(revision) as last from d group by all) select source_id, 3 as generation, coalesce(stop - 1, last) as revision, coalesce(stop - 1, last) as applied, count(*) filter (revision = 0 or revision = stop) as ignored, case when last > stop then 'gap: ' || last || ' after ' || (stop - 1) end as error, cast(sum(n_changed) filter (revision between 1 and coalesce(stop - 1, last)) as bigint) as changed from d join z using (source_id) group by source_id, stop, last",
        "lifecycles": "with s as (select s_suppkey as k from supplier) select 'node-' || k as source_id, case when k % 7 = 0 and k % 2 = k % 3 then 'paused' when k % 4 = 0 then 'complete' else 'classifying' end as lifecycle, k % 50 as response_revision, (select bool_or(k % 5 > 0) from s) as ready from s where k % 50 > 2",
        "retries": base_ctes("inputs") + "select case utxo_outcome when 'null' then 'explicitly_missing' else 'pending' end as fact_state, k % 4 + 1 as attempts, count(*) as n from inputs where utxo_outcome <> 'found' and k % 4 < 2 group by all",
    }
