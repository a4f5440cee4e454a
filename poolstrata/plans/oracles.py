"""DuckDB SQL for the queries, written apart from the DataFrame code: only the derived base tables' text is shared."""

from __future__ import annotations

from ..catalog import PROPERTY_LABELS, RULES
from ..testdata import NOW, RESIDUE_FAMILIES, base_ctes

HOUR = 3_600_000
WITH_ENTRY, WITH_CLASSIFIED = base_ctes("entry"), base_ctes("entry", "classified")
BITS = "(select * from (values " + ", ".join(f"({k}, '{r}')" for k, r in enumerate(RULES)) + ") r(bit, rule))"
FAMILY = "(select * from (values " + ", ".join(f"({k}, '{f}')" for k, f in enumerate(RESIDUE_FAMILIES)) + ") f(residue, family))"
LABEL = "(select * from (values " + ", ".join(f"({k}, '{f}')" for k, f in enumerate(PROPERTY_LABELS)) + ") l(ord, label))"
RATE = "(case when vsize > 0 then fee_sats / vsize else 0.0 end)"
ANCESTOR_RATE = "(case when ancestor_vsize > 0 then ancestor_fee_sats / ancestor_vsize else 0.0 end)"
AGE = f"greatest(0, {NOW} - entered_at_ms)"
SIGNATURE = "(case when status = 'violating' then case when unknown_mask = 0 then printf('exact:%02x', violated_mask) else printf('partial:%02x:%02x', violated_mask, unknown_mask) end end)"
GROUP_OF = "case family when 'p2pk' then 'legacy' when 'bare_multisig' then 'legacy' when 'p2pkh' then 'legacy' when 'p2sh' then 'legacy' when 'p2wpkh' then 'segwit_v0' when 'p2wsh' then 'segwit_v0' when 'p2tr' then 'taproot' when 'op_return' then null else 'other' end"
GRAY = lambda m: "xor(" * 6 + m + ", " + "), ".join(f"{m} >> {k}" for k in range(1, 6)) + f"), {m} >> 6)"
#: Families of each classified entry and its bucket in the properties lens.
BUCKETS = f""", fam as (select distinct source_id, k, family from classified c join {FAMILY} f on f.residue in (c.family_a, c.family_b) where properties_state is not null),
prof as (select source_id, k, count(distinct {GROUP_OF}) as groups, min({GROUP_OF}) as one from fam group by all),
bucketed as (select c.*, case when properties_state is null then 'unavailable' else properties_state || ':profile_' || case when groups > 1 then 'mixed' else coalesce(one, 'other') end end as bucket from classified c left join prof p on p.source_id = c.source_id and p.k = c.k) """
ORDER = "case split_part(bucket, ':', 1) when 'complete' then 0 when 'partial' then 1 else 2 end, case split_part(bucket, ':', 2) when 'profile_legacy' then 1 when 'profile_segwit_v0' then 2 when 'profile_taproot' then 3 when 'profile_other' then 4 when 'profile_mixed' then 5 else 0 end"
#: Resolved inputs of every source.
RESOLVED = base_ctes("entry", "outputs", "inputs") + """, src as (select source_id, txid, wtxid, k from entry),
asked as (select s.source_id, s.txid, s.wtxid, i.k, i.vin, i.prev_txid, i.prev_vout, i.sequence, i.witness_items, i.from_mempool, i.utxo_outcome, i.utxo_script_hex from inputs i join src s on s.k = i.k),
raw as (select distinct txid from outputs),
resolved as (select a.*, p.txid is not null as is_parent,
 case when p.txid is not null and o.script_hex is not null then 'ready' when not a.from_mempool and a.utxo_outcome = 'found' and p.txid is null then 'ready'
      when p.txid is null and not a.from_mempool and a.utxo_outcome = 'null' then 'explicitly_missing' else 'pending' end as fact_state,
 case when p.txid is not null and o.script_hex is not null then o.script_hex when not a.from_mempool and a.utxo_outcome = 'found' and p.txid is null then a.utxo_script_hex end as script_hex
 from asked a left join src p on p.source_id = a.source_id and p.txid = a.prev_txid left join outputs o on o.txid = a.prev_txid and o.vout = a.prev_vout) """
FAMILY_HEX = lambda s: (
    f"case when regexp_full_match({s}, '21[0-9a-f]{{66}}ac|41[0-9a-f]{{130}}ac') then 'p2pk' when regexp_full_match({s}, '5[1-9a-f](21[0-9a-f]{{66}})+5[1-9a-f]ae') then 'bare_multisig' when regexp_full_match({s}, '76a914[0-9a-f]{{40}}88ac') then 'p2pkh' "
    f"when regexp_full_match({s}, 'a914[0-9a-f]{{40}}87') then 'p2sh' when regexp_full_match({s}, '0014[0-9a-f]{{40}}') then 'p2wpkh' when regexp_full_match({s}, '0020[0-9a-f]{{64}}') then 'p2wsh' when regexp_full_match({s}, '5120[0-9a-f]{{64}}') then 'p2tr' "
    f"when {s} = '51024e73' then 'p2a' when regexp_full_match({s}, '(00|5[1-9a-f]|60)(02[0-9a-f]{{4}}|04[0-9a-f]{{8}}|14[0-9a-f]{{40}}|20[0-9a-f]{{64}})') then 'unknown_witness_program' when {s} like '6a%' then 'op_return' else 'unknown_script' end"
)
CANDIDATES = "cand as (select s.source_id, s.txid, s.wtxid, s.k from src s where s.k in (select k from outputs)), outs as (select c.source_id, c.txid, c.k, o.vout, o.value_sats, o.script_hex from cand c join outputs o on o.k = c.k), ins as (select r.* from resolved r join cand c on c.source_id = r.source_id and c.k = r.k) "


def bin_of(value: str, low: int, high: int, bins: int) -> str:
    place = f"(ln(cast({value} as double)) - ln({low}.0)) / (ln({high}.0) - ln({low}.0))"
    return f"cast(case when {value} > 0 then least({bins - 1}, floor(round(least(1.0, greatest(0.0, {place})) * {bins}, 12))) else 0 end as bigint)"


def spectrum(rows: str, value: str, low: int, high: int, weight: str = "1") -> str:
    return (
        WITH_CLASSIFIED + BUCKETS + f", each as (select source_id, bucket, {bin_of(value, low, high, 22)} as bin, {weight} as w from bucketed where {rows}), part as (select source_id, bin, bucket, cast(sum(w) as bigint) as weight from each group by all), "
        "per as (select *, cast(sum(weight) over (partition by source_id, bin) as bigint) as bin_weight from part) select source_id, bin, bucket, weight, bin_weight, max(bin_weight) over (partition by source_id) as max_bin, cast(sum(weight) over (partition by source_id) as bigint) as total from per"
    )


def density(rows: str, x: str, xd: tuple[int, int], y: str, yd: tuple[int, int]) -> str:
    return WITH_CLASSIFIED + f", each as (select source_id, {bin_of(x, *xd, 22)} as col, {bin_of(y, *yd, 14)} as \"row\" from classified where {rows}) select source_id, col, \"row\", count(*) as weight from each group by grouping sets ((source_id, col, \"row\"), (source_id, col), (source_id, \"row\"), (source_id))"


def band(value: str, bands: list[tuple[int, str]], last: str, op: str = "<") -> str:
    return "case " + " ".join(f"when {value} {op} {bound} then '{name}'" for bound, name in bands) + f" else '{last}' end"


RELATIVE = lambda n: band(f"greatest(0, {n} - 1)", [(1, "alone"), (2, "one"), (5, "few"), (10, "several")], "many")
AGE_BAND = band(AGE, [(HOUR // 6, "under_10m"), (HOUR, "under_1h"), (6 * HOUR, "under_6h"), (24 * HOUR, "under_24h")], "older")
FEE_LANE = band(RATE, [(128, "128+"), (64, "64-128"), (32, "32-64"), (16, "16-32"), (8, "8-16"), (4, "4-8"), (2, "2-4"), (1, "1-2")], "<1", ">=")
AGE_COLUMN = band(AGE, [(72 * HOUR, "3d+"), (24 * HOUR, "1-3d"), (6 * HOUR, "6-24h"), (HOUR, "1-6h"), (HOUR // 6, "10-60m")], "<10m", ">=")
VIOLATED = "(properties_state is not null and violated_mask & (1 << bit) <> 0)"
SIDES = WITH_CLASSIFIED + """, lft as (select * from classified where source_id = 'node-a'), rgt as (select * from classified where source_id = 'node-b'),
long as (select lft.*, 'left' as side, case when rgt.txid is null then 'left_only' else 'common' end as region from lft left join rgt on lft.txid = rgt.txid
 union all select rgt.*, 'right', case when lft.txid is null then 'right_only' else 'common' end from rgt left join lft on lft.txid = rgt.txid), keyed as (select *, case when region = 'common' then 'common_' || side else region end as row_key from long) """
RESULTS = ", results as (select source_id, txid, case when k % 17 = 0 then sha256('old:' || wtxid) else wtxid end as wtxid, k % 8 as label, k % 10 = 1 as retryable, k % 4 as attempts from entry where k % 3 > 0) "
GROUPS = BUCKETS + f", groups as (select source_id, bucket, count(*) as n, cast(sum(vsize) as bigint) as vsize, row_number() over (partition by source_id order by {ORDER}) as place from bucketed group by source_id, bucket) "
POLLS = "with p as (select 'node-' || (user_id % 4) as source_id, event_id // 7 as generation, event_type <> 'error' as ok, 1704067200000 + event_id * 1000 as observed_at_ms, event_id % 5000 as n_entries, case when event_type = 'error' then 'failure ' || (event_id // 7) end as error from events) "
#: A failure has no generation; a good poll counts if no good one of its or a later generation came before it.
STATUS = POLLS + """, good as (select *, max(generation) over (partition by source_id order by observed_at_ms rows between unbounded preceding and 1 preceding) as before from p where ok),
h as (select source_id, max(generation) as generation, max(observed_at_ms) filter (before is null or generation > before) as at, count(*) as n_good, count(*) filter (before is null or generation > before) as n_accepted from good group by source_id),
e as (select source_id, count(*) filter (not ok) as n_bad, max(observed_at_ms) filter (not ok) as at, arg_max(error, observed_at_ms) filter (not ok) as error from p group by source_id)
select e.source_id, coalesce(generation, -1) as generation, case when h.at is null or e.at > h.at then error end as last_error,
 case when h.at is null then case when error is null then 'waiting' else 'error' end when e.at > h.at then 'stale' else 'ready' end as availability, coalesce(n_good - n_accepted, 0) as dropped, coalesce(n_accepted, 0) + n_bad as response_revision
from e left join h using (source_id)"""

#: Rule matches that the derived transactions can have, and all verdicts.
RULE_ROWS = f""", hit as (select source_id, k, 0 as vin, null as prev_txid, 1 as number, 'output_size' as rule from outs where length(script_hex) / 2 > case when script_hex like '6a%' then 83 else 34 end
 union all select source_id, k, vin, prev_txid, 3, 'undefined_version' from ins where script_hex = '5204deadbeef' or script_hex = '51024e73' and witness_items > 0
 union all select source_id, k, vin, prev_txid, 4, 'taproot_annex' from ins where script_hex like '5120%' and length(script_hex) = 68 and witness_items >= 2 and k % 11 = 4),
he as (select source_id, k, number, count(*) as e from hit group by all), blind as (select source_id, k, count(*) as m from ins where script_hex is null group by all),
verdicts as (select c.source_id, c.k, cast(r.bit + 1 as bigint) as number, r.rule, coalesce(he.e, 0) as e, case when r.bit > 0 then coalesce(blind.m, 0) else 0 end as m from cand c cross join {BITS} r left join he on he.source_id = c.source_id and he.k = c.k and he.number = r.bit + 1 left join blind on blind.source_id = c.source_id and blind.k = c.k) """

SQL: dict[str, str] = {
    "entry_validity": WITH_ENTRY + """, spoilt as (select * replace (case when k % 211 = 0 then 5 * vsize else weight end as weight, case when k % 223 = 0 then vsize - 1 else ancestor_vsize end as ancestor_vsize, case when k % 227 = 0 then -1 else fee_sats end as fee_sats) from entry),
    named as (select source_id, txid, concat_ws(',', case when fee_sats < 0 then 'safe_integers' end, case when weight > 4 * vsize then 'weight_range' end, case when ancestor_vsize < vsize then 'relatives_include_self' end) as reasons from spoilt) select * from named where reasons <> ''""",
    "duplicate_ids": WITH_ENTRY + ", twice as (select * from entry union all select * from entry where k % 401 = 0), ids as (select source_id, 'txid' as kind, txid as id from twice union all select source_id, 'wtxid', wtxid from twice) select source_id, kind, id, count(*) as n from ids group by all having count(*) > 1",
    "snapshot_totals": WITH_ENTRY + "select source_id, count(*) as n, cast(sum(vsize) as bigint) as vsize from entry group by source_id",
    "filter_entries": WITH_ENTRY + f"select source_id, txid from entry where {RATE} >= 8 and vsize >= 150 and {AGE} <= {24 * HOUR}",
    "txid_prefix_page": WITH_ENTRY + ", m as (select txid, vsize, row_number() over (order by txid) - 1 as i, count(*) over () as total from entry where source_id = 'node-a' and txid like '0%'), p as (select *, least(1, greatest(0, (total + 99) // 100 - 1)) as page from m) select txid, vsize, cast(page as bigint) as page, cast(least(total, page * 100 + 1) as bigint) as first_match, cast(least(total, (page + 1) * 100) as bigint) as last_match from p where i // 100 = page",
    "snapshot_limits": WITH_ENTRY + "select source_id, count(*) as n_entries, source_id <> 'node-b' and count(*) <= 200000 as accepted from entry group by source_id",
    "policy_filters": WITH_CLASSIFIED + f", t as (select source_id, 'status:violating' as filter from classified where status = 'violating' union all select source_id, 'rule:element_size' from classified where properties_state is not null and violated_mask & 2 <> 0 union all select source_id, 'signature:exact:42' from classified where {SIGNATURE} = 'exact:42' union all select c.source_id, 'label:p2tr' from classified c where properties_state is not null and (family_a in (5, 10) or family_b in (5, 10))) select source_id, filter, count(*) as n from t group by all",
    "fee_rates": WITH_ENTRY + f"select source_id, txid, {RATE} as fee_rate, {ANCESTOR_RATE} as ancestor_fee_rate from entry",
    "bands": WITH_ENTRY + f"select source_id, {RELATIVE('ancestor_count')} as relatives, {AGE_BAND} as age_band, {FEE_LANE} as fee_lane, {AGE_COLUMN} as age_column, count(*) as n from entry group by all",
    "script_families": base_ctes("outputs") + f"select {FAMILY_HEX('script_hex')} as family, count(*) as n, cast(sum(value_sats) as bigint) as value_sats from outputs group by all",
    "rule_masks": WITH_CLASSIFIED + f"select source_id, coalesce({SIGNATURE}, status, 'unclassified') as region, count(*) as n, max(case when violated_mask > 0 then floor(log2(violated_mask)) + 1 end)::bigint as foundation from classified group by all",
    "signature_order": WITH_CLASSIFIED + f", s as (select distinct source_id, {SIGNATURE} as signature, violated_mask as v, unknown_mask as u from classified where status = 'violating') select source_id, signature, row_number() over (partition by source_id order by u > 0, {GRAY('v')}, {GRAY('u')}, signature) as place from s",
    "structure_facts": RESOLVED + ", " + CANDIDATES + ", o as (select source_id, k, count(*) as output_count, cast(sum(case when script_hex = '6a5d0401020304' then 6 when script_hex like '6a08%' then 8 when script_hex like '6a4c50%' then 80 when script_hex like '6a4c51%' then 81 else 0 end) as bigint) as op_return_bytes, cast(sum(value_sats) as bigint) as output_sats from outs group by all), i as (select source_id, k, any_value(txid) as txid, count(*) as input_count, cast(sum(2 * witness_items) as bigint) as witness_bytes from ins group by all) select source_id, txid, input_count, output_count, op_return_bytes, output_sats, witness_bytes from o join i using (source_id, k)",
    "repeated_output": base_ctes("outputs") + ", c as (select k, value_sats // 2000000 * 2000000 as v, count(*) as n from outputs where value_sats >= 2000000 group by 1, 2), r as (select *, row_number() over (partition by k order by n desc, v desc) as i from c) select k, v as value_sats, n from r where i = 1",
    "family_counts": RESOLVED + ", " + CANDIDATES + f", s as (select source_id, k, script_hex from outs union all select source_id, k, script_hex from ins where script_hex is not null) select source_id, {FAMILY_HEX('script_hex')} as family, count(*) as n, count(distinct k) as transactions from s group by all",
    "prevout_facts": RESOLVED + "select source_id, is_parent, fact_state, count(*) as n, count(script_hex) as scripts from resolved group by all",
    "terminal_candidates": RESOLVED + "select source_id, txid from resolved group by all having bool_and(fact_state <> 'pending')",
    "script_conflicts": base_ctes("outputs") + "select txid as prev_txid, vout as prev_vout, script_hex from outputs where k % 19 <> 0",
    "properties_labels": RESOLVED + ", " + CANDIDATES + f""", lab as (select source_id, k, case when k % 23 = 0 then 'version_other' else 'version_' || (1 + k % 3) end as label from cand union select source_id, k, 'signals_rbf' from ins where sequence < 4294967294 union select source_id, k, 'has_witness' from ins where witness_items > 0
      union select source_id, k, 'has_taproot_annex' from ins where script_hex like '5120%' and length(script_hex) = 68 and witness_items >= 2 and k % 11 = 4 union select source_id, k, {FAMILY_HEX('script_hex')} from outs union select source_id, k, {FAMILY_HEX('script_hex')} from ins where script_hex is not null),
      named as (select lab.source_id, lab.k, string_agg(l.label, ',' order by l.ord) as labels from lab join {LABEL} l on l.label = lab.label group by all), part as (select source_id, k, any_value(txid) as txid, bool_or(script_hex is null) as unknown from ins group by all)
      select n.source_id, p.txid, case when unknown then 'partial' else 'complete' end as state, n.labels, case when unknown then 'input_script_pubkeys' else '' end as missing from named n join part p on p.source_id = n.source_id and p.k = n.k""",
    "shape_labels": RESOLVED + ", " + CANDIDATES + """, i as (select source_id, k, any_value(txid) as txid, count(*) as n_in, count(script_hex) as known, count(distinct script_hex) = count(script_hex) as in_unique from ins group by all), o as (select source_id, k, count(*) as n_out, count(distinct script_hex) = count(*) as out_unique, bool_or(script_hex like '6a%') as carrier from outs group by all),
      eq as (select source_id, k, max(c) as equal from (select source_id, k, value_sats, count(*) as c from outs where value_sats > 0 group by all) group by all),
      f as (select i.source_id, i.txid, n_in = known as complete, n_in >= 5 and n_out >= 5 and equal >= 3 and out_unique and n_in = known and in_unique and not carrier as cj, n_in >= 5 and n_in >= 5 * n_out as co, n_out >= 5 and n_out >= 5 * n_in as ba from i join o on o.source_id = i.source_id and o.k = i.k left join eq on eq.source_id = i.source_id and eq.k = i.k),
      l as (select *, concat_ws(',', case when cj then 'possible_coinjoin' end, case when co then 'consolidation' end, case when ba then 'batch_payout' end, case when complete and not cj and not co and not ba then 'other_shape' end) as labels from f) select source_id, txid, case when complete then 'complete' else 'partial' end as state, split_part(labels, ',', 1) as primary_label, labels from l""",
    "op_return_protocols": RESOLVED + ", " + CANDIDATES + ", d as (select source_id, txid, case when script_hex like '6a5d%' then 'runes' when script_hex like '6a086f6d6e69%' then 'omni' else 'other_op_return' end as label from outs where script_hex like '6a%') select source_id, label, count(*) as n, count(distinct txid) as transactions from d group by all",
    "data_protocols_full": RESOLVED + ", " + CANDIDATES + ", d as (select source_id, txid, case when script_hex like '6a5d%' then 'runes' when script_hex like '6a086f6d6e69%' then 'omni' else 'other_op_return' end as label from outs where script_hex like '6a%'), g as (select source_id, txid, string_agg(distinct label, ',' order by label desc) as x, bool_or(label = 'runes') as a, bool_or(label = 'omni') as b, bool_or(label = 'other_op_return') as c, least(16, count(*)) as n_evidence from d group by all) select c.source_id, c.txid, split_part(coalesce(concat_ws(',', case when a then 'runes' end, case when b then 'omni' end, case when g.c then 'other_op_return' end), ''), ',', 1) || case when g.txid is null then 'no_detected_protocol' else '' end as primary_label, case when g.txid is null then 'no_detected_protocol' else concat_ws(',', case when a then 'runes' end, case when b then 'omni' end, case when g.c then 'other_op_return' end) end as labels, case when g.txid is null then null else n_evidence end as n_evidence from cand c left join g on g.source_id = c.source_id and g.txid = c.txid",
    "rule1_output_size": RESOLVED + ", " + CANDIDATES + "select source_id, txid, count(*) as n from outs where length(script_hex) / 2 > case when script_hex like '6a%' then 83 else 34 end group by all",
    "decode_transactions": base_ctes("outputs", "inputs") + ", o as (select k, count(*) as n_out, cast(sum(value_sats) as bigint) as value_sats from outputs group by k), i as (select k, count(*) as n_in, max(witness_items) > 0 as segwit from inputs group by k) select k, case when k % 53 > 0 then n_in end as n_in, case when k % 53 > 0 then n_out end as n_out, case when k % 53 > 0 then value_sats end as value_sats, case when k % 53 > 0 then segwit end as segwit, case when k % 53 > 0 then '' else 'id mismatch' end as reason from o join i using (k)",
    "status_totals": WITH_CLASSIFIED + "select source_id, coalesce(status, 'unclassified') as status, count(*) as n, cast(sum(vsize) as bigint) as vsize, count(*) filter (unknown_mask > 0) as incomplete from classified group by all",
    "policy_summary": WITH_CLASSIFIED + "select source_id, count(*) filter (status = 'compatible') as compatible, count(*) filter (status = 'violating') as violating, count(*) filter (status = 'indeterminate') as indeterminate, count(*) filter (status is null) as unclassified, count(status) as classified from classified group by source_id",
    "rule_population": WITH_CLASSIFIED + f", w as (select source_id, count(*) as whole from classified group by all) select c.source_id, rule, count(*) as n, cast(sum(vsize) as bigint) as vsize, count(*) / any_value(whole) as share from classified c join {BITS} r on {VIOLATED} join w on w.source_id = c.source_id group by all",
    "signature_population": WITH_CLASSIFIED + f", named as (select c.source_id, c.k, {SIGNATURE} as signature, vsize, unknown_mask, string_agg('R' || (bit + 1), ' + ' order by bit) as rules, count(*) as nr from classified c join {BITS} r on {VIOLATED} where status = 'violating' group by all) select source_id, signature, count(*) as n, cast(sum(vsize) as bigint) as vsize, any_value(case when unknown_mask > 0 then 'Proven ' || rules when nr = 1 then rules || ' only' else rules end) as label from named group by all",
    "terrain": WITH_CLASSIFIED + f", s as (select source_id, vsize, case when status is null then 'unclassified' when status <> 'violating' then status when unknown_mask > 0 then 'violating_partial' else 'violating_exact' end as section, coalesce({SIGNATURE}, status, 'unclassified') as region from classified) select source_id, section, region, count(*) as n, cast(sum(vsize) as bigint) as vsize from s group by grouping sets ((source_id, section, region), (source_id, section))",
    "lens_buckets": WITH_CLASSIFIED + GROUPS + f", seen as (select b.source_id, b.bucket, string_agg(distinct l.label, ',') as x, list_sort(list(distinct l.ord)) as ords from bucketed b join fam f on f.source_id = b.source_id and f.k = b.k join {LABEL} l on l.label = f.family group by all), shown as (select source_id, bucket, (select string_agg(label, ',' order by ord) from {LABEL} where list_contains(ords, ord)) as observed from seen), w as (select source_id, count(*) as whole from classified group by all) select g.source_id, g.bucket, g.n, g.vsize, g.n / whole as share, coalesce(observed, '') as observed, place from groups g join w on w.source_id = g.source_id left join shown s on s.source_id = g.source_id and s.bucket = g.bucket",
    "bucket_sections": WITH_CLASSIFIED + BUCKETS + "select source_id, coalesce(properties_state, 'unavailable') as section, bucket, count(*) as n, cast(sum(vsize) as bigint) as vsize from bucketed group by grouping sets ((source_id, coalesce(properties_state, 'unavailable'), bucket), (source_id, coalesce(properties_state, 'unavailable')))",
    "label_population": WITH_CLASSIFIED + BUCKETS + ", w as (select source_id, count(*) as whole from classified group by all) select f.source_id, f.family as label, count(*) as n, cast(sum(vsize) as bigint) as vsize, count(*) / any_value(whole) as share from fam f join classified c on c.source_id = f.source_id and c.k = f.k join w on w.source_id = f.source_id group by all",
    "lens_summary": WITH_CLASSIFIED + BUCKETS + f", s as (select source_id, count(*) filter (properties_state = 'complete') as complete, count(*) filter (properties_state = 'partial') as partial, count(*) filter (properties_state is null) as unclassified from classified group by all), u as (select source_id, family, count(*) as n from fam group by all) select s.source_id, l.label, coalesce(u.n, 0) as n, complete, partial, unclassified from s cross join {LABEL} l left join u on u.source_id = s.source_id and u.family = l.label",
    "first_largest_label": WITH_CLASSIFIED + BUCKETS + f", u as (select source_id, family, count(*) as n from fam group by all), r as (select u.source_id, l.label, row_number() over (partition by u.source_id order by n desc, l.ord) as i from u join {LABEL} l on l.label = u.family) select source_id, label from r where i = 1",
    "composition": WITH_CLASSIFIED + GROUPS + ", r as (select *, row_number() over (partition by source_id order by vsize desc, place) as i, count(*) over (partition by source_id) as m, sum(vsize) over (partition by source_id) as total from groups), p as (select source_id, case when m <= 5 or i <= 4 then bucket else 'overflow' end as bucket, vsize, total from r) select source_id, bucket, cast(sum(vsize) as bigint) as weight, count(*) as buckets, cast(sum(vsize) as bigint) / cast(any_value(total) as bigint) as share from p group by all",
    "panel_groups": WITH_CLASSIFIED + GROUPS + ", r as (select *, row_number() over (partition by source_id order by n desc, place) as i from groups) select source_id, case when i <= 4 then bucket else 'overflow' end as bucket, cast(sum(n) as bigint) as n, cast(sum(vsize) as bigint) as vsize, count(*) as buckets from r group by all",
    "entanglement": WITH_ENTRY + f", l as (select source_id, 'ancestor_count' as relation, {RELATIVE('ancestor_count')} as band from entry union all select source_id, 'descendant_count', {RELATIVE('descendant_count')} from entry), g as (select source_id, relation, band, count(*) as weight from l group by all) select *, weight / cast(sum(weight) over (partition by source_id, relation) as bigint) as share from g",
    "fee_spectrum": spectrum("true", RATE, 1, 512),
    "ancestor_fee_spectrum": spectrum("true", ANCESTOR_RATE, 1, 512, "vsize"),
    "data_spectrum": spectrum("properties_state is not null and op_return_bytes > 0", "op_return_bytes", 1, 131072),
    "value_spectrum": spectrum("properties_state is not null", "output_sats", 1000, 100_000_000_000),
    "joint_density": density("true", RATE, (1, 512), "vsize", (64, 131072)),
    "complexity_density": density("properties_state is not null", "input_count", (1, 1024), "output_count", (1, 1024)),
    "density_grid": WITH_CLASSIFIED + f", cell as (select source_id, {bin_of(RATE, 1, 512, 22)} as col, {bin_of('vsize', 64, 131072, 14)} as \"row\", count(*) as weight from classified group by all), grid as (select s.source_id, c.x as col, r.y as \"row\" from (select distinct source_id from classified) s cross join (select unnest(range(22)) as x) c cross join (select unnest(range(14)) as y) r), filled as (select g.source_id, g.col, g.\"row\", coalesce(weight, 0) as weight from grid g left join cell c on c.source_id = g.source_id and c.col = g.col and c.\"row\" = g.\"row\") select *, max(weight) over (partition by source_id) as max_cell from filled",
    "age_mosaic": WITH_CLASSIFIED + BUCKETS + f", g as (select source_id, bucket, {AGE_BAND} as band, count(*) as weight from bucketed group by all), t as (select *, cast(sum(weight) over (partition by source_id, bucket) as bigint) as b, cast(sum(weight) over (partition by source_id) as bigint) as w from g) select source_id, bucket, band, weight, b / w as column_share, weight / b as cell_share from t",
    "panel_totals": WITH_CLASSIFIED + "select source_id, count(*) as population_n, cast(sum(vsize) as bigint) as population_vsize, count(*) filter (properties_state is not null) as structured_n, cast(coalesce(sum(vsize) filter (properties_state is not null), 0) as bigint) as structured_vsize, count(*) filter (properties_state is not null and op_return_bytes > 0) as carriers_n, cast(coalesce(sum(vsize) filter (properties_state is not null and op_return_bytes > 0), 0) as bigint) as carriers_vsize, count(*) filter (replaceable) as replaceable_n, cast(coalesce(sum(vsize) filter (replaceable), 0) as bigint) as replaceable_vsize from classified group by source_id",
    "fee_age_lanes": WITH_ENTRY + f"select source_id, 'fee' as axis, {FEE_LANE} as name, count(*) as n from entry group by all union all select source_id, 'age', {AGE_COLUMN}, count(*) from entry group by all",
    "compare_regions": WITH_ENTRY + "select coalesce(l.txid, r.txid) as txid, case when r.txid is null then 'left_only' when l.txid is null then 'right_only' else 'common' end as region, l.wtxid = r.wtxid as same_wtxid, l.vsize as left_vsize, r.vsize as right_vsize from (select * from entry where source_id = 'node-a') l full join (select * from entry where source_id = 'node-b') r on l.txid = r.txid",
    "compare_totals": WITH_ENTRY + ", j as (select l.vsize as lv, r.vsize as rv from (select * from entry where source_id = 'node-a') l full join (select * from entry where source_id = 'node-b') r on l.txid = r.txid) select count(*) as n_union, count(*) filter (lv is not null and rv is not null) as n_common, count(*) filter (rv is null) as n_left_only, count(*) filter (lv is null) as n_right_only, cast(coalesce(sum(lv), 0) as bigint) as left_vsize, cast(coalesce(sum(rv), 0) as bigint) as right_vsize, cast(coalesce(sum(lv) filter (rv is not null), 0) as bigint) as common_left_vsize, cast(coalesce(sum(rv) filter (lv is not null), 0) as bigint) as common_right_vsize from j",
    "variant_differences": WITH_ENTRY + "select count(*) filter (l.wtxid <> r.wtxid) as n_differing from entry l join entry r on l.txid = r.txid and l.source_id = 'node-a' and r.source_id = 'node-b'",
    "sampling_skew": WITH_ENTRY + ", h as (select source_id, min(entered_at_ms) as s, max(entered_at_ms) as c, max(vsize) as tip from entry group by all) select abs(l.c - r.c) as skew_ms, case when l.c < r.c then 'left' when l.c > r.c then 'right' else 'same' end as earlier, greatest(least(l.c, r.c) - greatest(l.s, r.s), 0) as overlap_ms, greatest(greatest(l.s, r.s) - least(l.c, r.c), 0) as separation_ms, l.tip = r.tip as same_tip from h l, h r where l.source_id = 'node-a' and r.source_id = 'node-c'",
    "policy_slices": SIDES + f""", t as (select row_key, 'population' as kind, 'all' as name, vsize from keyed union all select row_key, 'status', coalesce(status, 'unclassified'), vsize from keyed union all select row_key, 'rule', rule, vsize from keyed join {BITS} r on {VIOLATED}
      union all select row_key, case when unknown_mask = 0 then 'exact' else 'partial' end, {SIGNATURE}, vsize from keyed where status = 'violating'), g as (select row_key, kind, name, count(*) as n, cast(sum(vsize) as bigint) as vsize from t group by all),
      z as (select k.row_key, f.kind, f.name from (values ('common_left'), ('common_right'), ('left_only'), ('right_only')) k(row_key), (select 'rule' as kind, rule as name from {BITS} union all select * from (values ('population', 'all'), ('status', 'compatible'), ('status', 'violating'), ('status', 'indeterminate'), ('status', 'unclassified'))) f)
      select coalesce(z.row_key, g.row_key) as row_key, coalesce(z.kind, g.kind) as kind, coalesce(z.name, g.name) as name, coalesce(n, 0) as n, coalesce(vsize, 0) as vsize from z full join g on z.row_key = g.row_key and z.kind = g.kind and z.name = g.name""",
    "policy_matrix": SIDES + f""", c as (select row_key, count(*) filter (status = 'compatible') as compatible, count(*) filter (status = 'violating') as violating, count(*) filter (status = 'indeterminate') as indeterminate, count(*) filter (status is null) as unclassified, count(*) filter (status = 'violating' and unknown_mask = 0) as exact, count(*) filter (status = 'violating' and unknown_mask > 0) as partial from keyed group by all),
      e as (select row_key, {SIGNATURE} as signature, violated_mask as v, count(*) as n from keyed where status = 'violating' and unknown_mask = 0 group by all), r as (select *, row_number() over (partition by row_key order by n desc, {GRAY('v')}, signature) as i from e),
      d as (select row_key, string_agg(signature || '=' || n, ',' order by i) filter (i <= 3) as dominant, count(*) filter (i > 3) as other_combos, cast(coalesce(sum(n) filter (i > 3), 0) as bigint) as other_n from r group by all) select c.*, coalesce(dominant, '') as dominant, coalesce(other_combos, 0) as other_combos, coalesce(other_n, 0) as other_n from c left join d using (row_key)""",
    "policy_sample": SIDES + ", r as (select region, side, coalesce(status, 'unclassified') as status, txid, vsize, row_number() over (partition by region, side, coalesce(status, 'unclassified') order by vsize desc, txid) as rank from keyed) select * from r where rank <= 12",
    "top_sample": WITH_ENTRY + ", r as (select source_id, txid, vsize, row_number() over (partition by source_id order by vsize desc, txid) as rank from entry) select * from r where rank <= 8",
    "scope_panels": SIDES + f", s as (select side || '/all' as source_id, * exclude (source_id) from keyed union all select side || '/' || region, * exclude (source_id) from keyed), l as (select source_id, 'ancestor_count' as relation, {RELATIVE('ancestor_count')} as band, vsize from s union all select source_id, 'descendant_count', {RELATIVE('descendant_count')}, vsize from s), g as (select source_id, relation, band, cast(sum(vsize) as bigint) as weight from l group by all) select *, weight / cast(sum(weight) over (partition by source_id, relation) as bigint) as share from g",
    "carry_forward": WITH_ENTRY + RESULTS + "select r.source_id, r.txid, r.label from results r join entry e on e.source_id = r.source_id and e.txid = r.txid and e.wtxid = r.wtxid",
    "materialise": WITH_ENTRY + RESULTS + "select e.source_id, e.txid, e.vsize, r.label from entry e left join results r on e.source_id = r.source_id and e.txid = r.txid and e.wtxid = r.wtxid",
    "work_set": WITH_ENTRY + RESULTS + ", j as (select e.source_id, r.txid is null as fresh, coalesce(r.retryable and r.attempts < 2, false) as again from entry e left join results r on e.source_id = r.source_id and e.txid = r.txid and e.wtxid = r.wtxid) select source_id, cast(case when fresh then 0 else 1 end as bigint) as priority, count(*) as n from j where fresh or again group by all",
    "reconcile_responses": "with q as (select o_orderkey // 100 as b, o_orderkey as id from orders), a as (select l_orderkey // 100 as b, l_orderkey as id, count(*) as n from lineitem group by all), m as (select q.b, count(*) as requests, count(a.id) as answered from q left join a on a.b = q.b and a.id = q.id group by all), t as (select b, sum(n) as got, max(n) as most from a group by all) select m.b as batch_id, requests, answered, concat_ws(',', case when most > 1 then 'duplicate' end, case when got > requests then 'excess' end) as errors from m left join t on t.b = m.b",
    "detail_lookup": WITH_ENTRY + ", q as (select sha256('tx:' || o_orderkey) as txid, s.source_id from orders, (values ('node-a'), ('node-b'), ('node-c'), ('node-d')) s(source_id)) select q.source_id, case when q.source_id = 'node-d' then 'waiting' when e.txid is null then 'not_present' when e.k % 6 = 0 then 'unclassified' else 'ready' end as outcome, count(*) as n from q left join entry e on e.source_id = q.source_id and e.txid = q.txid group by all",
    "catalog_counts": WITH_CLASSIFIED + BUCKETS + f", u as (select family, count(*) as n from fam group by all) select l.label as label_key, cast(l.ord as bigint) as label_ord, coalesce(n, 0) as n from {LABEL} l left join u on u.family = l.label",
    "capture_scan": WITH_ENTRY + "select source_id, txid, wtxid, vsize, weight, fee_sats, entered_at_ms // 1000 * 1000 as entered_at_ms, ancestor_fee_sats, descendant_vsize, replaceable from entry where source_id <> 'node-c'",
    "response_outcomes": 'with b as (select o_orderkey as k, bool_or(o_orderkey % 997 = 3) over (partition by o_orderkey // 50) as broken, o_orderkey // 50 as batch from orders), t as (select distinct batch from b where broken), e as (select case k % 5 when 0 then \'value\' when 1 then \'null\' when 2 then \'omitted\' else \'error\' end as outcome, case k % 5 when 0 then \'found\' when 4 then \'systemic\' else \'retryable\' end as f from b where not broken), u as (select outcome, f from e union all select \'malformed\', \'retryable\' from t) select outcome, f as "fetch", count(*) as n from u group by outcome, f',
    "latest_good_snapshot": POLLS + ", g as (select source_id, generation, max(observed_at_ms) as o, max(n_entries) as n from p where ok group by all) select source_id, max(generation) as generation, arg_max(o, generation) as observed_at_ms, arg_max(n, generation) as n_entries from g group by source_id",
    "generation_guard": STATUS,
    "source_status_stream": STATUS,
    "revision_merge": "with r as (select 'node-' || (l_suppkey % 3) as source_id, cast(l_partkey as varchar) as txid, case when l_orderkey % 10 > 0 then 2 else 1 end as generation, l_orderkey * 8 + l_linenumber as revision, cast(l_quantity as bigint) as label from lineitem), o as (select source_id, txid, generation, revision, max(label) as label from r group by all), k as (select * from o where generation = (select max(generation) from o o2 where o2.source_id = o.source_id)) select source_id, txid, cast(max(generation) as bigint) as generation, max(revision) as revision, arg_max(label, revision) as label from k group by source_id, txid",
    "fact_memory": base_ctes("inputs") + "select count(*) as n, count(*) filter (utxo_script_hex like '5120%') as taproot from inputs where not from_mempool and utxo_outcome = 'found' and cast('0x' || substr(prev_txid, 1, 4) as int) % 13 <> 0",
    "policy_rules_full": RESOLVED + ", " + CANDIDATES + RULE_ROWS + "select source_id, number, rule, case when e > 0 then 'violate' when m > 0 then 'unknown' else 'pass' end as verdict, count(*) as n, cast(sum(e) as bigint) as evidence, cast(sum(m) as bigint) as missing from verdicts group by all",
    "policy_assessments": RESOLVED + ", " + CANDIDATES + RULE_ROWS + """, a as (select source_id, k, bool_or(e > 0) as v, bool_or(m > 0) as u, bool_or(number = 1 and e > 0) as o from verdicts group by all), h as (select source_id, k, min(vin) as first, arg_min(rule, vin) as rule from hit where number > 1 group by all), b as (select source_id, k, min(vin) as blocked from ins where script_hex is null group by all)
      select a.source_id, case when v then 'violating' when u then 'indeterminate' else 'compatible' end as status, case when o then 'output_size' when h.first is not null and (blocked is null or h.first < blocked) then h.rule else '' end as primary_rule, count(*) as n from a left join h on h.source_id = a.source_id and h.k = a.k left join b on b.source_id = a.source_id and b.k = a.k group by all""",
    "consensus_mode": RESOLVED + ", " + CANDIDATES + RULE_ROWS + """, hgt as (select h.*, case when number = 1 then 1000 when substr(prev_txid, 4, 1) not in ('0', '1', '2') then cast('0x' || substr(prev_txid, 1, 3) as int) % 2000 end as height from hit h), ev as (select source_id, k, number, count(*) filter (height >= 1000) as e, count(*) filter (height is null) as m from hgt group by all)
      select v.source_id, v.rule, case when coalesce(ev.e, 0) > 0 then 'violate' when v.m + coalesce(ev.m, 0) > 0 then 'unknown' else 'pass' end as verdict, count(*) as n from verdicts v left join ev on ev.source_id = v.source_id and ev.k = v.k and ev.number = v.number group by all""",
    "slice_report": RESOLVED + ", " + CANDIDATES + "select source_id, count(distinct txid) as attempted, count(*) filter (fact_state = 'ready') as ready, count(*) filter (fact_state = 'explicitly_missing') as explicitly_missing, count(*) filter (fact_state = 'pending') as pending from ins group by source_id",
}


from .contract_sql import queries as contract_sql  # noqa: E402  they build on the texts above
from .current import SQL as CURRENT, consensus_sql  # noqa: E402
from .spends import queries as spends_sql  # noqa: E402
from .stored import queries as stored_sql  # noqa: E402
from .whole import queries as whole_sql  # noqa: E402

SQL |= contract_sql(SQL) | spends_sql(LABEL) | CURRENT | stored_sql(SQL, WITH_ENTRY, WITH_CLASSIFIED, base_ctes("inputs")) | whole_sql(SQL, WITH_ENTRY, base_ctes("entry", "outputs", "inputs"), FAMILY_HEX("script_hex"), RESOLVED + ", " + CANDIDATES, RULE_ROWS) | {"consensus_window": consensus_sql(RESOLVED + ", " + CANDIDATES + RULE_ROWS)}
