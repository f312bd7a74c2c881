"""DuckDB SQL for the queries of reviewing.py, from the numeric columns and not from parsed text."""

_C = "cast(round({0} * 100) as bigint)".format
_MONEY = "concat(format('{{:,}}', {0} // 100), '.', lpad(cast({0} % 100 as varchar), 2, '0'))".format
_PLAIN = "concat({0} // 100, '.', lpad(cast({0} % 100 as varchar), 2, '0'))".format
_BOX = "(l_partkey % 40)::double x, (l_suppkey % 40)::double y, l_quantity::double w, (l_linenumber * 7)::double h"
_PAIRS = f"""
b as (select l_orderkey d, l_linenumber n, {_BOX} from lineitem),
p as (select b.d, b.n, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) shared, a.w * a.h aa, b.w * b.h bb
  from b join b a on a.d = b.d and a.n = 1 where b.n > 1)"""
_VERSIONS = f"""
l as (select l_orderkey t, l_linenumber r, {_C('l_extendedprice')} c, l_partkey p from lineitem),
v as (select n.t, n.r, o.t is not null had, o.p % 4 = 0 fixed, o.p % 3 = 0 seen, coalesce(n.p % 5 != 0 and o.c = n.c and o.p = n.p, false) same
  from (from l where r > 1) n left join (from l where r < 7) o on n.t = o.t and n.r = o.r),
a as (select *, case when not had then 'new' when fixed and same then 'carried' when fixed then 'conflict' when seen and same then 'kept_review' else 'none' end action from v)"""
#: every cell of every order: t, r, col, role, text, kind, out (as exported), k (place); lines l and orders e
_ORDERS = f"""
l as (
  select l_orderkey t, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1)::int r, l_partkey p,
    if(l_quantity > 40 and l_linenumber = 7, concat(l_quantity::int, ' pcs'), (l_quantity::int)::varchar) q, {_C('l_extendedprice')} c, l_shipdate d
  from lineitem),
e as (select t, bool_or(day(d) > 12) dmy, max(r) + 1 last, sum(if(p % 17 = 0, 0, c)) + if(t % 10 = 0, 100, 0) c, count_if(p % 17 != 0) priced from l group by t),
dates as (select t, r, strftime(d, '%d/%m/%Y') s, if(dmy or day(d) = month(d), 'value', 'ambiguous') kind, d from l join e using (t)),
cells as (
  select t, r, 0 col, 'data' as role, lpad(p::varchar, 8, '0') as text, 'value' kind, lpad(p::varchar, 8, '0') as out from l
  union all select t, r, 1, 'data', q, if(q like '%pcs', 'invalid', 'value'), q from l
  union all select t, r, 2, 'data', if(p % 17 = 0, '..', concat(if(t % 2 = 1, {_MONEY('c')}, translate({_MONEY('c')}, ',.', '.,')), if(p % 19 = 0, '*', ''))), if(p % 17 = 0, 'missing', 'value'), if(p % 17 = 0, '', {_PLAIN('c')}) from l
  union all select t, r, 3, 'data', s, kind, if(kind = 'value', strftime(d, '%Y-%m-%d'), s) from dates
  union all select t, last, 0, 'total', 'Total', 'value', 'Total' from e
  union all select t, last, 1, 'total', '', 'empty', '' from e
  union all select t, last, 2, 'total', if(t % 2 = 1, {_MONEY('c')}, translate({_MONEY('c')}, ',.', '.,')), 'value', {_PLAIN('c')} from e
  union all select t, last, 3, 'total', '', 'empty', '' from e),
u as (select *, (t * 31 + r * 17 + col * 7) % 1000 k from cells)"""
#: cells with a failed result, by rule
_FAILED = """
repeated as (select t, r, row_number() over (partition by t, p, q, if(p % 17 = 0, null, c), d order by r) n from l),
wrong as (select t, last from e where t % 10 = 0 and priced > 0),
hits as (
  select t, r, col, 'convert' rule from u where kind = 'invalid' union all select t, r, col, 'ambiguous' from u where kind = 'ambiguous'
  union all select t, r, col, 'no_source' from u where text != '' and k % 53 = 0 union all select t, r, col, 'low_score' from u where k % 2 = 0 and k < 500
  union all select t, r, col, 'conflict' from u where k % 97 = 0 union all select t, r, col, 'continuation' from u where k % 89 = 0 and k % 97 != 0
  union all select t, r, col, 'duplicate_row' from u join repeated using (t, r) where n > 1 and role = 'data'
  union all select u.t, r, col, 'totals' from u join wrong on u.t = wrong.t where col = 2 and (role = 'total' or kind = 'value'))"""

ORACLES = {
    "type_conversion_failures": f"with {_ORDERS} select t table_id, r as row, col, 'error' severity from u where kind = 'invalid'",
    "leading_zero_codes": "select s_suppkey, 'warning' severity, concat('A1: ', chr(39), lpad(s_suppkey::varchar, 4, '0'), chr(39), ' has zeros in front, which a number loses') message from supplier where s_suppkey < 1000",
    "missing_source_evidence": "select doc_id, 'warning' severity from documents where trim(text, ' ') != '' and doc_id not in (select doc_id from labels where doc_id is not null)",
    "row_structure_gaps": """
select o.k table_id, 0 as row, min(c.col)::int col from (select distinct l_orderkey k from lineitem) o, (select unnest(range(7)) col) c
where not exists (from lineitem l where l.l_orderkey = o.k and l.l_linenumber - 1 = c.col) group by 1""",
    "totals_check": f"""
with o as (select o_custkey t, row_number() over (partition by o_custkey order by o_orderkey) - 1 r, {_C('o_totalprice')} c from orders),
g as (select t, r // 5 k, sum(c) filter (r % 5 != 4) s, max(c) filter (r % 5 = 4) e, count(*) filter (r % 5 != 4) inputs from o group by all)
select t table_id, (k * 5 + 4)::int as row, s::double / 100::double total, inputs, case when inputs = 0 then 'notApplicable' when abs(e - s) > 1 then 'failed' else 'passed' end status
from g where e is not null""",
    "duplicate_rows": "select lang table_id, doc_id as row from (select lang, doc_id, min(doc_id) over (partition by lang, text) f from documents where text != '' and lang != '') where doc_id > f",
    "next_issue": f"""
with {_ORDERS}, i as (select t, r, col, 'convert' rule from u where kind = 'invalid' union all select t, last, 2, 'totals' from e where t % 10 = 0 and priced > 0),
o as (select *, row_number() over (partition by t order by r, col, rule) k, count(*) over (partition by t) n from i)
select t table_id, r as row, col, rule, k::int place, k % n + 1 next_place, (k + n - 2) % n + 1 previous_place from o""",
    "review_disclosure": """
select user_id table_id, count(*) cells, count(*) filter (event_id % 6 < 3) reviewed, count(*) filter (event_id % 6 = 3) needs_review, count(*) filter (event_id % 6 > 3) unreviewed,
  count(*) filter (event_id % 6 = 1) corrected, count(*) filter (event_id % 6 = 5) without_source, coalesce(any_value(open), 0) unresolved,
  count(*) filter (event_id % 6 < 3) = count(*) and coalesce(any_value(open), 0) = 0 complete
from events left join (select user_id, count(*) open from events where event_id % 6 >= 4 group by 1) using (user_id) where event_id % 7 != 0 group by 1""",
    "carry_over": f"""with {_VERSIONS}
select t table_id, r as row, if(action in ('carried', 'conflict'), 'corrected', null) corrected_text,
  case when action = 'conflict' then 'needsReview' when action in ('carried', 'kept_review') and seen then 'reviewed' else 'unreviewed' end review, action
from a""",
    "carry_over_summary": f"""with {_VERSIONS},
s as (select t, count(*) filter (action = 'carried') carried, count(*) filter (action = 'conflict') conflicts, count(*) filter (action = 'kept_review') reviews_kept from a group by 1),
u as (select t, count(*) unplaced from l where p % 4 = 0 and r = 1 group by 1)
select coalesce(s.t, u.t) table_id, coalesce(carried, 0) carried, coalesce(conflicts, 0) conflicts, coalesce(reviews_kept, 0) reviews_kept, coalesce(unplaced, 0) unplaced from s full join u on s.t = u.t""",
    "correction_history": """
select event_id id, lag(lower(event_type)) over w previous_after, row_number() over (partition by user_id order by ts desc, event_id desc)::int from_latest,
  event_type is not distinct from lag(lower(event_type)) over w or row_number() over w = 1 follows
from events window w as (partition by user_id order by ts, event_id)""",
    "current_version": "select user_id table_id, max_by(event_id, (ts, event_id)) run_id from events where event_id % 3 != 0 group by 1",
    "import_dedupe": """
with d as (select doc_id id, sha256(text) sha256 from documents), s as (select sha256, min(id) + 1000000 sid from d where id % 10 = 3 group by 1),
f as (select sha256, min(id) first from d group by 1)
select id, sha256, coalesce(sid, first) document_id, sid is null and id = first is_new from d join f using (sha256) left join s using (sha256)""",
    "content_cache_key": "select o_orderkey, sha256(concat_ws('|', cast(o_orderkey as varchar), o_orderpriority, o_orderstatus)) as key from orders",
    "header_similarity": """
with d as (select n_nationkey, trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) a, trim(regexp_replace(lower(concat(r_name, ' (', n_name, ')')), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) b
  from nation join region on n_regionkey = r_regionkey)
select n_nationkey, round(1 - levenshtein(a, b)::double / greatest(length(a), length(b)), 9) score from d""",
    "schema_mapping": """
with n as (select n_regionkey t, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int col from nation) select t table_id, col, (9 - col)::int target from n""",
    "schema_mismatch": """
with n as (select *, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::int col from nation)
select n_regionkey table_id, col from n where n_nationkey % 4 != 0 and n_nationkey % 3 = 0 union all select 1, -1""",
    "page_to_display": f"""
with b as (select l_orderkey document_id, l_linenumber n, {_BOX} from lineitem),
c as (select document_id, n, n % 4 turn, x - 10 u0, x + w - 10 u1, y - 20 v0, y + h - 20 v1, w, h from b)
select document_id, n, 3 * case turn when 0 then u0 when 1 then v0 when 2 then 580 - u1 else 740 - v1 end x, 3 * case turn when 0 then v0 when 1 then 580 - u1 when 2 then 740 - v1 else u0 end y,
  3 * if(turn % 2 = 0, w, h) width, 3 * if(turn % 2 = 0, h, w) height
from c""",
    "rect_iou": f"with {_PAIRS} select d document_id, n, round(coalesce(shared / nullif(aa + bb - shared, 0), 0), 9) iou from p",
    "candidate_anti_filter": f"""
with b as (select l_orderkey d, l_linenumber n, {_BOX} from lineitem)
select d document_id, n from b where n > 1 and not exists (
  select 1 from (select greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) shared, a.w * a.h + b.w * b.h whole
    from b a where a.d = b.d and a.n = 1) where shared > 0.31417 * (whole - shared))""",
    "best_candidate": f"with {_PAIRS} select d id, max_by(n, (shared, -n)) candidate_id from p where shared > 0 and shared >= 0.5 * least(aa, bb) group by 1",
    "point_hit": f"""
with b as (select l_orderkey d, l_linenumber n, {_BOX} from lineitem)
select o_orderkey point_id, min(n) cell_id from orders join b on d = o_orderkey
where (o_custkey % 60) between x - 1 and x + w + 1 and (o_orderkey % 60) between y - 1 and y + h + 1 group by 1""",
    "csv_lines": """
with p as (select p_partkey, p_brand, if(p_size % 3 = 0, concat(p_name, ', "x"'), p_name) n from part)
select p_partkey, concat_ws(',', cast(p_partkey as varchar), if(regexp_matches(n, '[",]'), concat('"', replace(n, '"', '""'), '"'), n), if(regexp_matches(p_brand, '[",]'), concat('"', replace(p_brand, '"', '""'), '"'), p_brand)) line
from p""",
    "formula_guards": f"""
with p as (select p_partkey, p_size % 7 k, p_partkey % 4 m, concat(['=', '+', '-', '@', chr(9), '', 'a'][p_size % 7 + 1],
  case p_partkey % 4 when 0 then p_partkey::varchar when 2 then {_MONEY('(p_partkey * 100)')} when 3 then translate({_MONEY('(p_partkey * 100)')}, ',.', '.,') else p_name end) raw from part)
select p_partkey, if(k in (0, 3, 4) or (k in (1, 2) and m = 1), concat(chr(39), raw), raw) guarded from p""",
    "export_values": f"with {_ORDERS} select t table_id, r as row, col, if(kind = 'missing', 'NA', out) as out, kind, if(kind = 'value' and col in (1, 2), out, null) number from u",
    "column_letters": """
select distinct i, case when i < 26 then chr(65 + i) when i < 702 then concat(chr(65 + (i - 26) // 26), chr(65 + (i - 26) % 26))
  else concat(chr(65 + (i - 702) // 676), chr(65 + ((i - 702) // 26) % 26), chr(65 + (i - 702) % 26)) end letter
from (select (c_custkey * 7 % 18278)::int i from customer)""",
    "text_recall": """
with w as (select trim(regexp_replace(unnest(list_filter(string_split(text, ' '), lambda x: x != '')), '\\s+', ' ', 'g')) t from benchmark), a as (select t, count(*) n from w where t != '' group by 1),
v as (select trim(regexp_replace(unnest(list_filter(string_split(text, ' '), lambda x: x != '')), '\\s+', ' ', 'g')) t from documents), b as (select t, count(*) n from v where t != '' group by 1)
select sum(least(a.n, coalesce(b.n, 0)))::bigint found, sum(a.n)::bigint total from a left join b using (t)""",
    "engine_summary": """
with s as (select event_type engine, event_id k from events)
select engine, count(*) documents, round(sum(k % 90)::double / sum(k % 90 + 10), 9) cells, round(sum(k % 40)::double / sum(k % 40 + 1), 9) as numeric, round(avg((k % 8) / 8.0::double), 9) source,
  list_sort(list((k % 1000)::double))[count(*) // 2 + 1] latency, max((k % 500)::double) memory, sum(k % 3)::bigint missing_rows, sum(k % 2)::bigint extra_rows
from s group by 1""",
    "row_alignment": f"with {_ORDERS} select distinct t doc, r truth_row, r got_row from u where r != 1",
    "multipage_segments": """
with s as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 k, min(turn) over (partition by conv_id) f from conversations)
select conv_id table_id, turn::int segment, (2 * k + r)::int as row, r = 0 and turn > f repeated_header from s, (select unnest([0, 1]) r)""",
    "csv_export": f"""
with {_ORDERS},
h as (select *, (t + r) % 13 = 5 spans, (t + r + col) % 4 != 0 seen from u),
g as (select t, r, col, if(col = 1 and (t + r) % 11 = 3 or col = 3 and spans, '', out) f, if(col = 1 and (t + r) % 11 = 3 or col = 3 and spans, null, seen) seen from h)
select t table_id, r as row, concat(string_agg(f, ',' order by col), ',', if(bool_and(coalesce(seen, true)), 'reviewed', 'not reviewed')) line from g group by all""",
    "selection_copy": f"with {_ORDERS} select t table_id, r as row, string_agg(if(col = 1 and (t + r) % 11 = 3, '', text), chr(9) order by col) line from u where r < 3 and col < 3 group by all",
    "column_statistics": f"with {_ORDERS} select col, count(*) total, count_if(k % 5 = 0)::bigint reviewed, 0::bigint corrected, count_if(kind in ('invalid', 'ambiguous'))::bigint problems from u group by col",
    "low_score_cells": f"with {_ORDERS} select col, count(*) n from u where k % 2 = 0 and k < 500 group by col",
    "rule_summaries": f"""
with {_ORDERS}, {_FAILED},
failed as (select rule, count(*) failed, count(distinct t) tables_failed from (select distinct t, r, if(rule in ('totals', 'duplicate_row'), -1, col) col, rule from hits where rule != 'totals'
  union all select t, last, -1, 'totals' from wrong) group by rule),
tested as (
  select 'convert' rule, count(*) n from u union all select 'ambiguous', count(*) from u where col > 0 union all select 'leading_zeros', count(*) from u where col in (1, 2) union all select 'no_source', count(*) from u where text != ''
  union all select 'low_score', count(*) from u where k % 2 = 0 union all select 'conflict', count(*) from u where k % 97 = 0 union all select 'continuation', count(*) from u where k % 89 = 0 and k % 97 != 0
  union all select 'row_shape', count(*) from l union all select 'totals', count(*) from e union all select 'duplicate_row', count(*) from l union all select 'recipe_schema', 0)
select rule, n::bigint tested, coalesce(failed, 0)::bigint failed, coalesce(tables_failed, 0)::bigint tables_failed from tested left join failed using (rule)""",
    "unresolved_issues": f"""
with {_ORDERS}, {_FAILED},
seen as (select rule, t, if(rule = 'totals', -1, r) r, if(rule in ('totals', 'duplicate_row'), -1, col) col, bool_and(k % 5 = 0) done from hits join u using (t, r, col) where rule != 'continuation' group by all)
select rule, count(*) n from seen where not done group by rule""",
    "json_provenance": f"""
with {_ORDERS}, {_FAILED},
of_cell as (select t, r, col, string_agg(rule, ',' order by rule) checks from (select distinct * from hits) group by all)
select u.t table_id, 1 as version, concat(chr(65 + u.col), u.r + 1) address, coalesce(checks, '') checks, kind, text, out as value from u left join of_cell using (t, r, col)""",
    "layout_grid": f"with {_ORDERS} select t region_id, r as row, col, text from u where role = 'data'",
}
