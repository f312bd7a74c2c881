"""DuckDB SQL for what SQL can express of this package's queries."""

from gridsmith.llm.quality_rules import RULES

_WORD = r"[^\x20\x09-\x0D]+"


def _quality_rules(risk: float = 0.05, delta: float = 0.05) -> str:
    alpha = risk / len(RULES)
    rules = " union all ".join(
        f"select {i} r, {j} c, {cutoff!r}::double cutoff" for i, (_, cutoffs) in enumerate(RULES.values()) for j, cutoff in enumerate(cutoffs)
    )
    ratio = "\nunion all ".join(
        f"select doc_id, row_no, stratum, base_failed, {i} r, coalesce({a}::double / nullif({b}, 0), 0) x from f" for i, (a, _, b) in enumerate(x.split() for x, _ in RULES.values())
    )
    return f"""
with w as (
  select row_number() over () row_no, doc_id, lang stratum, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '{_WORD}') words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) lines
  from documents),
runs as (select row_no, i, [words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]] run from (select row_no, words, unnest(range(1, len(words) - 3)) i from w)),
twice as (select row_no, i from (select row_no, i, count(*) over (partition by row_no, run) n from runs) where n > 1),
repeats as (select row_no, count(distinct j)::bigint n from (select row_no, unnest(range(i, i + 5)) j from twice) group by row_no),
f as (
  select w.row_no, doc_id, stratum, len(words)::bigint n_words, length(array_to_string(words, ''))::bigint word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
    coalesce(repeats.n, 0)::bigint n_repeat_words, len(lines) n_lines, len(regexp_extract_all(text, '[A-Z]')) n_capitals, len(regexp_extract_all(text, '!')) n_exclamations,
    len(words) < 10 or 100 * coalesce(repeats.n, 0) > 20 * len(words) base_failed
  from w left join repeats using (row_no)),
ratios as ({ratio}),
rules as ({rules}),
good as (select doc_id from labels where doc_id is not null group by doc_id having min(coalesce(quality, 0)) = 1),
tested as (
  select stratum, rules.r, c, cutoff, count(*) n, count(*) filter (x > cutoff) k
  from ratios join rules using (r) where not base_failed and doc_id in (from good) group by all),
tail as (
  select *, case when k >= n * {alpha!r} then 1 else (
    select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha!r}) + (n - j) * ln(1 - {alpha!r}))) from (select unnest(range(0, k + 1)) j)) end p
  from tested),
allowed as (
  select stratum, r, c, cutoff, min((p <= {delta!r} / ({len(RULES)} * (select count(distinct coalesce(stratum, chr(1))) from tested)))::int) over (partition by stratum, r order by c) ok from tail),
chosen as (select stratum, r, max_by(cutoff, c) cutoff from allowed where ok = 1 group by all),
broken as (select row_no, r from ratios join chosen using (r) where ratios.stratum is not distinct from chosen.stratum and x > cutoff),
names as (select unnest(range({len(RULES)})) r, unnest({list(RULES)!r}) name),
listed as (select row_no, string_agg(name, ',' order by r) broken from broken join names using (r) group by row_no)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and listed.broken is null kept, coalesce(listed.broken, '') broken
from f left join listed using (row_no)"""


_SUBSTRING_DEDUP = f"""
with w as (select row_number() over () row_no, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') words from documents),
runs as (select row_no, doc_id, i, array_to_string(words[i : i + 19], ' ') run from (select row_no, doc_id, words, unnest(range(1, len(words) - 18)) i from w)),
late as (select row_no, i from (select row_no, i, row_number() over (partition by run order by doc_id, i) k from runs) where k > 1),
gone as (select distinct row_no, unnest(range(i, i + 20)) j from late),
each as (select row_no, unnest(words) word, generate_subscripts(words, 1) j from w),
kept as (select row_no, string_agg(word, ' ' order by j) t from each anti join gone using (row_no, j) group by row_no),
counts as (select row_no, count(*) n from gone group by row_no)
select doc_id, len(words)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256
from w left join kept using (row_no) left join counts using (row_no)"""

_EMBEDDING_DEDUP = """
with recursive v as (select row_number() over () r, vec_id, label, embedding::double[] e from embeddings),
able as (
  select r, vec_id, label, e, sqrt(list_inner_product(e, e)) norm from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_inner_product(e, e) > 0),
links as (select a.r, b.r s from able a join able b on a.label = b.label and a.r != b.r and len(a.e) = len(b.e) where list_inner_product(a.e, b.e) / a.norm / b.norm >= 0.98),
reach(r, s) as (select r, r from v union select reach.r, links.s from reach join links on reach.s = links.r),
parts as (select reach.r, min(v.vec_id) component_id from reach join v on v.r = reach.s group by 1),
counts as (select r, count(*) n from links group by 1)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept from v join parts using (r) left join counts using (r)"""



def _source_mixing(weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 32, seed: int = 7, shards: int = 16) -> str:
    """Seats one by one by their quotients, and each seat's block of the tape met with the documents on it."""
    return f"""
with d as (select row_number() over () row_no, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint size, md5(concat('{seed}:', coalesce(doc_id::varchar, 'null'))) h from documents),
s as (
  select source, sum(size)::bigint source_size, row_number() over (order by encode(source) nulls last) rank,
    {list(weights)}[((row_number() over (order by encode(source) nulls last) - 1) % {len(weights)} + 1)::int]::double weight
  from d group by source),
levels as (
  select *, ({share} * (select sum(source_size) from s) - coalesce(sum({cap} * source_size) over (order by {cap} * source_size / weight, rank rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by {cap} * source_size / weight, rank rows between current row and unbounded following) level
  from s),
aims as (
  select source, source_size, rank, least({cap} * source_size, coalesce((select min_by(level, ({cap} * source_size / weight, rank)) from levels where level <= {cap} * source_size / weight), 'inf'::double) * weight)::double target
  from levels),
seats as (select round(sum(target) / {block})::bigint n from aims),
quotients as (select rank, target / (2 * j + 1) q from (select rank, target, unnest(range(0, ceil(target / {block})::bigint + (select count(*) from aims) + 1)) j from aims)),
given as (select rank from quotients order by q desc, rank limit (select n from seats)),
quotas as (select aims.*, (select count(*) from given where given.rank = aims.rank)::bigint quota from aims),
firsts as (select *, least(quota * {block}, floor({cap} * source_size)::bigint) words, coalesce(sum(quota) over (order by rank rows between unbounded preceding and 1 preceding), 0)::bigint first_seat from quotas),
tape as (
  select d.*, firsts.* exclude (source), coalesce(sum(size) over (partition by d.source order by h, doc_id nulls first, size, row_no rows between unbounded preceding and 1 preceding), 0)::bigint start
  from d join firsts on d.source is not distinct from firsts.source),
parts as (select row_no, words, first_seat, p * source_size + start a, p * source_size + start + size b from (select *, unnest(range(0, {int(-(-cap // 1))})) p from tape)),
met as (
  select row_no, (first_seat + seat) % {shards} k, least(b, words, (seat + 1) * {block}) - greatest(a, seat * {block}) n
  from (select *, unnest(range(a // {block}, (least(b, words) + {block - 1}) // {block})) seat from parts where least(b, words) > a)),
dealt as (select row_no, k, sum(n)::bigint n from met group by all),
listed as (
  select row_no, string_agg(coalesce(n, 0)::varchar, ',' order by k) shard_words, sum(coalesce(n, 0))::bigint taken
  from (select row_no, unnest(range(0, {shards})) k from d) left join dealt using (row_no, k) group by row_no)
select doc_id, source, size, source_size, target, quota, taken, shard_words from tape join listed using (row_no)"""


def _centroid_clustering(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Plain rounds: every vector against every centroid, in integers."""
    nearest = "select row_no, x, arg_min(no, (d, no)) no, min(d) d from (select row_no, x, no, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d from v, c{i}) group by row_no, x"
    steps = ""
    for i in range(rounds):
        steps += f"""
a{i} as materialized ({nearest.format(i=i)}),
m{i} as (
  select no, list((s - (s % n + n) % n) // n order by j) c
  from (select no, j, sum(x[j])::bigint s, count(*) n from a{i}, (select unnest(range(1, {dims + 1})) j) group by no, j) group by no),
c{i + 1} as materialized (select no, coalesce(m{i}.c, c{i}.c) c from c{i} left join m{i} using (no)),"""
    return f"""
with v as materialized (
  select row_number() over () row_no, vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) x from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
c0 as materialized (
  select (row_number() over (order by h nulls last, x) - 1)::int no, x c from (select sha256('{seed}:' || vec_id) h, x from v) order by h nulls last, x limit {k}),{steps}
last as ({nearest.format(i=rounds)})
select vec_id, no as cluster, d as distance, sum(d) over (partition by no)::bigint cluster_inertia, sum(d) over ()::bigint inertia, sha256(array_to_string(c, ',')) centroid_sha256
from last join v using (row_no) join c{rounds} using (no)"""


SQL = {"op1_quality_rules": _quality_rules(), "op6_substring_dedup": _SUBSTRING_DEDUP, "op9_source_mixing": _source_mixing(), "op10_embedding_dedup": _EMBEDDING_DEDUP, "op13_centroid_clustering": _centroid_clustering()}
