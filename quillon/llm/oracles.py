"""SQL of the operators that SQL can express: DuckDB statements that give the rows of the queries by plain brute force.

They hold for tables whose ids are not null and not repeated, like those given; the other cases are in the tests.
"""

from __future__ import annotations

BLANKS = r"[\x20\x09-\x0D]+"


def words(text: str) -> str:
    return f"[x for x in regexp_split_to_array({text}, '{BLANKS}') if x <> '']"


#: components(node, root) of a table links(a, b) that holds both directions, over nodes(node).
COMPONENTS = """
reached(node, root) as (
    select node, node from nodes
    union
    select l.b, r.root from reached r join links l on l.a = r.node where r.root < l.b
),
components as (select node, min(root) as root from reached group by node)
"""

NEAR_DEDUP = f"""
with recursive cut as (
    select doc_id, {words("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
),
shingles as (
    select doc_id, list_distinct(case when len(w) >= 3 then [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from cut
),
nodes as (select doc_id as node, len(s) as n from shingles),
each_one as (select doc_id, hash(unnest(s)) as h from shingles),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as n_both from each_one x join each_one y on x.h = y.h and x.doc_id < y.doc_id group by all),
pairs as (
    select a, b from shared join nodes x on x.node = a join nodes y on y.node = b where 100 * n_both >= 85 * (x.n + y.n - n_both)
),
links as (select a, b from pairs union all select b, a from pairs),
{COMPONENTS}
select node as doc_id, n as n_shingles, root as component_id, node = root as kept from nodes join components using (node)
"""

EMBEDDING_DEDUP = f"""
with recursive nodes as (select vec_id as node from embeddings),
sound as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and embedding is not null
        and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
),
links as (
    select x.vec_id as a, y.vec_id as b from sound x join sound y on x.label = y.label and len(x.v) = len(y.v) and x.vec_id <> y.vec_id
    where list_cosine_similarity(x.v, y.v) >= 0.93
),
degree as (select a as node, count(*) as n from links group by a),
{COMPONENTS}
select node as vec_id, coalesce(n, 0)::bigint as n_links, root as component_id, node = root as kept
from nodes join components using (node) left join degree using (node)
"""

#: The opening mark is an empty word, which no text has.
BACKOFF = f"""
with cut as materialized (select doc_id, {words("lower(coalesce(text, ''))")} as w from documents),
tokens as (select doc_id, unnest(w) as w, unnest(list_prepend('', w[:-2])) as v from cut where len(w) > 0),
grams as materialized (select doc_id, v, w, count(*) as own from tokens group by all),
counted as (
    select doc_id, own, sum(own) over (partition by v, w) - own as pair, sum(own) over (partition by v) - sum(own) over (partition by doc_id, v) as head,
        sum(own) over (partition by w) - sum(own) over (partition by doc_id, w) as word, sum(own) over () - sum(own) over (partition by doc_id) as rest
    from grams
),
scored as (
    select doc_id, sum(own)::bigint as n, sum(own * case when pair > 0 then ln(pair / head) when word > 0 then ln(0.4::double * word / rest) else -ln(rest + 1) end) as score
    from counted group by doc_id
)
select doc_id, coalesce(n, 0)::bigint as n_words, round(coalesce(score, 0), 6) as log_score, round(score / n, 6) as mean_log_score from cut left join scored using (doc_id)
"""

#: A number in [0, 1) from 13 hexadecimal digits of an MD5, in steps of 1 / 2 ** 52.
DIGITS = "('0x' || substring(md5({}), 1, 13))::bigint"

MIXING = f"""
with cut as (select doc_id, coalesce('0' || source, '1') as skey, {words("coalesce(text, '')")} as w from documents),
sized as materialized (
    select doc_id, skey, len(w)::bigint as size, -ln(({DIGITS.format("doc_id::varchar")} + 0.5::double) / 4503599627370496::double) / (0.25::double + len(list_distinct(w)) / greatest(len(w), 1)) as e from cut
),
sources as (
    select skey, sum(size)::bigint as source_size, [5, 2, 1][((row_number() over (order by skey) - 1) % 3 + 1)::int] as weight from sized group by skey
),
filled as (select *, 3 * source_size / weight as level from sources),
levels as (
    select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by level, skey rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by level, skey rows between current row and unbounded following) as common from filled
),
goals as (
    select skey, source_size, least(3 * source_size, (select arg_min(common, (level, skey)) from levels where common <= level) * weight)::double as target from sources
),
budgets as (
    select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs, target - source_size * case when source_size > 0 then floor(target / source_size)::bigint else 0 end as budget from goals
),
summed as (select *, sum(size) over o <= budget as taken_1, row_number() over o as place from sized join budgets using (skey) window o as (partition by skey order by e, doc_id, size)),
gap_1 as (select *, budget - coalesce(sum(size) filter (where taken_1) over (partition by skey), 0) as gap from summed),
fitting as (select *, case when not taken_1 and size <= gap then size else 0 end as fits from gap_1),
again as (select *, taken_1 or (fits > 0 and sum(fits) over (partition by skey order by place) <= gap) as taken_2 from fitting),
gap_2 as (select * replace (budget - coalesce(sum(size) filter (where taken_2) over (partition by skey), 0) as gap) from again),
nearest as (select skey, arg_min(place, (abs(size - gap), place)) as best from gap_2 where not taken_2 and abs(size - gap) < gap group by skey)
select doc_id, size, source_size, target, (size * least(epochs + case when taken_2 or coalesce(place = best, false) then 1 else 0 end, 3))::bigint as taken from gap_2 left join nearest using (skey)
"""

#: CRC-32 with the polynomial 0xEDB88320: eight steps for each byte.
_step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
CRC32 = f"""
steps(i, c, k) as (select i, i, 0 from range(256) t(i) union all select i, {_step}, k + 1 from steps where k < 8),
crc_table as (select list(c order by i) as t from steps where k = 8),
bytes as (select doc_id, source, hex(encode(coalesce(text, ''))) as h from documents),
checked as materialized (
    select doc_id, source, len(h) // 2 as n, xor(list_reduce([('0x' || x)::bigint for x in regexp_extract_all(h, '..')], lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295) as text_crc32
    from bytes, crc_table
)
"""

SHARDING = f"""
with recursive {CRC32},
numbered as (
    select doc_id, coalesce('0' || source, '1') as skey, (n + 16)::bigint as size, text_crc32,
        {DIGITS.format("'7:' || doc_id || ':' || text_crc32")} as u from checked
),
ranked as (select *, (row_number() over (partition by skey order by u, doc_id, text_crc32, size) - 0.5::double) / count(*) over (partition by skey) as f from numbered),
placed as (select *, row_number() over (order by f, skey) - 1 as place, count(*) over () as n from ranked)
select doc_id, size, text_crc32::bigint as text_crc32, 'rows' as law, (place * 40 // n)::int as shard, (place - ((place * 40 // n) * n + 39) // 40)::bigint as slot, null::int as grown_shard from placed
"""

#: Nodes are lists of (role, text); crc32 of the decimal id by the table of 256 entries.
TRIE = f"""
with recursive steps(i, c, k) as (select i, i, 0 from range(256) t(i) union all select i, {_step}, k + 1 from steps where k < 8),
crc_table as (select list(c order by i) as t from steps where k = 8),
original as (
    select conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as turns
    from conversations where conv_id is not null group by conv_id
),
named as (
    select original.*, conv_id - conv_id % 20 as base,
        (xor(list_reduce([('0x' || x)::bigint for x in regexp_extract_all(hex(encode(conv_id::varchar)), '..')], lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295) % 4)::int as h
    from original, crc_table
),
paths as materialized (
    select a.conv_id, (case when a.h = 0 then [] else coalesce(b.turns[1:a.h], []) end) || a.turns[a.h + 1:] as turns from named a left join original b on b.conv_id = a.base
),
prefixes as (select conv_id, turns, unnest(range(len(turns) + 1)) as depth from paths),
nodes as materialized (
    select case when depth = 0 then [] else turns[1:depth] end as node, depth, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = len(turns)), '')) as ends_sha256
    from prefixes group by all
),
counted as materialized (
    select n.*, case when n.depth > 1 then n.node[1:n.depth - 1] when n.depth = 1 then [] end as parent, count(c.depth) as n_children from nodes n
    left join nodes c on c.depth = n.depth + 1 and (n.depth = 0 or c.node[1:n.depth] = n.node) group by all
),
summed as (
    select case when up = 0 then [] else node[1:up] end as node, up as depth, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(case when depth > 0 then (n_convs - 1) * len({words("node[depth].text")}) else 0 end) as saved_tokens
    from (select *, unnest(range(depth + 1)) as up from counted) group by all
)
select c.conv_id, c.depth::bigint as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, c.ends_sha256
from counted c join summed s on s.depth = c.depth and s.node = c.node left join nodes p on p.depth = c.depth - 1 and p.node = c.parent
"""

FILTER_AUDIT = f"""
with texts as materialized (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
cut as (select *, {words("t")} as w, coalesce(min(doc_id) over (partition by t) < doc_id, false) as later from texts),
judged as (
    select doc_id, part, [x for x in [
        case when len(w) < 200 then 'A' end, case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' end,
        case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 'C' end,
        case when regexp_matches(t, '[#$%&*|]') then 'D' end, case when later then 'E' end] if x is not null] as fails from cut
),
marks as (select doc_id, max(coalesce((quality = 1)::int, 0)) as good, max(coalesce((toxic = 1)::int, 0)) as toxic from labels group by doc_id),
masks as materialized (select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from judged left join marks using (doc_id) group by all),
letters(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps as (select filter_order, step, filter_order[step] as f, [x for x in string_split(filter_order[1:step - 1], '') if x <> ''] as gone from orders, range(1, 6) r(step)),
audited as (
    select part, filter_order, step, f, sum(case when not list_contains(fails, f) and not list_has_any(fails, gone) then n else 0 end) as kept,
        sum(case when list_contains(fails, f) and not list_has_any(fails, gone) then n else 0 end) as removed, sum(case when list_contains(fails, f) and list_has_any(fails, gone) then n else 0 end) as redundant,
        sum(case when fails = [f] then n else 0 end) as unique_fails, sum(case when list_contains(fails, f) and not list_has_any(fails, gone) then good else 0 end) as good_lost,
        sum(case when list_contains(fails, f) and not list_has_any(fails, gone) then toxic else 0 end) as toxic_lost
    from masks, steps group by all
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
    toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from audited
"""

SEARCH = """
with vectors as materialized (
    select row_number() over () as r, vec_id, [floor(256 * x::double) for x in embedding] as v from embeddings
    where vec_id is not null and embedding is not null and coalesce(list_bool_and([x is not null and isfinite(x) for x in embedding]), true)
),
scored as (
    select q.r as query, q.vec_id as query_id, c.vec_id, case when len(q.v) = 0 then 0 else list_inner_product(q.v, c.v) end::bigint as score from vectors q join vectors c on q.r <> c.r where q.vec_id % 50 = 0
),
ranked as (select *, row_number() over (partition by query order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""

ORACLES = {"op1_near_dedup": NEAR_DEDUP, "op2_embedding_dedup": EMBEDDING_DEDUP, "op4_mixing": MIXING, "op6_lm_scoring": BACKOFF, "op9_sharding": SHARDING, "op11_prefix_trie": TRIE, "op12_filter_audit": FILTER_AUDIT, "op13_topk_search": SEARCH}
