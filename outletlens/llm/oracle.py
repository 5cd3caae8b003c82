"""DuckDB SQL for the operators' queries that SQL can express."""

from outletlens.llm.mixing import SCHEDULES


def _position() -> str:
    """SQL for the time at which the schedule of rank ``rank`` has given out ``share`` of its area."""
    n = lambda x: f"{x!r}::double"
    cases = []
    for k, knots in enumerate(SCHEDULES):
        area, acc = [0.0], 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            acc += (t1 - t0) * (w0 + w1) / 2
            area.append(acc)
        parts = []
        for i in reversed(range(len(knots) - 1)):
            (t0, w0), (t1, w1), a = knots[i], knots[i + 1], area[i] / acc
            w0, slope = w0 / acc, (w1 / acc - w0 / acc) / (t1 - t0)
            root = f"sqrt(greatest({n(w0)} * {n(w0)} + {n(2 * slope)} * (share - {n(a)}), 0))"
            parts.append(f"when {'true' if i == 0 else f'share >= {n(a)}'} then case when share - {n(a)} <= 0 then {n(t0)} else least({n(t1)}, {n(t0)} + 2 * (share - {n(a)}) / ({n(w0)} + {root})) end")
        cases.append(f"when rank % {len(SCHEDULES)} = {k} then case {' '.join(parts)} end")
    return f"case {' '.join(cases)} end"


MIXING = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, md5(doc_id::varchar) as mark
  from documents
), totals as (
  select source, sum(size)::bigint as source_size from sized group by source
), ranked as (
  select *, row_number() over (order by source nulls last) - 1 as rank from totals
), weighed as (
  select *, (rank % 3 + 1)::bigint as weight, 3 * source_size as capacity, (3 * source_size)::double / (rank % 3 + 1)::double as per_weight,
    sum(source_size) over ()::bigint as total
  from ranked
), filled as (
  select *, coalesce(sum(capacity) over (order by per_weight, rank rows between unbounded preceding and 1 preceding), 0)::bigint as full_,
    sum(weight) over (order by per_weight, rank rows between current row and unbounded following)::bigint as rest
  from weighed
), levels as (
  select *, (total - full_)::double / rest::double as level_ from filled
), final as (
  select arg_min(level_, (per_weight, rank)) as level_, min((per_weight, rank)) as at from levels where level_ <= per_weight
), goal as (
  select source, rank, source_size, case when (l.per_weight, l.rank) < f.at then l.capacity::double else coalesce(f.level_ * l.weight, l.capacity::double) end as target
  from levels l cross join final f
), placed as (
  select s.doc_id, s.size, g.rank, g.source_size, g.target, least(round(g.target)::bigint, 3 * g.source_size) as demand,
    coalesce(sum(s.size) over (partition by s.source order by s.mark, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as start_
  from sized s join goal g on s.source is not distinct from g.source
), rounds as (
  select *, case when source_size > 0 then demand // source_size else 0 end as rounds from placed
), parts as (
  select *, greatest(0, least(size, demand - rounds * source_size - start_)) as part, start_::double / greatest(demand, 1)::double as share from rounds
), done as (
  select *, (rounds * size + part)::bigint as taken from parts
)
select doc_id, size, source_size, target, taken, case when taken > 0 then (rounds + (part > 0)::bigint)::bigint else 0 end as n_copies,
  case when taken > 0 then POSITION end as position
from done
"""

PREFERENCES = """
with t as (
  select conv_id >> 1 as pair_id, conv_id & 1 as side, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null
), r as (
  select *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as said from t
), c as (
  select pair_id, k, max(case when side = 0 then said end) as a, max(case when side = 1 then said end) as b,
    max(case when side = 0 then role end) as ra, max(case when side = 1 then role end) as rb
  from r group by pair_id, k
), n as (
  select pair_id, coalesce(min(k) filter (where a is null or b is null or a <> b or ra <> rb) - 1, max(k)) as prompt_turns from c group by pair_id
), m as (
  select r.*, n.prompt_turns,
    coalesce(sum(len(said)) over (partition by pair_id, side order by k rows between unbounded preceding and 1 preceding), 0)
      - sum(case when k <= prompt_turns then len(said) else 0 end) over (partition by pair_id, side) as pos_
  from r join n using (pair_id)
)
select pair_id, prompt_turns::int as prompt_turns,
  coalesce(string_agg(said, '' order by k) filter (where side = 0 and k <= prompt_turns), '') as prompt,
  case when count(*) filter (where side = 0) > 0 then coalesce(string_agg(said, '' order by k) filter (where side = 0 and k > prompt_turns), '') end as chosen,
  case when count(*) filter (where side = 0) > 0 then coalesce(string_agg((pos_ + 22)::bigint || '-' || (pos_ + 32 + len(text))::bigint, ',' order by k)
    filter (where side = 0 and k > prompt_turns and role = 'assistant'), '') end as chosen_spans,
  case when count(*) filter (where side = 1) > 0 then coalesce(string_agg(said, '' order by k) filter (where side = 1 and k > prompt_turns), '') end as rejected,
  case when count(*) filter (where side = 1) > 0 then coalesce(string_agg((pos_ + 22)::bigint || '-' || (pos_ + 32 + len(text))::bigint, ',' order by k)
    filter (where side = 1 and k > prompt_turns and role = 'assistant'), '') end as rejected_spans
from m group by pair_id, prompt_turns
"""

TOP_K = """
with v as (
  select vec_id, row_number() over () as own, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, q.own, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
  from v q join v d on q.own <> d.own where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by own order by score desc, vec_id nulls last)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

KEPT_VECTORS = """
with kept as materialized (
  select vec_id, row_number() over () as own, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as materialized (
  select row_number() over (order by mark nulls last, v) - 1 as c, v from (select v, sha256('3:' || vec_id::varchar) as mark from kept order by mark nulls last, v limit 8)
)"""

ROUND = """, s{r} as materialized (
  select k.own, k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept k cross join c{r} c
), a{r} as materialized (
  select own, any_value(vec_id) as vec_id, any_value(v) as v, arg_min(c, (d, c)) as c, min(d) as d from s{r} group by own
)"""

CENTROIDS = """, m{r} as (
  select c, i, count(*)::hugeint as n, sum(v[i])::hugeint as s from a{q} cross join range(1, 65) t(i) group by c, i
), c{r} as materialized (
  select o.c, coalesce(u.v, o.v) as v from c{q} o left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as v from m{r} group by c) u using (c)
)"""


def clustering(rounds: int = 10) -> str:
    """SQL for k-means over the kept vectors: a round's distances, assignment and centroids each a step."""
    steps = [KEPT_VECTORS, ROUND.format(r=0)]
    for r in range(1, rounds + 1):
        steps += [CENTROIDS.format(r=r, q=r - 1), ROUND.format(r=r)]
    return "".join(steps) + f"""
select a.vec_id, a.c::int as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.c = c.c
"""


TRIE = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k
  from conversations where conv_id is not null
), convs as (
  select conv_id as c, conv_id - conv_id % 100 as base, count(*) as turns,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)), lambda crc, b:
      list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 6 as h
  from t group by conv_id
), plans as (
  select c.c, c.base, c.h, least(c.h, coalesce(b.turns, 0)) as head from convs c left join convs b on b.c = c.base
), rows_ as (
  select p.c, t.k as d, t.role, t.text from plans p join t on t.conv_id = p.base and t.k <= p.head
  union all
  select p.c, t.k - p.h + p.head, t.role, t.text from plans p join t on t.conv_id = p.c and t.k > p.h
), prefixes as (
  select c, d, len(text) as n, list(struct_pack(role := role, text := text)) over (partition by c order by d) as said from rows_
  union all
  select c, 0, 0, []::struct(role varchar, text varchar)[] from convs
), ends as (
  select c, max(d) as last from prefixes group by c
), nodes as (
  select said, any_value(d) as depth, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(n) as own,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = last), '')) as ends_sha256
  from prefixes join ends using (c) group by said
), named as (
  select distinct on (n.conv_id, n.depth, p.d) n.*, p.d as up_depth, u.conv_id as up_id
  from nodes n join prefixes p on p.c = n.conv_id and p.d <= n.depth join nodes u on u.said = p.said
), children as (
  select up_id as conv_id, up_depth as depth, count(*) as n_children from named where up_depth = depth - 1 group by all
), totals as (
  select up_id as conv_id, up_depth as depth, sum(own)::bigint as saved_tokens, count(*) filter (where c.n_children is null) as n_leaves
  from named n left join children c on c.conv_id = n.conv_id and c.depth = n.depth group by all
)
select n.conv_id, n.depth::bigint as depth, n.n_convs, n.ends_sha256, coalesce(c.n_children, 0) as n_children, s.n_leaves, s.saved_tokens, p.up_id as parent_conv_id
from nodes n left join children c on c.conv_id = n.conv_id and c.depth = n.depth join totals s on s.conv_id = n.conv_id and s.depth = n.depth
  left join named p on p.conv_id = n.conv_id and p.depth = n.depth and p.up_depth = n.depth - 1
"""

ORACLE = {
    "op2_exact_top_k": TOP_K, "op9_mixing": MIXING.replace("POSITION", _position()), "op8_chat_formatting": PREFERENCES, "op11_centroid_clustering": clustering(), "op13_prefix_trie": TRIE,
}
