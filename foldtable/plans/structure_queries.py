"""Queries on sequences as integers and on structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec
from ..operators import components, mutate, sampling, structure
from .define import Queries
from .fixtures import CODES, MAP, ROUGH, SHAPES, L, mix_sql

Q = Queries()
QUERIES, ORACLE_SQL = Q.queries, Q.sql

SEQ = "array_to_string(list_transform(range(13), lambda k: substr('ACUG', cast((code >> cast(2*(12-k) as int)) & 3 as int) + 1, 1)), '')"
SITE = "cast((code >> cast(2*(12-pos) as int)) & 3 as int)"

# Pairs and features of a `shapes` table in SQL, by a search for each bracket's partner.
SITES = """s as (select structure, cast(p as int) as pos, substr(structure, cast(p as int) + 1, 1) as sym from shapes, range(0, 60) as r(p) where p < length(structure)),
d as materialized (select *, cast(sum(case sym when '(' then 1 when ')' then -1 else 0 end) over (partition by structure order by pos) as int) as run from s),
bp as materialized (select o.structure, o.pos as i, min(c.pos) as j from d o join d c on c.structure = o.structure and c.pos > o.pos and c.sym = ')' and c.run = o.run - 1 where o.sym = '(' group by o.structure, o.pos),
pt as materialized (select structure, i as pos, j as partner from bp union all select structure, j, i from bp),
x as materialized (select d.*, pt.partner from d left join pt using (structure, pos))"""
STACK = """chain as (select structure, i, j, case when exists (select 1 from bp b where b.structure = a.structure and b.i = a.i - 1 and b.j = a.j + 1) then 0 else 1 end as head from bp a),
head as (select *, i + j as ij, sum(head) over (partition by structure, i + j order by i) as run from chain),
sl as materialized (select structure, i, j, cast(count(*) over (partition by structure, ij, run) as int) as stack_length from head)"""


@Q.add("seq_str_to_code", f"with {CODES}, a as (select code, {SEQ} as seq from g) select seq, code from a")
def _(t):
    seqs = t.g.select(codec.code_to_seq(F.col("code"), L).alias("seq"))
    return seqs.select("seq", codec.seq_to_code(F.translate("seq", "U", "T")).alias("code"))


@Q.add("code_to_seq_str", f"with {CODES} select code, {SEQ} as seq from g")
def _(t):
    return t.g.select("code", codec.code_to_seq(F.col("code"), L).alias("seq"))


BITS = "'1' || replace(replace(replace(structure, '.', '00'), '(', '10'), ')', '01')"


@Q.add("structure_to_code", f"with {SHAPES}, b as (select structure, {BITS} as bits from shapes) select structure, case when length(structure) <= 31 then cast(list_sum(list_transform(range(length(bits)), lambda k: cast(substr(bits, cast(k+1 as int), 1) as bigint) << cast(least(length(bits)-1-k, 62) as int))) as bigint) end as structure_code from b")
def _(t):
    return t.shapes.select("structure", codec.structure_to_code(F.translate("structure", ".()", "_[]")).alias("structure_code"))


@Q.add("code_to_structure", f"with {SHAPES} select case when length(structure) <= 31 then structure end as structure, parts from shapes")
def _(t):
    coded = t.shapes.select(codec.structure_to_code(F.col("structure")).alias("c"), "parts")
    return coded.select(codec.code_to_structure(F.col("c")).alias("structure"), "parts")


@Q.add("is_unfolded", f"with {MAP} select code, structure not like '%(%' as unfolded from m union all select -code - 1, code in (0, 1) or bit_count(code) = 1 from g")
def _(t):
    a = t.gpmap.select("code", codec.is_unfolded(codec.structure_to_code(F.col("structure"))).alias("unfolded"))
    return a.unionByName(t.g.select((-F.col("code") - 1).alias("code"), codec.is_unfolded(F.col("code")).alias("unfolded")))


@Q.add("point_neighbours", f"with {CODES}, a as (select code, cast(p as int) as pos, cast(b as int) as new_base from g, range(0, 13) r(p), range(0, 4) q(b)) select code, pos, new_base, code + cast(new_base - {SITE} as bigint) * (1::bigint << cast(2*(12-pos) as int)) as mutant from a where {SITE} <> new_base")
def _(t):
    return mutate.point_neighbours(t.g.select("code"), L).select("code", "pos", "new_base", "mutant")


@Q.add("site_neighbours", f"with {CODES}, a as (select code, 9 as pos, cast(b as int) as new_base from g, range(0, 4) q(b)) select code, new_base, code + cast(new_base - {SITE} as bigint) * 64 as mutant from a where {SITE} <> new_base")
def _(t):
    return mutate.point_neighbours(t.g.select("code"), L, F.lit(9)).select("code", "new_base", "mutant")


PAIR_MUTANTS = f"""with {MAP}, shapes as (select structure from st), {SITES},
al(a, b) as (values (0, 2), (2, 0), (3, 1), (1, 3), (3, 2), (2, 3)),
q as (select code, i, j, a, b, cast((code >> cast(2*(12-i) as int)) & 3 as int) as x, cast((code >> cast(2*(12-j) as int)) & 3 as int) as y from m join bp using (structure), al)
select code, i, j, code + cast(a - x as bigint) * (1::bigint << cast(2*(12-i) as int)) + cast(b - y as bigint) * (1::bigint << cast(2*(12-j) as int)) as mutant from q where """


@Q.add("bp_double_mutants", PAIR_MUTANTS + "a <> x and b <> y")
def _(t):
    return mutate.bp_double_mutants(t.gpmap.select("code", "structure"), structure.base_pairs(t.structures), L).select("code", "i", "j", "mutant")


@Q.add("bp_swaps_at_site", PAIR_MUTANTS + "(a <> x or b <> y) and (i = 2 or j = 2)")
def _(t):
    return mutate.bp_swaps_at_site(t.gpmap.select("code", "structure"), structure.base_pairs(t.structures), L, F.lit(2)).select("code", "i", "j", "mutant")


@Q.add("hamming_distance", f"with {CODES}, a as (select code, {SEQ} as s from g), b as (select cast(code as bigint) as code, s, lead(code) over (order by code) as code_b, lead(s) over (order by code) as z from a) select code, code_b, cast(len(list_filter(range(1, 14), lambda k: substr(s, cast(k as int), 1) <> substr(z, cast(k as int), 1))) as bigint) as distance from b where code_b is not null")
def _(t):
    # Rows meet the next code by their place among all, which ranges of codes count.
    placed = components._kept(sampling.running_sum(t.g.select("code"), [], ["code"], F.lit(1), "at"))
    both = placed.join(placed.select(F.col("code").alias("code_b"), (F.col("at") - 1).alias("at")), "at")
    return both.select("code", "code_b", codec.hamming(F.col("code"), F.col("code_b")).cast("long").alias("distance"))


@Q.add("double_mutant", f"with {CODES} select code, (code // 16) * 16 + (code + 1) % 4 + 4 * (((code // 4) % 4 + 1) % 4) as g4, cast(2 as bigint) as distance from g")
def _(t):
    bump = lambda pos: codec.with_base(F.col("code"), F.lit(pos), (codec.base_at(F.col("code"), F.lit(pos), L) + 1) % 4, L)
    g4 = t.g.select("code", mutate.double_mutant(F.col("code"), bump(12), bump(11)).alias("g4"))
    return g4.select("code", "g4", codec.hamming(F.col("code"), F.col("g4")).cast("long").alias("distance"))


@Q.add("random_sequences", f"with a as (select distinct l_orderkey * 8 + l_linenumber as id from lineitem), v as (select id, k, {mix_sql('id * 13 + k', 7)} as m from a, range(0, 13) r(k)) select id, cast(sum((m // 64 % 4) * (1::bigint << cast(2*(12-k) as int))) as bigint) as code from v group by id")
def _(t):
    from ..operators.sampling import random_sequences

    return random_sequences(t.raw("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).distinct(), L, 7)


@Q.add("base_pairs", f"with {SHAPES}, {SITES} select structure, pos, partner from pt")
def _(t):
    return structure.base_pairs(t.shapes)


BALANCED = """bal as (select structure, coalesce(min(run) >= 0 and max(case when pos = length(structure) - 1 then run end) = 0, false) as balanced from d group by structure)"""
ROUGH_SITES = ROUGH + ", shapes as (select * from rough), " + SITES + ", " + BALANCED


@Q.add("pairs_balanced", f"with {ROUGH_SITES} select structure, balanced from bal")
def _(t):
    return structure.balance(t.rough)


VALID = ROUGH_SITES + ", " + STACK + """, v as (select b.structure, b.balanced, coalesce((select min(j - i) >= 4 from bp where bp.structure = b.structure), true) and b.balanced as hairpins_ok,
  b.balanced and exists (select 1 from bp where bp.structure = b.structure) as has_pair, b.balanced and coalesce((select min(stack_length) = 1 from sl where sl.structure = b.structure), false) as isolated from bal b)"""


@Q.add("hairpins_long_enough", f"with {VALID} select structure, hairpins_ok from v where balanced")
def _(t):
    return structure.validity(t.rough).where("balanced").select("structure", "hairpins_ok")


@Q.add("has_isolated_pair", f"with {VALID} select structure, isolated from v where balanced")
def _(t):
    return structure.validity(t.rough).where("balanced").select("structure", "isolated")


@Q.add("is_valid_structure", f"with {VALID} select structure, balanced and hairpins_ok and has_pair and not isolated as valid, balanced and hairpins_ok and has_pair as valid_with_isolated from v")
def _(t):
    return structure.validity(t.rough).select("structure", "valid", "valid_with_isolated")


@Q.add("is_unfolded_or_isolated", f"with {VALID} select r.structure, r.parts, not v.has_pair or v.isolated as discarded from rough r join v using (structure) where balanced")
def _(t):
    flags = structure.validity(t.rough).where("balanced").select("structure", (~F.col("has_pair") | F.col("isolated")).alias("discarded"))
    return t.rough.join(flags, "structure").select("structure", "parts", "discarded")


@Q.add("stack_length", f"with {SHAPES}, {SITES}, {STACK} select structure, i as pos, stack_length from sl union all select structure, j, stack_length from sl")
def _(t):
    return structure.site_stacks(t.shapes).select("structure", "pos", "stack_length")


LOOP = "lp as materialized (select structure, pos, cast(count(*) over (partition by structure, grp) as int) as loop_length from (select *, pos - row_number() over (partition by structure order by pos) as grp from x where sym = '.') u)"


@Q.add("loop_length", f"with {SHAPES}, {SITES}, {LOOP} select * from lp")
def _(t):
    return structure.site_features(t.shapes).where("sym = '.'").select("structure", "pos", "loop_length")


@Q.add("element_length", f"with {SHAPES}, {SITES}, {STACK}, {LOOP} select structure, i as pos, stack_length as element_length from sl union all select structure, j, stack_length from sl union all select * from lp")
def _(t):
    return structure.site_features(t.shapes).select("structure", "pos", "element_length")


NEXT = """nb as (select a.structure, a.pos, a.sym, a.run, a.partner, coalesce(substr(a.structure, nullif(a.pos, 0), 1), ' ') as prev_sym, case when a.pos = length(a.structure) - 1 then ' ' else substr(a.structure, a.pos + 2, 1) end as next_sym,
  (select max(b.pos) from pt b where b.structure = a.structure and b.pos < a.pos) as prev_bracket_pos, (select min(b.pos) from pt b where b.structure = a.structure and b.pos > a.pos) as next_bracket_pos from x a)"""


@Q.add("neighbour_symbols", f"with {SHAPES}, {SITES}, {NEXT} select structure, pos, prev_sym, next_sym, case when prev_bracket_pos is null then ' ' else substr(structure, prev_bracket_pos + 1, 1) end as prev_bracket, case when next_bracket_pos is null then ' ' else substr(structure, next_bracket_pos + 1, 1) end as next_bracket, prev_bracket_pos, next_bracket_pos from nb")
def _(t):
    return structure.site_features(t.shapes).select("structure", "pos", "prev_sym", "next_sym", "prev_bracket", "next_bracket", "prev_bracket_pos", "next_bracket_pos")


ENCLOSED = """enc as (select n.*, (select max(b.i) from bp b where b.structure = n.structure and b.i < n.pos and b.j > n.pos) as outer_i from nb n),
kids as (select c.structure, (select max(b.i) from bp b where b.structure = c.structure and b.i < c.i and b.j > c.j) as outer_i, count(*) as kids from bp c group by 1, 2),
multi as (select e.*, e.outer_i is not null and coalesce(k.kids, 0) > 1 as multiloop from enc e left join kids k on k.structure = e.structure and k.outer_i = e.outer_i)"""
ROLE = NEXT + ", " + ENCLOSED + """, sy as (select *, case when partner is null then null when partner = 0 then ' ' else substr(structure, partner, 1) end as q1, case when partner = length(structure) - 1 then ' ' else substr(structure, partner + 2, 1) end as q2,
  (select partner from pt p where p.structure = multi.structure and p.pos = multi.pos - 1) as before_p, (select partner from pt p where p.structure = multi.structure and p.pos = multi.pos + 1) as after_p,
  (select partner from pt p where p.structure = multi.structure and p.pos = multi.prev_bracket_pos) as pp, (select partner from pt p where p.structure = multi.structure and p.pos = multi.next_bracket_pos) as np from multi),
ro as materialized (select structure, pos, sym, multiloop, outer_i is null and sym = '.' as exterior, case when sym <> '.' then 'stack' when outer_i is null then 'exterior loop'
  when substr(structure, prev_bracket_pos + 1, 1) = '(' and substr(structure, next_bracket_pos + 1, 1) = ')' then 'hairpin loop' when multiloop then 'multiloop' when abs(np - pp) - 1 <> 0 then 'internal loop' else 'bulge' end as role,
  case when sym <> '.' then case when prev_sym in ('.', ' ') or next_sym in ('.', ' ') or q1 in ('.', ' ') or q2 in ('.', ' ') then 'end' when abs(before_p - partner) = 1 and abs(after_p - partner) = 1 then 'middle' else 'end' end
    when prev_sym in ('(', ')') or next_sym in ('(', ')') or (outer_i is null and (prev_sym = ' ' or next_sym = ' ')) then 'end' else 'middle' end as place from sy)"""


@Q.add("structural_role", f"with {SHAPES}, {SITES}, {ROLE} select structure, pos, role, place from ro")
def _(t):
    return structure.site_features(t.shapes).select("structure", "pos", "role", "place")


@Q.add("is_exterior", f"with {SHAPES}, {SITES}, {ROLE} select structure, pos, exterior from ro")
def _(t):
    return structure.site_features(t.shapes).select("structure", "pos", "exterior")


@Q.add("is_multiloop", f"with {SHAPES}, {SITES}, {ROLE} select structure, pos, multiloop from ro where sym = '.'")
def _(t):
    return structure.site_features(t.shapes).where("sym = '.'").select("structure", "pos", "multiloop")


COARSE = """kept as (select a.structure, a.pos, case a.sym when '.' then '_' when '(' then '[' else ']' end as c from x a left join x b on b.structure = a.structure and b.pos = a.pos - 1
  where b.sym is null or b.sym <> a.sym or (a.sym <> '.' and abs(a.partner - b.partner) > 1)), cg as (select structure, string_agg(c, '' order by pos) as coarse from kept group by structure)"""


@Q.add("coarse_grain", f"with {SHAPES}, {SITES}, {COARSE} select structure, coarse from cg")
def _(t):
    return structure.coarse_grain(t.shapes)


@Q.add("coarse_grain_high", f"""with {SHAPES}, {SITES}, {COARSE}, inner_s as (select distinct translate(replace(coarse, '_', ''), '[]', '()') as structure from cg),
s2 as (select structure, cast(p as int) as pos, substr(structure, cast(p as int) + 1, 1) as sym from inner_s, range(0, 60) as r(p) where p < length(structure)),
d2 as (select *, cast(sum(case sym when '(' then 1 else -1 end) over (partition by structure order by pos) as int) as run from s2),
b2 as (select o.structure, o.pos as i, min(c.pos) as j from d2 o join d2 c on c.structure = o.structure and c.pos > o.pos and c.sym = ')' and c.run = o.run - 1 where o.sym = '(' group by 1, 2),
p2 as (select structure, i as pos, j as partner from b2 union all select structure, j, i from b2), x2 as (select s2.*, partner from s2 join p2 using (structure, pos)),
k2 as (select a.structure, a.pos, case a.sym when '(' then '[' else ']' end as c from x2 a left join x2 b on b.structure = a.structure and b.pos = a.pos - 1 where b.sym is null or b.sym <> a.sym or abs(a.partner - b.partner) > 1),
g2 as (select structure, string_agg(c, '' order by pos) as high from k2 group by structure)
select cg.structure, g2.high as coarse_high from cg join g2 on g2.structure = translate(replace(cg.coarse, '_', ''), '[]', '()')""")
def _(t):
    return structure.coarse_grain_high(t.shapes)


@Q.add("count_pairs", f"with {SHAPES} select structure, cast(len(list_filter(string_split(structure, ''), lambda c: c = '(')) as bigint) as pairs from shapes")
def _(t):
    return t.shapes.select("structure", structure.count_pairs(F.col("structure")).cast("long").alias("pairs"))


STACKS = f"with {SHAPES}, {SITES}, {COARSE}, cs as (select structure, cast(len(list_filter(string_split(coarse, ''), lambda c: c = '[')) as bigint) as stacks from cg)"


@Q.add("count_stacks", f"{STACKS} select * from cs")
def _(t):
    return structure.coarse_grain(t.shapes).select("structure", structure.count_stacks(F.col("coarse")).cast("long").alias("stacks"))


@Q.add("has_inner_loop", f"{STACKS} select structure, stacks - 1 as inner_loops from cs")
def _(t):
    return structure.coarse_grain(t.shapes).select("structure", (structure.count_stacks(F.col("coarse")) - 1).cast("long").alias("inner_loops"))


@Q.add("structure_shape_class", f"with {SHAPES}, {SITES}, {ROLE} select structure, case when bool_or(role = 'bulge') then 'bulge' when bool_or(role = 'internal loop') then 'internal' else 'stack' end || ' ' || cast(count_if(sym = '(') as varchar) as shape from ro group by structure")
def _(t):
    return structure.shape_class(structure.site_features(t.shapes))


@Q.add("seq_fits_structure", f"with {MAP}, shapes as (select structure from st), {SITES}, f as (select m.code, m.structure, bool_and((cast((code >> cast(2*(12-i) as int)) & 3 as int), cast((code >> cast(2*(12-j) as int)) & 3 as int)) in ((0, 2), (2, 0), (3, 1), (1, 3), (3, 2), (2, 3))) as fits from m join bp using (structure) group by all) select * from f")
def _(t):
    arrays = structure.pair_arrays(t.structures)
    rows = t.gpmap.join(arrays, "structure")
    return rows.select("code", "structure", codec.fits(codec.code_to_seq(F.col("code"), L), F.col("pairs")).alias("fits"))


@Q.add("distinct_structures", f"with {MAP} select distinct structure from m")
def _(t):
    return t.gpmap.select("structure").distinct()


@Q.add("dedupe_structures", f"with {SHAPES} select structure from shapes where length(structure) - length(replace(structure, '(', '')) = 3")
def _(t):
    return t.shapes.select("structure").distinct().where(structure.count_pairs(F.col("structure")) == 3)


