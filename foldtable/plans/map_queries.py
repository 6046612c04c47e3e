"""Queries on maps, ensembles, components and epistasis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wide_codec
from ..functions.codec import BASES, base_at, code_to_structure, structure_to_code
from ..operators import components, ensemble, epistasis, folding, mutant_folding, mutate, structure, summary
from ..operators.structure_space import enumerate_structures
from ..sources import tables
from .define import Queries
from .fixtures import CODES, ENSEMBLE, MAP, UNFOLDED, L, mix_sql
from .structure_queries import SITES, STACK

Q = Queries()
#: Walks for each structure, their steps, and how many steps there are for each that is kept: those of the survey.
WALKS, STEPS, EVERY = 5, 10_000, 100
QUERIES, ORACLE_SQL = Q.queries, Q.sql

KT = repr(ensemble.KT)
STABLE = f"""{ENSEMBLE}, rk as (select *, row_number() over (partition by code order by energy, structure) as n, min(energy) over (partition by code) as low from e),
sb as (select code, max(case when n = 1 then structure end) as structure, min(energy) as mfe, max(case when n = 2 then energy end) - min(energy) as energy_gap, 1 / sum(exp((low - energy) / {KT})) as p from rk group by code),
stab as (select code, structure, mfe, energy_gap, case when abs(1 - p) < 1e-8 then 'infinity'::double else {KT} * ln(p / (1 - p)) end as dg_boltz from sb)"""
DDG = f"""{STABLE}, mn as (select s.*, cast(p as int) as pos, cast(b as int) as new_base, code + cast(b - ((code >> cast(2*(12-p) as int)) & 3) as bigint) * (1::bigint << cast(2*(12-p) as int)) as mutant
  from stab s, range(5, 13) r(p), range(0, 4) q(b) where b <> ((code >> cast(2*(12-p) as int)) & 3) and structure <> '{UNFOLDED}'),
pr as (select code, structure, energy, exp((low - energy) / {KT}) / sum(exp((low - energy) / {KT})) over (partition by code) as p from rk),
dd as (select n.code, n.structure, n.pos, n.new_base, n.mutant,
  case when m.structure = n.structure then m.energy_gap - n.energy_gap when h.energy is not null then m.mfe - h.energy - n.energy_gap else '-infinity'::double end + 0.0 as ddg_gap,
  case when m.structure = n.structure then m.dg_boltz - n.dg_boltz when h.energy is not null then (case when abs(1 - h.p) < 1e-8 then 'infinity'::double else {KT} * ln(h.p / (1 - h.p)) end) - n.dg_boltz else '-infinity'::double end + 0.0 as ddg_boltz,
  case when m.structure = n.structure then m.mfe - n.mfe when h.energy is not null then h.energy - n.mfe else 'infinity'::double end + 0.0 as d_mfe
  from mn n join stab m on m.code = n.mutant left join pr h on h.code = n.mutant and h.structure = n.structure)"""


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


def stable(t):
    return ensemble.stability(t.ensemble)


def effects(t):
    """Stored sides lie in buckets of the code, so only mutants travel."""
    stored = by_code(t, t.ensemble)
    return ensemble.ddg_table(by_code(t, ensemble.stability(stored)), stored, L, UNFOLDED)


def by_code(t, df):
    return tables.bucketed(df, "code", int(t.spark.conf.get("spark.sql.shuffle.partitions")))


@Q.add("enumerate_sequences", f"with {CODES}, top as (select max(code) + 1 as n from g) select code, code in (select code from g) as used from (select unnest(range(n)) as code from top) u")
def _(t):
    # All codes up to the largest that the map uses; the id of a range is the code.
    top = t.g.agg(F.max("code")).first()[0]
    used = t.g.select("code", F.lit(True).alias("used"))
    return t.spark.range(top + 1).withColumnRenamed("id", "code").join(used, "code", "left").select("code", F.coalesce("used", F.lit(False)).alias("used"))


@Q.add("mfe_structure", f"with {STABLE} select code, structure, mfe from stab")
def _(t):
    return stable(t).select("code", "structure", "mfe")


@Q.add("mfe", f"with {ENSEMBLE} select code, min(energy) as mfe from e group by code")
def _(t):
    return t.ensemble.groupBy("code").agg(F.min("energy").alias("mfe"))


@Q.add("energy_gap", f"with {STABLE} select code, round(energy_gap, 6) as energy_gap from stab")
def _(t):
    return rounded(stable(t).select("code", "energy_gap"), "energy_gap")


@Q.add("stability_boltzmann", f"with {STABLE} select code, round(dg_boltz, 6) as dg_boltz from stab")
def _(t):
    return rounded(stable(t).select("code", "dg_boltz"), "dg_boltz")


@Q.add("boltzmann_probability", f"with {DDG} select code, structure, round(p, 6) as p from pr")
def _(t):
    return rounded(ensemble.probabilities(t.ensemble).select("code", "structure", "p"), "p")


@Q.add("structures_in_range", f"with {STABLE} select code, structure, energy from rk where energy - low <= 1.5 + 1e-9")
def _(t):
    return ensemble.structures_in_range(t.ensemble, 1.5)


@Q.add("energy_of_pair", f"with {ENSEMBLE} select m.code, m.structure, coalesce(e.energy, 'infinity'::double) as energy from m left join e using (code, structure)")
def _(t):
    return ensemble.energy_of_pair(t.gpmap.select("code", "structure"), t.ensemble)


for _name in ("ddg_gap", "ddg_boltz", "d_mfe"):
    _key = {"ddg_gap": "ddg_gap", "ddg_boltz": "ddg_boltzmann", "d_mfe": "delta_mfe"}[_name]
    Q.add(_key, f"with {DDG} select code, pos, new_base, round({_name}, 6) + 0.0 as {_name} from dd")(lambda t, c=_name: rounded(effects(t).select("code", "pos", "new_base", c), c))


@Q.add("ddg_table", f"with {DDG} select code, structure, pos, new_base, mutant, round(ddg_gap, 6) + 0.0 as ddg_gap, round(ddg_boltz, 6) + 0.0 as ddg_boltz, round(d_mfe, 6) + 0.0 as d_mfe from dd")
def _(t):
    return rounded(effects(t), "ddg_gap", "ddg_boltz", "d_mfe")


@Q.add("map_unique", f"with {STABLE} select code, case when structure <> '{UNFOLDED}' and coalesce(abs(energy_gap) > 1e-6, false) then structure else '{UNFOLDED}' end as structure from stab")
def _(t):
    kept = ensemble.maps(stable(t), UNFOLDED)
    return kept.select("code", F.when(F.col("is_unique"), F.col("structure")).otherwise(UNFOLDED).alias("structure"))


@Q.add("map_fifty", f"with {STABLE} select code, case when structure <> '{UNFOLDED}' and dg_boltz > 0 then structure else '{UNFOLDED}' end as structure from stab")
def _(t):
    kept = ensemble.maps(stable(t), UNFOLDED)
    return kept.select("code", F.when(F.col("is_fifty"), F.col("structure")).otherwise(UNFOLDED).alias("structure"))


@Q.add("quantity_selector", f"with {DDG} select code, pos, new_base, 'energygap' as quantity, round(ddg_gap, 6) + 0.0 as ddg from dd union all select code, pos, new_base, 'Boltzmann_based', round(ddg_boltz, 6) + 0.0 from dd union all select code, pos, new_base, 'free_energy', round(d_mfe, 6) + 0.0 from dd")
def _(t):
    # All three from one join: a mutant's row becomes three only when it has its effects.
    each = [F.struct(F.lit(quantity).alias("quantity"), (F.round(ddg, 6) + 0.0).alias("ddg")) for quantity, (_, ddg, _) in ensemble.QUANTITIES.items()]
    return effects(t).select("code", "pos", "new_base", F.inline(F.array(*each)))


# Structures of `shapes` that have a pair, and none alone.
PAIRED_RUNS = f"{SITES}, {STACK}, ok as (select structure from sl group by structure having min(stack_length) > 1)"
VALID = f"shapes as (select structure from st where structure like '%(%'), {PAIRED_RUNS}"


def grown_sql(lengths: str) -> str:
    """`shapes`, all balanced strings of the lengths n of a table with three unpaired sites at least in a hairpin: prefixes grow by a symbol."""
    return f"""px(n, s, open, since) as (select n, '', 0, 9 from ({lengths}) u union all
  select n, s || c, open + o, case c when '(' then 0 when ')' then 9 else least(since + 1, 9) end from px, (values ('.', 0), ('(', 1), (')', -1)) t(c, o)
  where length(s) < n and (c <> ')' or (open > 0 and since >= 3)) and open + o <= n - length(s) - 1),
shapes as (select s as structure from px where length(s) = n and s like '%(%')"""


EDGES = """ed as materialized (select a.structure, a.code as code_a, b.code as code_b from mu a join m b on b.code = a.mutant and b.structure = a.structure)"""
NC = MAP + f""", {EDGES}, cc(code, label) using key (code) as (select code, code from m union (select e.code_b, min(c.label) from cc c join ed e on e.code_a = c.code join recurring.cc r on r.code = e.code_b where c.label < r.label group by e.code_b)),
nc as materialized (select m.code, m.structure, cc.label as nc_id, m.stability, m.mfe from m join cc using (code))"""
NC = "recursive " + NC


@Q.add("neutral_edges", f"with {MAP}, {EDGES} select * from ed where code_a < code_b")
def _(t):
    return components.neutral_edges(t.gpmap, L)


def labelled(t):
    return components.neutral_components(t.kept_map, L)


@Q.add("neutral_components", f"with {NC} select code, structure, nc_id from nc")
def _(t):
    return labelled(t)


@Q.add("nc_sizes", f"with {NC} select nc_id, count(*) as nc_size from nc group by nc_id")
def _(t):
    return labelled(t).groupBy("nc_id").agg(F.count("*").alias("nc_size"))


@Q.add("nc_structure", f"with {NC} select nc_id, min(structure) as structure from nc group by nc_id")
def _(t):
    return labelled(t).groupBy("nc_id").agg(F.any_value("structure").alias("structure"))


@Q.add("attach_columns", f"with {NC} select code, structure, nc_id, stability, mfe, count(*) over (partition by structure) as neutral_set_size from nc")
def _(t):
    return summary.attach(by_code(t, t.gpmap), by_code(t, labelled(t)))


@Q.add("sequence_summary", f"with {NC}, {VALID} select code, structure, nc_id, count(*) over (partition by nc_id) as nc_size, stability, count(*) over (partition by structure) as neutral_set_size, mfe from nc join ok using (structure)")
def _(t):
    folded = structure.keep_valid(t.kept_map, t.structures)
    return summary.sequence_summary(folded, components.neutral_components(folded, L))


# Sequences of 40 sites: of every five, the middle one is a varying site of the map.
WIDE = 40


def wide_sql(code: str) -> str:
    return f"array_to_string(list_transform(range(8), lambda k: 'AA' || substr('ACUG', cast(({code} >> cast(2*(7-k) as int)) & 3 as int) + 1, 1) || 'AA'), '')"


def wide(code):
    parts = [x for k in range(8) for x in (F.lit("AA"), F.substring(F.lit(BASES), F.call_function("shiftright", code, F.lit(2 * (7 - k))).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)), F.lit("AA"))]
    return wide_codec.seq_to_code(F.concat(*parts))


def wide_seq(code):
    return wide_codec.code_to_seq(code, WIDE)


@Q.add("wide_neighbours", f"with {CODES}, a as (select {wide_sql('code')} as seq from g), b as (select seq, cast(p as int) as pos, x from a, (values (2), (37)) r(p), (values ('A'), ('C'), ('U'), ('G')) q(x)) select seq, pos, substr(seq, 1, pos) || x || substr(seq, pos + 2) as mutant from b where substr(seq, pos + 1, 1) <> x")
def _(t):
    seqs = t.g.select(wide(F.col("code")).alias("code"))
    rows = mutate.point_neighbours(seqs, WIDE, F.lit(2), wide_codec).unionByName(mutate.point_neighbours(seqs, WIDE, F.lit(37), wide_codec))
    return rows.select(wide_seq(F.col("code")).alias("seq"), "pos", wide_seq(F.col("mutant")).alias("mutant"))


@Q.add("wide_hamming", f"with {CODES}, a as (select code, {wide_sql('code')} as x, {wide_sql('(code * 7919 % 65536)')} as y from g) select code, cast(len(list_filter(range(1, 41), lambda k: substr(x, cast(k as int), 1) <> substr(y, cast(k as int), 1))) as bigint) as distance from a")
def _(t):
    return t.g.select("code", wide_codec.hamming(wide(F.col("code")), wide(F.col("code") * 7919 % 65536)).cast("long").alias("distance"))


@Q.add("wide_components", f"with {NC} select {wide_sql('code')} as seq, structure, {wide_sql('nc_id')} as nc_seq from nc")
def _(t):
    seqs = t.kept_map.select(wide(F.col("code")).alias("code"), "structure")
    found = components.neutral_components(seqs, WIDE, wide_codec)
    return found.select(wide_seq(F.col("code")).alias("seq"), "structure", wide_seq(F.col("nc_id")).alias("nc_seq"))


NCD = NC + ", md as (select nc.nc_id, b.stability - a.stability as ddg from mu a join m b on b.code = a.mutant join nc on nc.code = a.code)"


def map_effects(t):
    """Change of stored stability from each sequence to each of its mutants in the map."""
    return changes(t.gpmap, ["structure", "stability"])


def changes(rows, held):
    return mutate.site_mutants(rows, L, held).withColumn("ddg", F.col("m_stability") - F.col("stability"))


STATS = "count(*) as size, max(stability) as max_dg, round(avg(stability), 6) as mean_dg"


@Q.add("nc_stability_table", f"with {NCD}, {VALID}, a as (select nc_id, min(structure) as structure, {STATS} from nc join ok using (structure) group by nc_id), b as (select nc_id, round(quantile_cont(abs(ddg), 0.25), 6) as lower_quartile_abs_ddg from md group by nc_id) select a.*, b.lower_quartile_abs_ddg from a left join b using (nc_id)")
def _(t):
    # Components of valid structures; the mutants that effects lead to may have any.
    valid = components._kept(structure.keep_valid(t.kept_map, t.structures))
    rows = components._kept(valid.join(components.neutral_components(valid, L).select("code", "nc_id"), "code"))
    placed = t.kept_map.select("code", "stability").join(rows.select("code", "nc_id"), "code", "left")
    table = summary.stability_table(rows, "nc_id", mutate.site_differences(placed, L, "nc_id", "stability").where("nc_id is not null"))
    named = rows.groupBy("nc_id").agg(F.any_value("structure").alias("structure"))
    return rounded(table.join(named, "nc_id"), "mean_dg", "lower_quartile_abs_ddg")


SETS = f"with {MAP}, md as (select a.structure, b.stability - a.stability as ddg from mu a join m b on b.code = a.mutant)"


@Q.add("set_stability_table", f"{SETS}, {VALID}, a as (select structure, {STATS} from m join ok using (structure) group by structure), b as (select structure, round(quantile_cont(abs(ddg), 0.25), 6) as lower_quartile_abs_ddg from md group by structure) select a.*, b.lower_quartile_abs_ddg from a left join b using (structure)")
def _(t):
    coded = t.kept_map.withColumn("k", structure_to_code(F.col("structure")))
    table = summary.stability_table(structure.keep_valid(coded, t.structures), "k", mutate.site_differences(coded, L, "k", "stability"))
    return rounded(table.withColumn("structure", code_to_structure(F.col("k"))).drop("k"), "mean_dg", "lower_quartile_abs_ddg")


@Q.add("neutral_set_sizes", f"with {MAP} select structure, count(*) as size from m group by structure")
def _(t):
    return summary.neutral_set_sizes(t.gpmap)


@Q.add("site_versatility", f"with {MAP}, h as (select a.code, a.p as pos, count(*) as n from mu a join m b on b.code = a.mutant and b.structure = a.structure group by all) select m.code, m.structure, cast(r.p as int) as pos, round(coalesce(h.n, 0) / 3.0, 6) as versatility from m cross join range(0, 13) r(p) left join h on h.code = m.code and h.pos = r.p")
def _(t):
    return rounded(components.site_versatility(t.gpmap, L), "versatility")


@Q.add("attach_mutant", f"with {MAP} select a.code, b.code as mutant, b.structure as mutant_structure, b.stability as mutant_stability from mu a join m b on b.code = a.mutant")
def _(t):
    return map_effects(t).select("code", "mutant", F.col("m_structure").alias("mutant_structure"), F.col("m_stability").alias("mutant_stability"))


@Q.add("nc_graph_export", f"with {NC}, big as (select nc_id from nc group by nc_id order by count(*) desc, nc_id limit 1) select 'node' as kind, code as a, null::bigint as b, round(stability, 1) as dg from nc where nc_id = (select nc_id from big) union all select 'edge', code_a, code_b, null from ed where code_a < code_b and code_a in (select code from nc where nc_id = (select nc_id from big))")
def _(t):
    nc = labelled(t)
    big = nc.groupBy("nc_id").count().orderBy(F.desc("count"), "nc_id").limit(1).select("nc_id")
    mine = nc.join(F.broadcast(big), "nc_id")  # one row
    nodes = t.gpmap.join(mine.select("code"), "code").select(F.lit("node").alias("kind"), F.col("code").alias("a"), F.lit(None).cast("long").alias("b"), F.round("stability", 1).alias("dg"))
    edges = components.neutral_edges(mine, L).select(F.lit("edge").alias("kind"), F.col("code_a").alias("a"), F.col("code_b").alias("b"), F.lit(None).cast("double").alias("dg"))
    return nodes.unionByName(edges)


@Q.add("nearest_size_nc", f"with {NC}, z as (select nc_id, min(structure) as structure, count(*) as size from nc group by nc_id), r as (select *, length(structure) - length(replace(structure, '(', '')) as pairs, row_number() over (partition by length(structure) - length(replace(structure, '(', '')) order by abs(size - 500), nc_id) as n from z) select pairs, nc_id, size from r where n = 1")
def _(t):
    sizes = labelled(t).groupBy("nc_id").agg(F.count("*").alias("size"), F.any_value("structure").alias("structure"))
    pairs = structure.count_pairs(F.col("structure")).cast("long").alias("pairs")
    best = sizes.groupBy(pairs).agg(F.min_by(F.struct("nc_id", "size"), F.struct(F.abs(F.col("size") - 500), "nc_id")).alias("b"))
    return best.select("pairs", "b.nc_id", "b.size")


# Neutral mutants first, then pairs of them at two sites, then the double mutant: each step a join on equal keys.
SQUARES = NC + """, nm as materialized (select a.nc_id, a.code, cast(i as int) as pos, b.code as mutant from nc a cross join range(5, 13) r(i) cross join range(1, 4) x(x) join nc b on b.code = xor(a.code, cast(x as bigint) << cast(2*(12-i) as int)) and b.nc_id = a.nc_id),
tw as materialized (select a.nc_id, a.pos as pos1, b.pos as pos2, a.code as g1, a.mutant as g2, b.mutant as g3, xor(xor(a.mutant, b.mutant), a.code) as g4 from nm a join nm b on b.code = a.code and b.pos > a.pos),
cs as materialized (select tw.* from tw join nc d on d.code = tw.g4 and d.nc_id = tw.nc_id),
sq as (select cs.*, a.stability as s1, b.stability as s2, c.stability as s3, d.stability as s4 from cs join nc a on a.code = g1 join nc b on b.code = g2 join nc c on c.code = g3 join nc d on d.code = g4)"""


def members(t, valid: bool = False):
    """nc_id, code and both stored energies; computed once and kept. valid: of valid structures alone."""
    found = labelled(t)
    return components._kept((structure.keep_valid(found, t.structures) if valid else found).select("nc_id", "code").join(t.kept_map.select("code", F.col("stability").alias("energy"), "mfe"), "code"))


@Q.add("epistasis_squares", f"with {SQUARES} select nc_id, cast(pos1 as bigint) as pos1, cast(pos2 as bigint) as pos2, g1, g2, g3, g4 from sq")
def _(t):
    found = epistasis.squares(members(t), L)
    return found.select("nc_id", F.col("pos1").cast("long").alias("pos1"), F.col("pos2").cast("long").alias("pos2"), "g1", "g2", "g3", "g4")


@Q.add("epistasis_present", f"with {SQUARES} select g1, g4, g2, abs(s1 + s4 - s2 - s3) > 0.099 as present from sq")
def _(t):
    present = epistasis.epistasis_present(*[F.col(f"s{k}") for k in (1, 4, 2, 3)])
    return epistasis.squares(members(t), L).select("g1", "g4", "g2", present.alias("present"))


BIG = "(abs(s2 - s1) > 0.099 and abs(s3 - s1) > 0.099)"


@Q.add("epistasis_fraction", f"with {SQUARES} select nc_id, round(avg(cast(abs(s1 + s4 - s2 - s3) > 0.099 as int)), 6) as fraction, round(count_if({BIG} and abs(s1 + s4 - s2 - s3) > 0.099) / nullif(count_if({BIG}), 0), 6) as fraction_nonzero from sq group by nc_id")
def _(t):
    return rounded(epistasis.epistasis_fractions(members(t), L), "fraction", "fraction_nonzero")


SHUFFLED = f"""sh as materialized (select a.nc_id, a.code, b.stability from (select nc_id, code, row_number() over (partition by nc_id order by code) as n from nc) a
  join (select nc_id, stability, row_number() over (partition by nc_id order by {mix_sql('code', 3)}, code) as n from nc) b using (nc_id, n))"""


def shuffled(rows):
    from ..operators.sampling import mix

    return epistasis.shuffle_within_group(rows, mix(F.col("code"), 3))


@Q.add("shuffle_within_group", f"with {NC}, {SHUFFLED} select nc_id, code, stability as energy from sh")
def _(t):
    return shuffled(members(t))


def square_share(table: str, value: str, name: str) -> str:
    one, other, both = (f"abs({x})" for x in (f"b.{value} - a.{value}", f"c.{value} - a.{value}", f"a.{value} + d.{value} - b.{value} - c.{value}"))
    return f"""select cs.nc_id, '{name}' as landscape, round(avg(cast({both} > 0.099 as int)), 6) as fraction,
  round(count_if({one} > 0.099 and {other} > 0.099 and {both} > 0.099) / nullif(count_if({one} > 0.099 and {other} > 0.099), 0), 6) as nonzero
  from cs join {table} a on a.code = g1 join {table} b on b.code = g2 join {table} c on c.code = g3 join {table} d on d.code = g4 group by cs.nc_id"""


_ALL = " union all ".join(square_share(*x) for x in (("nc", "stability", "stability"), ("nc", "mfe", "mfe"), ("sh", "stability", "shuffled")))


@Q.add("epistasis_table", f"with {SQUARES}, {SHUFFLED}, {VALID}, al as materialized ({_ALL}), vn as (select distinct nc_id from nc join ok using (structure)) select nc_id, landscape, false as ignore_zero, fraction from al join vn using (nc_id) union all select nc_id, landscape, true, nonzero from al join vn using (nc_id)")
def _(t):
    rows = members(t, valid=True)
    stored, other = rows.select("nc_id", "code", "energy"), rows.select("nc_id", "code", F.col("mfe").alias("energy"))
    return rounded(epistasis.epistasis_table({"stability": stored, "mfe": other, "shuffled": shuffled(stored)}, L), "fraction")


@Q.add("coverage_check", f"with recursive {MAP}, {grown_sql('select 13 as n')}, {PAIRED_RUNS} select distinct structure from m where structure not in (select structure from ok)")
def _(t):
    # What the map has that the enumeration lacks: the unfolded structure alone is expected.
    return folding.not_enumerated(t.gpmap, L)


@Q.add("enumerate_structures", f"with recursive {grown_sql('select distinct 10 + p_size % 6 as n from part')}, {PAIRED_RUNS} select structure from ok")
def _(t):
    lengths = sorted(r.n for r in t.raw("part").select((10 + F.col("p_size") % 6).alias("n")).distinct().collect())  # six at most
    return reduce(DataFrame.unionByName, [enumerate_structures(t.spark, n) for n in lengths])


def small(t):
    """The sequences of the map that order keys name: whole map, whole fold."""
    return t.g.select("code"), folding.structure_list(enumerate_structures(t.spark, L), L)


def energy_sql() -> str:
    """`fe`: code, structure and energy of every structure of `ok` that a sequence of `g` can form, by its pairs, stacks and loops."""
    base = lambda pos: f"cast((code >> cast(2*(12-({pos})) as int)) & 3 as int)"
    stacks = ", ".join(f"({BASES.index(x)}, {BASES.index(y)}, {e})" for (x, y), e in folding.STACKS.items())
    pairs = ", ".join(map(str, sorted(folding.PAIRED)))
    return f"""vb as materialized (select bp.* from bp join ok using (structure)),
par as (select q.structure, q.i, q.j, max(p.i) as up from vb q join vb p on p.structure = q.structure and p.i < q.i and p.j > q.j group by q.structure, q.i, q.j),
ch as materialized (select vb.structure, vb.i, vb.j, count(par.i) as kids, coalesce(bool_or(par.i = vb.i + 1 and par.j = vb.j - 1), false) as nested from vb left join par on par.structure = vb.structure and par.up = vb.i group by vb.structure, vb.i, vb.j),
se(x, z, e) as (values {stacks}),
pe as (select code, structure, {base("i")} as x, {base("j")} as y, {base("i + 1")} as z, {base("j - 1")} as w, kids = 1 and nested as stacked,
  case when kids = 0 then {folding.HAIRPIN} when kids > 1 then {folding.MULTI} when nested then 0.0 else {folding.INNER} end as loop from g, ch),
fe as (select code, structure, round(cast(sum(loop + case when not stacked then 0.0 when xor(x, 2) = y and xor(z, 2) = w then e else {folding.WOBBLE} end) as double), 2) as energy
  from pe left join se using (x, z) group by code, structure having bool_and((x, y) in ({pairs}))
  union all select code, '{UNFOLDED}', 0.0 from g)"""


@Q.add("fold_by_enumeration", f"with recursive {CODES}, {grown_sql('select 13 as n')}, {PAIRED_RUNS}, {energy_sql()} select code, structure, energy + 0.0 as energy from fe")
def _(t):
    seqs, structures = small(t)
    return folding.fold_by_enumeration(seqs, structures).withColumn("energy", F.col("energy") + 0.0)


#: Sites of long sequences; there are 760,982 structures of that many.
LONG = 30


@Q.add("long_sequence_effects")
def _(t):
    from ..operators.sampling import random_sequences

    # Rows are few bytes and much work each, so their number of tasks is not left to their size.
    tasks = max(4 * t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    ids = t.raw("orders").select(F.col("o_orderkey").alias("id")).repartition(tasks, "id")
    dealt = random_sequences(ids, LONG, 5).select("code").distinct().repartition(tasks, "code")
    # A row for each sequence, with an array of its effects, until features are joined.
    rows = components._kept(mutant_folding.mutant_effects(dealt, LONG, 0.001).select("code", "structure", "ddg_gap"))
    # Features of the structures that occur, not of all there are.
    features = structure.site_features(rows.select("structure").repartition(tasks, "structure"))
    sites = features.groupBy("structure").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("role", "place", "element_length")))).alias("sites"))
    rows = rows.join(sites.hint("merge"), "structure").select("code", "structure", "sites", F.posexplode("ddg_gap").alias("k", "ddg"))
    rows = summary.finite_effects(rows).withColumns({"pos": F.expr("k div 3").cast("int"), "turn": F.col("k") % 3 + 1})
    new_base = base_at(F.col("code"), F.col("pos"), LONG).bitwiseXOR(F.col("turn"))
    mutation = F.concat("pos", F.substring(F.lit(BASES), new_base.cast("int") + 1, F.lit(1)))
    return rows.withColumn("site", F.col("sites")[F.col("pos")]).select("code", "structure", "site.role", "site.place", "site.element_length", mutation.alias("mutation"), "ddg")


def walks(t):
    """The survey's walks, from random sequences of all sites that fold, and the structures of their length."""
    from ..operators.sampling import random_sequences, sample_per_group

    structures = folding.structure_list(enumerate_structures(t.spark, L), L)
    seqs = random_sequences(t.g.select(F.col("code").alias("id")), L, 11).select("code").distinct()
    starts = sample_per_group(components._kept(stable_folded(t, seqs, structures)), "structure", "code", WALKS, 3)
    return folding.neutral_walks(starts.repartition(t.spark.sparkContext.defaultParallelism, "code", "draw"), structures, STEPS, EVERY, 3), structures


@Q.add("neutral_walk")
def _(t):
    return walks(t)[0]


@Q.add("walk_chain")
def _(t):
    # Walks, then the effects of all mutations of what they sampled, then summaries in both forms.
    found, structures = walks(t)
    samples = components._kept(found.select("structure", F.col("walked").alias("code")))
    effects_of = components._kept(folding.sequence_effects(samples.select("code").distinct(), structures))
    stability = effects_of.groupBy("code").agg(F.first("energy_gap").alias("stability"))
    drawn, changed = samples.join(stability, "code"), samples.join(effects_of.drop("structure"), "code")
    forms = {"energygap": ("ddg_gap", True), "free_energy": ("d_mfe", False)}
    parts = [summary.walk_summary(drawn, changed.withColumn("ddg", F.col(c)), "structure", only).withColumn("form", F.lit(form)) for form, (c, only) in forms.items()]
    return rounded(parts[0].unionByName(parts[1]), "dg", "fraction_dg_zero", "lower_quartile_ddg", "median_ddg")


def stable_folded(t, seqs, structures):
    folds = ensemble.stability(folding.fold_by_enumeration(seqs, structures))
    return folds.where(F.col("structure") != UNFOLDED).select("structure", "code")
