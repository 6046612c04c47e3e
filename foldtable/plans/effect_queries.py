"""Queries on effects by structural role, samples, the additive model and result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import additive, components, ensemble, mutate, sampling, structure, summary
from ..sources import tables
from .define import Queries
from .fixtures import MAP, SHAPES, UNFOLDED, L, draw_sql, mix_sql
from .map_queries import DDG, PAIRED_RUNS, by_code, effects, map_effects, rounded
from .structure_queries import COARSE, LOOP, ROLE, SITES, STACK

Q = Queries()
QUERIES, ORACLE_SQL = Q.queries, Q.sql

# Effects with the role of their site: of stored stabilities, whose structures are in `st`.
MD = f"""{MAP}, md as materialized (select a.code, a.structure, cast(p as int) as pos, b.structure = a.structure as kept, round(b.stability - a.stability, 6) + 0.0 as ddg from mu a join m b on b.code = a.mutant),
shapes as (select structure from st where sid < 6), {SITES}, {STACK}, {LOOP}, {ROLE},
el as materialized (select structure, i as pos, stack_length as element_length from sl union all select structure, j, stack_length from sl union all select * from lp),
er as materialized (select md.code, md.structure, md.pos, md.ddg, ro.role, ro.place, el.element_length from md join ro using (structure, pos) join el using (structure, pos))"""


def with_role(t):
    rows = map_effects(t).select("code", "structure", "pos", F.expr("round(ddg, 6) + 0D").alias("ddg"))
    features = structure.site_features(t.structures.where(F.col("structure") != UNFOLDED)).select("structure", "pos", "role", "place", "element_length")
    return rows.join(features, ["structure", "pos"])


def absolute(t):
    return summary.finite_effects(with_role(t))


def box_sql(keys: str, col: str, rows: str) -> str:
    cuts = ", ".join(f"round(quantile_cont({col}, {q}), 6) as p{round(100 * q)}" for q in summary.BOX)
    return f"select {keys}, {cuts} from ({rows}) u group by {keys}"


BOXES = [f"p{round(100 * q)}" for q in summary.BOX]


@Q.add("attach_role", f"with {MD} select code, structure, pos, ddg, role, place, element_length from er")
def _(t):
    return with_role(t)


@Q.add("finite_effects", f"with {DDG} select code, pos, new_base, round(abs(ddg_gap), 6) as ddg from dd where not isinf(ddg_gap) and ddg_gap is not null")
def _(t):
    rows = effects(t).select("code", "pos", "new_base", F.col("ddg_gap").alias("ddg"))
    return rounded(summary.finite_effects(rows), "ddg")


@Q.add("stable_only", f"with {MAP} select code, structure, stability from m where abs(stability) > 0.001")
def _(t):
    return t.gpmap.select("code", "structure", "stability").where(F.abs("stability") > 0.001)


@Q.add("drop_incomplete", f"with {DDG} select * from (select code, case when structure like '((%' then null else energy_gap end as gap, mfe from stab) where gap is not null and mfe is not null")
def _(t):
    from .map_queries import stable

    rows = stable(t).select("code", F.when(~F.col("structure").startswith("(("), F.col("energy_gap")).alias("gap"), "mfe")
    return rows.dropna()


@Q.add("drop_missing_estimate", f"with {MAP} select code, stability from m where stability is not null and stability <> 0")
def _(t):
    return t.gpmap.select("code", "stability").where("stability is not null and stability <> 0")


@Q.add("drop_rare_category", f"with {MD}, c as (select count(*) = 2 and coalesce(min(n) >= 10, false) as keep from (select place, count(*) as n from er where role = 'bulge' group by place) u) select role, place, count(*) as n from er, c where role <> 'bulge' or keep group by all")
def _(t):
    return summary.drop_rare_category(with_role(t), "bulge").groupBy("role", "place").agg(F.count("*").alias("n"))


KNOWN = ["stack", "hairpin loop", "exterior loop"]


@Q.add("known_categories", f"with {MD} select role, cast(case role when 'stack' then 0 when 'hairpin loop' then 1 else 2 end as bigint) as place_in_list, count(*) as n from er where role in ('stack', 'hairpin loop', 'exterior loop') group by 1, 2")
def _(t):
    listed = t.spark.createDataFrame(list(zip(KNOWN, range(3), strict=True)), "role string, place_in_list long")
    return with_role(t).join(F.broadcast(listed), "role").groupBy("role", "place_in_list").agg(F.count("*").alias("n"))  # three rows


# Stabilities that differ by more or less than what counts, other structures, lost values, and rows that only one side has.
@Q.add("reconcile_values", f"""with {MAP}, b as (select code, case when code % 13 = 0 then '{UNFOLDED}' else structure end as structure,
  case when code % 17 <> 0 then stability + case when code % 7 = 0 then 0.5 when code % 3 = 0 then 0.0004 else 0 end end as stability from m where code % 11 <> 0)
select count(*) as rows, count_if(coalesce(abs(a.stability - b.stability) < 1e-3 and a.structure = b.structure, false)) as agree, count_if(a.code is null or b.code is null) as one_sided from m a full join b using (code)""")
def _(t):
    shift = F.when(F.col("code") % 7 == 0, 0.5).when(F.col("code") % 3 == 0, 0.0004).otherwise(0.0)
    computed = t.gpmap.where("code % 11 <> 0").select(
        "code", F.when(F.col("code") % 13 == 0, UNFOLDED).otherwise(F.col("structure")).alias("structure"), F.when(F.col("code") % 17 != 0, F.col("stability") + shift).alias("stability")
    )
    return summary.reconcile(t.gpmap, computed, "code", ["structure", "stability"])


@Q.add("percentile_by_role", f"with {MD} {box_sql('role, place', 'ddg', 'select role, place, abs(ddg) as ddg from er')}")
def _(t):
    return rounded(summary.box_stats(absolute(t), ["role", "place"], "ddg"), *BOXES)


@Q.add("percentile_by_role_length", f"with {MD}, u as (select role, element_length, abs(ddg) as ddg from er union all select role, null, abs(ddg) from er) {box_sql('role, element_length', 'ddg', 'select * from u')}")
def _(t):
    return rounded(summary.box_stats_at_two_levels(absolute(t), "role", "element_length", "ddg"), *BOXES)


@Q.add("zero_fraction_by_role", f"with {MD} select role, round(avg(case when abs(ddg) < 1e-4 then 1.0 else 0.0 end), 6) as zero_fraction from er group by role")
def _(t):
    share = F.avg(F.when(F.abs("ddg") < 1e-4, 1.0).otherwise(0.0))
    return rounded(with_role(t).groupBy("role").agg(share.alias("zero_fraction")), "zero_fraction")


@Q.add("element_length_quartiles", f"with {MD}, a as (select role, place, element_length, count(*) as n, quantile_cont(abs(ddg), 0.25) as l, quantile_cont(abs(ddg), 0.5) as m, quantile_cont(abs(ddg), 0.75) as u from er group by all) select role, place, element_length, n, case when n >= 20 then round(l, 6) end as lower, case when n >= 20 then round(m, 6) end as median, case when n >= 20 then round(u, 6) end as upper from a")
def _(t):
    return rounded(summary.element_length_quartiles(absolute(t)), "lower", "median", "upper")


@Q.add("box_stats", f"with {MD} {box_sql('structure, role', 'ddg', 'select structure, role, abs(ddg) as ddg from er')}")
def _(t):
    return rounded(summary.box_stats(absolute(t), ["structure", "role"], "ddg"), *BOXES)


SIZE_CLASS = "case when role <> 'stack' then role when element_length <= 2 then 'stack 1-2' when element_length <= 4 then 'stack 3-4' else 'stack 5+' end"


@Q.add("stack_size_class", f"with {MD} {box_sql('class', 'ddg', f'select {SIZE_CLASS} as class, abs(ddg) as ddg from er')}")
def _(t):
    rows = absolute(t).withColumn("class", summary.stack_size_class(F.col("role"), F.col("element_length")))
    return rounded(summary.box_stats(rows, ["class"], "ddg"), *BOXES)


CATEGORY = "case when role = 'stack' then 'S' || element_length when role in ('bulge', 'internal loop') then 'B' else 'L' end"


@Q.add("model_category", f"with {MD} select code, structure, pos, {CATEGORY} as category, ddg from er")
def _(t):
    return with_role(t).select("code", "structure", "pos", summary.model_category(F.col("role"), F.col("element_length")).alias("category"), "ddg")


# Effects of point mutations and of pair swaps of 100 draws from each structure, by category; a swap takes the category of its first site.
DRAWS = 100
SAMPLED = f"""{DDG}, shapes as (select structure from st where sid < 6), {SITES}, {STACK}, {LOOP}, {ROLE},
el as materialized (select structure, i as pos, stack_length as element_length from sl union all select structure, j, stack_length from sl union all select * from lp),
rr as materialized (select code, structure, row_number() over (partition by structure order by code) - 1 as rank from stab where structure <> '{UNFOLDED}'),
rs as (select structure, count(*) as n, min(code) as k from rr group by structure),
dr as materialized (select rr.structure, d.draw, rr.code from (select structure, cast(x as bigint) as draw, {draw_sql('k', 'x', 9)} % n as rank from rs, range(1, {DRAWS + 1}) t(x)) d join rr using (structure, rank)),
al(a, b) as (values (0, 2), (2, 0), (3, 1), (1, 3), (3, 2), (2, 3)),
w as (select dr.structure, dr.draw, dr.code, i, j, a, b, cast((code >> cast(2*(12-i) as int)) & 3 as int) as x, cast((code >> cast(2*(12-j) as int)) & 3 as int) as y from dr join bp using (structure), al),
sw as (select w.*, w.code + cast(a - x as bigint) * (1::bigint << cast(2*(12-i) as int)) + cast(b - y as bigint) * (1::bigint << cast(2*(12-j) as int)) as mutant from w where a <> x and b <> y),
ef as materialized (select dr.structure, dr.draw, dr.code, dd.mutant, {CATEGORY} as category, 'point' as kind, round(dd.ddg_gap, 6) + 0.0 as ddg from dr join dd using (code, structure) join ro using (structure, pos) join el using (structure, pos) where not isinf(dd.ddg_gap) union all
  select sw.structure, sw.draw, sw.code, sw.mutant, 'S' || el.element_length, 'bp', round(case when m.structure = sw.structure then m.energy_gap - n.energy_gap when h.energy is not null then m.mfe - h.energy - n.energy_gap else '-infinity'::double end, 6) + 0.0
  from sw join stab n on n.code = sw.code join stab m on m.code = sw.mutant left join pr h on h.code = sw.mutant and h.structure = sw.structure join el on el.structure = sw.structure and el.pos = sw.i)"""


def sampled_effects(t):
    """structure, draw, code, mutant, category, kind, ddg: infinite effects of point mutations are left out, those of pair swaps stay."""
    stored = by_code(t, t.ensemble)
    stab = by_code(t, ensemble.stability(stored))
    folded = t.structures.where(F.col("structure") != UNFOLDED)
    drawn = sampling.sample_per_group(stab.where(F.col("structure") != UNFOLDED).select("structure", "code"), "structure", "code", DRAWS, 9)
    drawn = components._kept(drawn.select("structure", "code", F.col("draw").cast("long").alias("draw")).join(stab.drop("structure"), "code"))
    # Both kinds travel to their mutants together. A swap takes the category of its first site, which is in a stack.
    point = mutate.point_neighbours(drawn, L).select(*drawn.columns, "pos", "mutant", F.lit("point").alias("kind"))
    swaps = mutate.bp_double_mutants(drawn, structure.base_pairs(folded), L).select(*drawn.columns, F.col("i").alias("pos"), "mutant", F.lit("bp").alias("kind"))
    rows = ensemble.with_effects(point.unionByName(swaps), stab, stored).where((F.col("kind") == "bp") | summary.finite(F.col("ddg_gap")))
    features = structure.site_features(folded).select("structure", "pos", "role", "element_length")
    category = summary.model_category(F.col("role"), F.col("element_length")).alias("category")
    return rows.join(features, ["structure", "pos"]).select("structure", "draw", "code", "mutant", category, "kind", F.expr("round(ddg_gap, 6) + 0D").alias("ddg"))


@Q.add("p_sampled_effects", f"with {SAMPLED} select * from ef")
def _(t):
    return sampled_effects(t)


# Infinite effects take part as the largest: between two values of which one is infinite lies infinity.
def _quantile_sql(x: str, q: float) -> str:
    cut = f"quantile_cont({x}, {q})"
    return f"case when {cut} > 1e200 then 'infinity'::double else round({cut}, 6) end"


_SIZE = "least(abs(ddg), 1e300)"
PARAMETERS = ", ".join(f"{_quantile_sql(f'case when kind = {chr(39)}point{chr(39)} then {_SIZE} end', q)} as point_{n}, {_quantile_sql(_SIZE, q)} as swaps_{n}" for n, q in (("lower", 0.25), ("median", 0.5), ("upper", 0.75)))
NAMES = [f"{k}_{n}" for k in ("point", "swaps") for n in ("lower", "median", "upper")]


@Q.add("model_parameters", f"with {SAMPLED} select category, {PARAMETERS} from ef group by category")
def _(t):
    return rounded(summary.model_parameters(sampled_effects(t)), *NAMES)


@Q.add("lookup_model_params", f"with {SAMPLED}, p as (select category, {PARAMETERS} from ef group by category) select category, k like 'swaps%' as swaps, split_part(k, '_', 2) as quantity, impact from (unpivot p on {', '.join(NAMES)} into name k value impact) u")
def _(t):
    return rounded(additive.lookup_params(summary.model_parameters(sampled_effects(t))), "impact")


BELOW, ABOVE = [0.2, 0.4, 0.6, 0.8, 1.0], [-0.8, -0.6, -0.4, -0.2, 0.0]
SHARES = ", ".join([f"round(avg(case when abs(ddg) <= {x} + 0.001 then 1.0 else 0.0 end), 6) as abs_{str(x).replace('.', '_')}" for x in BELOW] + [f"round(avg(case when ddg >= {x} - 0.001 then 1.0 else 0.0 end), 6) as minus_{str(abs(x)).replace('.', '_')}" for x in ABOVE])
SHARE_NAMES = [f"abs_{str(x).replace('.', '_')}" for x in BELOW] + [f"minus_{str(abs(x)).replace('.', '_')}" for x in ABOVE]


@Q.add("threshold_fractions", f"with {DDG} select structure, {SHARES.replace('ddg', 'ddg_gap')} from dd where ddg_gap is not null group by structure")
def _(t):
    rows = effects(t).withColumnRenamed("ddg_gap", "ddg").where("ddg is not null")
    return rounded(summary.threshold_fractions(rows, "structure", BELOW, ABOVE), *SHARE_NAMES)


@Q.add("wide_to_long", f"with {MD}, w as (select structure, {SHARES} from md group by structure) select structure, cast(replace(replace(k, 'abs_', ''), '_', '.') as double) as threshold, fraction from (unpivot w on {', '.join(SHARE_NAMES[:5])} into name k value fraction) u")
def _(t):
    wide = summary.threshold_fractions(map_effects(t).withColumn("ddg", F.round("ddg", 6)), "structure", BELOW, ABOVE)
    long = wide.unpivot("structure", SHARE_NAMES[:5], "name", "fraction")
    number = F.replace(F.regexp_extract("name", r"abs_(\d+_\d+)", 1), F.lit("_"), F.lit(".")).cast("double")
    return rounded(long.select("structure", number.alias("threshold"), "fraction"), "fraction")


@Q.add("walk_summary", f"with {DDG}, a as (select structure, round(avg(case when abs(dg_boltz) > 1e-5 then energy_gap end), 6) as dg, round(avg(case when abs(energy_gap) <= 1e-5 then 1.0 else 0.0 end), 6) as fraction_dg_zero from (select structure, energy_gap, energy_gap as dg_boltz from stab where energy_gap is not null) z group by structure), b as (select structure, round(quantile_cont(abs(ddg_gap), 0.25), 6) as lower_quartile_ddg, round(quantile_cont(case when not isinf(ddg_gap) then abs(ddg_gap) end, 0.5), 6) as median_ddg from dd where ddg_gap is not null group by structure) select a.*, b.lower_quartile_ddg, b.median_ddg from a left join b using (structure)")
def _(t):
    from .map_queries import stable

    samples = stable(t).where("energy_gap is not null").withColumnRenamed("energy_gap", "stability")
    rows = effects(t).withColumnRenamed("ddg_gap", "ddg").where("ddg is not null")
    return rounded(summary.walk_summary(samples, rows, "structure"), "dg", "fraction_dg_zero", "lower_quartile_ddg", "median_ddg")


@Q.add("set_quartile_by_loop", f"with {MD}, {COARSE}, q as (select structure, round(round(quantile_cont(abs(ddg), 0.25), 8), 1) as low from md group by structure), u as (select low, cast(length(coarse) - length(replace(coarse, '[', '')) - 1 as bigint) as inner_loops from q join cg using (structure)) {box_sql('inner_loops', 'low', 'select * from u')}")
def _(t):
    sizes = summary.effect_sizes(map_effects(t).withColumn("ddg", F.round("ddg", 6)), "structure")
    low = summary.quantiles(sizes, ["structure"], [0.25]).select("structure", F.round(F.round(F.col("q")[0], 8), 1).alias("low"))
    loops = structure.coarse_grain(t.structures.where(F.col("structure") != UNFOLDED)).select("structure", (structure.count_stacks(F.col("coarse")) - 1).cast("long").alias("inner_loops"))
    return rounded(summary.box_stats(low.join(loops, "structure"), ["inner_loops"], "low"), *BOXES)


@Q.add("correlations", f"with {MAP}, a as (select cast(sum(l_quantity) as double) as x, cast(sum(l_extendedprice) as double) as y from lineitem group by l_partkey), r as (select x, y, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from a) select round(corr(x, y), 6) as pearson, round(corr(case when x > 0 then log10(x) end, y), 6) as pearson_log, round(corr(rx, ry), 6) as spearman from r")
def _(t):
    a = t.raw("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("x"), F.sum("l_extendedprice").alias("y")).select("x", F.round("y", 4).alias("y"))
    ranked = summary.average_rank(summary.average_rank(a, "x", "rx"), "y", "ry")
    out = ranked.agg(F.corr("x", "y").alias("pearson"), F.corr(F.when(F.col("x") > 0, F.log10("x")), "y").alias("pearson_log"), F.corr("rx", "ry").alias("spearman"))
    return rounded(out, "pearson", "pearson_log", "spearman")


@Q.add("mean_std", f"with {MAP} select structure, round(avg(mfe), 6) as mean, round(stddev_pop(mfe), 6) as std from m group by structure")
def _(t):
    return rounded(t.gpmap.groupBy("structure").agg(F.avg("mfe").alias("mean"), F.stddev_pop("mfe").alias("std")), "mean", "std")


@Q.add("histogram_2d", "with a as (select l_quantity as x, l_discount as y from lineitem), b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from a), c as (select least(floor((x - x0) * 7 / (x1 - x0)), 6) as bx, least(floor((y - y0) * 7 / (y1 - y0)), 6) as by_, x0, x1, y0, y1 from a, b) select round(x0 + (bx + 0.5) * (x1 - x0) / 7, 6) as x, round(y0 + (by_ + 0.5) * (y1 - y0) / 7, 6) as y, count(*) as n from c group by bx, by_, x0, x1, y0, y1")
def _(t):
    rows = t.raw("lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return rounded(summary.histogram_2d(rows, "x", "y", 7), "x", "y")


@Q.add("average_rank", f"with {MAP} select code, stability, rank() over (order by stability) + (count(*) over (partition by stability) - 1) / 2.0 as ranked from m")
def _(t):
    return summary.average_rank(t.gpmap.select("code", "stability"), "stability", "ranked")


@Q.add("sample_per_group", f"with {MAP}, r as (select *, row_number() over (partition by structure order by code) - 1 as rank from m), s as (select structure, count(*) as n, min(code) as k from m group by structure), d as (select structure, cast(x as bigint) as draw, {draw_sql('k', 'x', 4)} % n as rank from s, range(1, 101) t(x)) select structure, draw, code from d join r using (structure, rank)")
def _(t):
    out = sampling.sample_per_group(t.gpmap.select("structure", "code"), "structure", "code", 100, 4)
    return out.select("structure", F.col("draw").cast("long").alias("draw"), "code")


@Q.add("sample_n", f"with {MAP} select code, structure from m order by {mix_sql('code', 5)}, code limit 1000")
def _(t):
    return sampling.sample_n(t.gpmap.select("code", "structure"), "code", 1000, 5)


@Q.add("weighted_sample", f"with {SHAPES}, {SITES}, {COARSE}, w as (select s.structure, cast(list_sum(list_transform(range(1, length(s.structure) + 1), lambda k: k * k * ascii(substr(s.structure, cast(k as int), 1)))) as bigint) as key, length(coarse) - length(replace(coarse, '[', '')) as stacks from shapes s join cg using (structure)), o as (select structure, key, round(-ln(({mix_sql('key', 6)} + 0.5) / 2147483647) * count(*) over (partition by stacks), 6) as o from w) select structure from o order by o, key, structure limit 100")
def _(t):
    chars = F.transform(F.sequence(F.lit(1), F.length("structure")), lambda k: k * k * F.ascii(F.substring("structure", k, F.lit(1))))
    key = F.aggregate(chars, F.lit(0).cast("long"), lambda a, b: a + b)
    rows = structure.coarse_grain(t.shapes).select("structure", F.struct(key.alias("k"), "structure").alias("id"), key.alias("key"), structure.count_stacks(F.col("coarse")).alias("stacks"))
    return sampling.weighted_sample(rows.drop("id"), "key", "stacks", 100, 6).select("structure")


@Q.add("fill_to_target", f"with a as (select l_orderkey, count(*) as effects from lineitem group by 1), r as (select *, coalesce(sum(effects) over (order by {mix_sql('l_orderkey', 8)}, l_orderkey rows between unbounded preceding and 1 preceding), 0) as before from a) select l_orderkey, effects from r where before < 20000")
def _(t):
    rows = t.raw("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("effects"))
    return sampling.fill_to_target(rows, "l_orderkey", "effects", 20000, 8)


@Q.add("sorted_lengths", f"with {SHAPES}, {SITES}, {STACK} select distinct cast(stack_length as bigint) as element_length from sl order by 1")
def _(t):
    return structure.site_stacks(t.shapes).select(F.col("stack_length").cast("long").alias("element_length")).distinct().orderBy("element_length")


@Q.add("union_landscapes", f"with {MAP}, u as (select 'stability' as landscape, stability as x from m union all select 'mfe', mfe from m) {box_sql('landscape', 'x', 'select * from u')}")
def _(t):
    one = t.gpmap.select(F.lit("stability").alias("landscape"), F.col("stability").alias("x"))
    return rounded(summary.box_stats(one.unionByName(t.gpmap.select(F.lit("mfe").alias("landscape"), F.col("mfe").alias("x"))), ["landscape"], "x"), *BOXES)


@Q.add("set_size_correction", f"with {MAP} select structure, round(count(*) * (1 - avg(case when abs(stability) <= 1e-5 then 1.0 else 0.0 end)), 6) as corrected from m group by structure")
def _(t):
    sizes = summary.neutral_set_sizes(t.gpmap)
    zero = t.gpmap.groupBy("structure").agg(F.avg(F.when(F.abs("stability") <= 1e-5, 1.0).otherwise(0.0)).alias("z"))
    return rounded(sizes.join(zero, "structure").select("structure", (F.col("size") * (1 - F.col("z"))).alias("corrected")), "corrected")


@Q.add("additive_set_size", "with recursive o as (select o_orderkey as model, cast(o_orderkey % 50 as double) / 10 as dg, cast(1 + o_orderkey % 7 as double) / 10 as i1, 2 + o_orderkey % 5 as n1, cast(3 + o_orderkey % 11 as double) / 10 as i2, 1 + o_orderkey % 6 as n2 from orders), a as (select *, n from o, range(0, 8) r(n) where n <= least(floor(dg / i1), n1)), b as (select a.*, m from a, range(0, 8) r(m) where m <= least(floor(abs(dg - n * i1) / i2), n2)) select model, cast(sum(factorial(n1::int) / (factorial(n::int) * factorial((n1 - n)::int)) * pow(3, n) * (factorial(n2::int) / (factorial(m::int) * factorial((n2 - m)::int))) * pow(1, m)) as double) as size from b group by model")
def _(t):
    k = F.col("o_orderkey")
    cell = lambda impact, sites, kk: F.struct(impact.alias("impact"), sites.cast("int").alias("sites"), F.lit(kk).alias("k"))
    classes = F.array(cell((1 + k % 7).cast("double") / 10, 2 + k % 5, 4), cell((3 + k % 11).cast("double") / 10, 1 + k % 6, 2))
    models = t.raw("orders").select(k.alias("model"), ((k % 50).cast("double") / 10).alias("dg"), classes.alias("classes"))
    return additive.additive_set_size(models).select("model", "size")


@Q.add("additive_curves")
def _(t):
    parameters = summary.model_parameters(sampled_effects(t))
    models = additive.curve_models(parameters, L)
    return rounded(additive.additive_set_size(models), "size")


def _path(t, name: str) -> str:
    return tables.new_path(t.spark, name)


@Q.add("write_csv_table", f"with {MAP} select code, structure, stability, mfe from m")
def _(t):
    tables.write_csv_table(t.gpmap, path := _path(t, "csv"))
    return tables.read_csv_table(t.spark, path, "code long, structure string, stability double, mfe double")


@Q.add("read_csv_table", f"with {MAP} select structure, count(*) as size, max(stability) as max_dg from m group by structure")
def _(t):
    tables.write_csv_table(summary.neutral_set_sizes(t.gpmap).join(t.gpmap.groupBy("structure").agg(F.max("stability").alias("max_dg")), "structure"), path := _path(t, "csv"))
    return tables.read_csv_table(t.spark, path, "structure string, size long, max_dg double")


@Q.add("map_store", f"with {MD} select code, pos, ddg from md")
def _(t):
    rows = map_effects(t).select("code", F.expr("round(ddg, 6) + 0D").alias("ddg"), "pos")
    tables.map_store(rows.where("pos < 9"), path := _path(t, "map"), "pos")
    return tables.map_store(rows, path, "pos").select("code", "pos", "ddg")  # adds the other sites


@Q.add("structure_list_io", f"with {SHAPES}, {PAIRED_RUNS} select structure from ok")
def _(t):
    valid = structure.validity(t.shapes).where("valid").select("structure")
    tables.write_structures(valid, path := _path(t, "list"))
    return tables.read_structures(t.spark, path)


@Q.add("neutral_size_read", f"with {MAP} select structure, cast(count(*) as double) * 1e20 as size from m group by structure")
def _(t):
    lines = summary.neutral_set_sizes(t.gpmap).select(F.concat_ws(" ", "structure", F.concat(F.col("size").cast("string"), F.lit("e20"))).alias("value"))
    lines.write.text(path := _path(t, "sizes"))
    return tables.read_sizes(t.spark, path)
