"""Repeated rows, nulls, clashing names, and plans that must not grow: the core's operators on awkward tables."""

import math
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldtable.functions import codec
from foldtable.operators import additive, components, ensemble, epistasis, folding, mutate, sampling, structure_space, summary
from foldtable.sources import tables

L = 5


def codes_of(rng, n, length=L):
    return sorted({rng.randrange(4**length) for _ in range(n)})


def neighbours(code, length=L):
    return {code ^ (m << 2 * k) for k in range(length) for m in (1, 2, 3)}


def union_find(nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for s, c in nodes:
        for d in neighbours(c, 8):
            if (s, d) in root:
                a, b = find((s, c)), find((s, d))
                root[max(a, b)] = min(a, b)
    return {n: find(n)[1] for n in nodes}


def test_components_edges_and_versatility_of_repeated_rows(spark):
    rng = random.Random(2)
    nodes = {(s, c) for s in ("x", "y", None) for c in codes_of(rng, 300)}
    rows = spark.createDataFrame([(c, s) for s, c in nodes] + [(c, s) for s, c in list(nodes)[:200]], "code long, structure string")
    want = sorted((str(s), c, d) for s, c in nodes for d in neighbours(c) if c < d and (s, d) in nodes)
    assert sorted((str(r.structure), r.code_a, r.code_b) for r in components.neutral_edges(rows, L).collect()) == want
    got = {(r.structure, r.code, r.pos): r.versatility for r in components.site_versatility(rows, L).collect()}
    assert len(got) == L * len(nodes)
    for (s, c, pos), v in got.items():
        assert abs(v - sum((s, c ^ (m << 2 * (L - 1 - pos))) in nodes for m in (1, 2, 3)) / 3) < 1e-9
    for most in (0, 1 << 19):
        labels = components.neutral_components(rows, L, in_one_task=most).collect()
        assert len(labels) == len(nodes) and {(r.structure, r.code): r.nc_id for r in labels} == {(s or None, c): n for (s, c), n in union_find({(s or "", c) for s, c in nodes}).items()}
    assert components.neutral_components(rows.limit(0), L).count() == 0


def test_components_of_long_paths_and_stars(spark):
    """A path that no shortcut crosses, dealt numbers at random, beside a dense lump."""
    at, path = 0, [0]
    rng = random.Random(3)
    taken = {0}
    for _ in range(400):
        steps = [d for d in neighbours(at, 8) if d not in taken and len(neighbours(d, 8) & taken) == 1]
        if not steps:
            break
        at = rng.choice(steps)
        path.append(at)
        taken.add(at)
    lump = [(7 << 12) | k for k in range(256)]
    nodes = {("p", c) for c in path} | {("q", c) for c in lump} | {("q", 65535)}
    rows = spark.createDataFrame([(c, s) for s, c in nodes], "code long, structure string")
    assert len(path) > 100
    for most in (0, 40, 1 << 19):  # edges are contracted by rounds alone, to the end in a task, or there alone
        assert {(r.structure, r.code): r.nc_id for r in components.neutral_components(rows, 8, in_one_task=most).collect()} == union_find(nodes)


def test_squares_of_repeated_members(spark):
    rng = random.Random(4)
    rows = [(1, c, float(rng.randrange(5))) for c in codes_of(rng, 200)]
    one = spark.createDataFrame(rows, "nc_id long, code long, energy double")
    more = one.unionByName(one.limit(50)).unionByName(one.where("code % 3 = 0"))
    for f in (lambda m: epistasis.squares(m, L), lambda m: epistasis.epistasis_fractions(m, L)):
        assert sorted(map(str, f(one).collect())) == sorted(map(str, f(more).collect()))
    assert epistasis.squares(one, L).count() > 100


def test_repeated_models_and_ensembles(spark):
    model = spark.createDataFrame([("m", 0.5, [(0.4, 2, 4)])] * 3 + [("m", 0.5, [(0.4, 1, 4)])], "model string, dg double, classes array<struct<impact:double,sites:int,k:int>>")
    assert sorted((r.model, r["size"]) for r in additive.additive_set_size(model).collect()) == [("m", 4.0), ("m", 7.0)]
    rows = [(1, "((...))", -2.0), (1, "((...))", -2.0), (1, ".......", 0.0), (2, ".......", 0.0)]
    got = {r.code: r for r in ensemble.stability(spark.createDataFrame(rows, "code long, structure string, energy double")).collect()}
    assert got[1].energy_gap == 2.0 and abs(got[1].dg_boltz - 2.0) < 1e-9 and got[2].energy_gap is None
    more = [*rows, (1, "((...))", -1.5), (1, None, -9.0), (2, "(.....)", None), (3, "((...))", -1.0), (3, "(.....)", -1.0), (3, ".......", 0.5)]
    got = {r.code: r for r in ensemble.stability(spark.createDataFrame(more, "code long, structure string, energy double")).collect()}
    assert got[1].energy_gap == 2.0 and abs(got[1].dg_boltz - 2.0) < 1e-9 and got[2].energy_gap is None and got[2].mfe == 0.0
    weight = 1 / (2 + math.exp(-1.5 / ensemble.KT))
    assert (got[3].structure, got[3].energy_gap) == ("((...))", 0.0) and abs(got[3].dg_boltz - ensemble.KT * math.log(weight / (1 - weight))) < 1e-9
    plan = ensemble.stability(spark.createDataFrame(more, "code long, structure string, energy double"))._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "collect_" not in plan
    held = {r.code: r.m_forms for r in ensemble.forms(spark.createDataFrame(rows, "code long, structure string, energy double")).collect()}
    assert abs(held[1]["((...))"].p + held[1]["......."].p - 1) < 1e-12


def test_structures_beyond_what_codes_hold(spark):
    rows = spark.createDataFrame([("." * 31,), ("." * 32,), ("((...))",), (None,), ("x",)], "s string")
    coded = rows.select("s", codec.structure_to_code(F.col("s")).alias("c"))
    back = {r.s: r.t for r in coded.select("s", codec.code_to_structure(F.col("c")).alias("t")).collect()}
    assert back == {"." * 31: "." * 31, "." * 32: None, "((...))": "((...))", None: None, "x": None}


def test_lists_refuse_pairs_that_stand_alone(spark, tmp_path):
    tables.write_structures(spark.createDataFrame([("(...)",), ("((...))",)], "structure string"), str(tmp_path / "l"))
    assert tables.read_structures(spark, str(tmp_path / "l"), isolated=True).count() == 2
    with pytest.raises(Exception, match="no valid structure"):
        tables.read_structures(spark, str(tmp_path / "l")).collect()


def test_stored_partitions_are_not_computed_again(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.range(40).selectExpr("id as code", "if(id % 5 = 4, null, id % 5) as pos")
    first = sorted(map(str, tables.map_store(rows, path, "pos").collect()))
    shutil.rmtree(os.path.join(path, "pos=3"))
    # Whatever is asked for beyond what is missing would fail.
    picky = rows.withColumn("code", F.when(F.coalesce(F.col("pos"), F.lit(9)) == 3, F.col("code")).otherwise(F.raise_error(F.lit("computed again")).cast("long")))
    assert sorted(map(str, tables.map_store(picky, path, "pos").collect())) == first
    assert sorted(map(str, tables.map_store(picky.where("pos = 3"), path, "pos").collect())) == first


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(" in x]


def test_bucketed_tables_join_where_they_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = (tables.bucketed(spark.range(1000).selectExpr("id as code", f"id * {k} as v{k}", "id % 7 as structure"), "code", 4) for k in (2, 3))
        joined = a.join(b.select("code", "v3"), "code")
        assert exchanges(joined) == [] and joined.count() == 1000
        rows = summary.attach(a, b.selectExpr("code", "v3 as nc_id"))
        assert not any("code" in x for x in exchanges(rows)) and rows.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_effects_shuffle_mutants_alone(spark):
    """Of the joins behind ddg_table, the stored sides lie in buckets."""
    from foldtable.plans import fixtures, map_queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = exchanges(map_queries.effects(fixtures.Tables(spark, "/root/testdata/sf0.001")))
        assert len(found) == 1 and "hashpartitioning(mutant" in found[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_effects_are_not_broadcast(spark):
    """Spark's own threshold and estimates stand: neither mutants nor their sides go through the driver, and one join serves all quantities."""
    from foldtable.plans import registry

    def joins(df):
        plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
        return [sum(f"{kind} [" in x for x in plan) for kind in ("BroadcastHashJoin", "SortMergeJoin")]

    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    found = registry.QUERIES["quantity_selector"](spark, "/root/testdata/sf0.001")
    assert joins(found) == [0, 2]
    whole = {(r.code, r.pos, r.new_base): r for r in registry.QUERIES["ddg_table"](spark, "/root/testdata/sf0.001").collect()}
    rows = found.collect()
    assert joins(found)[0] == 0 and len(rows) == 3 * len(whole) > 0  # nor did Spark change its mind when it ran
    of = {"energygap": "ddg_gap", "Boltzmann_based": "ddg_boltz", "free_energy": "d_mfe"}
    assert all(str(r.ddg) == str(whole[r.code, r.pos, r.new_base][of[r.quantity]]) for r in rows) and {r.quantity for r in rows} == set(of)


def test_quantiles_by_selection_equal_percentile(spark):
    rng = random.Random(5)
    values = [None, math.inf, math.inf, -1.5, 0.0, *[rng.gauss(0, 1) for _ in range(300)]]
    rows = [(k, rng.choice(["u", None]), rng.choice(values)) for k in [*"aabbbbc", None] * 300] + [("nulls", "u", None), ("inf", "u", math.inf), ("inf", "u", 1.0), ("one", "u", 2.0)]
    df = spark.createDataFrame(rows, "k string, m string, x double")
    fractions = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    for keys in (["k"], ["k", "m"], []):
        counts = summary.counted(df, keys, F.col("x"))
        want, got = (summary.quantiles(counts, keys, fractions, at_once=n).select(*keys, "q").collect() for n in (10**6, 0))
        flat = lambda rs: {str(r[:-1]): r.q and [x if x is None or math.isinf(x) else round(x, 9) for x in r.q] for r in rs}
        blank = lambda d: {k: None if v is None or all(x is None for x in v) else v for k, v in d.items()}
        assert blank(flat(got)) == blank(flat(want)) and len(got) == len(want)
    # One group of many different values spans several tasks.
    wide = spark.range(40_000).selectExpr("0 as k", "cast(hash(id) as double) as x", "1L as n")
    assert summary.quantiles(wide, ["k"], [0.25], at_once=0).first().q[0] == wide.agg(F.percentile("x", F.lit(0.25))).first()[0]


def test_differences_equal_those_of_mutants(spark):
    rng = random.Random(6)
    rows = [(c, rng.randrange(3), rng.choice([1.0, 2.5, math.inf, None, 0.3])) for c in codes_of(rng, 400)]
    df = spark.createDataFrame(rows, "code long, key long, v double")
    pairs = mutate.site_mutants(df, L, ["key", "v"]).withColumn("ddg", F.col("m_v") - F.col("v"))
    want = sorted(map(str, summary.effect_sizes(pairs, "key").collect()))
    assert sorted(map(str, mutate.site_differences(df, L, "key", "v").collect())) == want and want
    value = {c: (k, v) for c, k, v in rows}
    assert pairs.count() == sum(d in value for c in value for d in neighbours(c))
    assert sorted(map(str, mutate.site_differences(df.unionByName(df), L, "key", "v").collect())) == want


def test_stored_and_computed_values(spark):
    rows = spark.range(5000).selectExpr("id as code", "'s' as structure", "cast(id as double) / 7 as v")
    found, equal = summary.differing_rows(rows, rows.repartition(7), "code", ["structure", "v"], parts=16)
    assert equal == 5000 and found.count() == 0
    other = rows.where("code <> 11").selectExpr("code", "if(code = 13, 't', structure) as structure", "case code when 17 then null when 19 then v + 0.0005 when 23 then v + 1 when 29 then double('inf') else v end as v")
    other = other.unionByName(spark.sql("select 99999L as code, 's' as structure, 1D as v"))
    mine = rows.withColumn("v", F.expr("case code when 29 then double('inf') when 31 then null else v end"))
    other = other.withColumn("v", F.expr("if(code = 31, null, v)"))
    found, equal = summary.differing_rows(mine, other, "code", ["structure", "v"], parts=64)
    assert found.count() + equal == 5001 and found.count() < 500
    bad = {r.code for r in found.where(~summary.agrees(found, ["structure", "v"])).collect()}
    assert bad == {11, 13, 17, 23, 99999}
    assert tuple(summary.reconcile(mine, other, "code", ["structure", "v"]).first()) == (5001, 4996, 2)


def test_samples_keep_columns_of_any_name(spark):
    rows = spark.range(500).selectExpr("id as code", "id % 3 as g", *[f"'k' as `{c}`" for c in ("_part", "_size", "_local", "_base", "_rank", "_n", "_key", "_o", "_r", "_before", "_run")])
    assert sampling.running_sum(rows, ["g"], ["code"], F.lit(1), "at").where("_part = 'k' and _base = 'k'").count() == 500
    kept = [sampling.sample_per_group(rows, "g", "code", 20, 1).drop("draw"), sampling.sample_n(rows, "code", 60, 1), sampling.weighted_sample(rows, "code", "g", 60, 1), sampling.fill_to_target(rows.withColumn("size", F.lit(1)), "code", "size", 60, 1).drop("size")]
    for df in kept:
        assert df.count() == 60 and sorted(df.columns) == sorted(rows.columns) and df.where("_n = 'k' and _o = 'k' and _before = 'k'").count() == 60
    assert summary.average_rank(rows, "code", "rank").where("_n = 'k'").count() == 500


def test_draws_of_groups_with_keys_side_by_side_differ(spark):
    draws = spark.range(2).select("id", F.explode(F.sequence(F.lit(1), F.lit(3000))).alias("d")).select("id", "d", sampling.draw_of(F.col("id"), F.col("d"), 4).alias("r"))
    assert draws.select("r").distinct().count() == 6000 and draws.agg(F.max("r")).first()[0] > 1 << 60


def test_sampling_goes_on_until_there_are_enough(spark):
    calls = []

    def draw(first, n):
        calls.append((first, n))
        return spark.range(first, first + n).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.floor(F.sqrt("id")).cast("string"))).alias("structure"))

    found = sampling.sample_until_distinct(draw, 10, 20, 500)
    assert found.count() >= 200 and found.distinct().count() == found.count() and len(calls) > 2
    assert [a for a, _ in calls] == [sum(n for _, n in calls[:k]) for k in range(len(calls))]
    with pytest.raises(ValueError):
        sampling.sample_until_distinct(lambda a, n: spark.range(5).selectExpr("string(id) as structure"), 10, 1, 5, rounds=3)


def test_random_structures_by_folding(spark):
    """Sequences are drawn and folded until enough structures are found, then drawn from by stacks."""
    from foldtable.operators import trie_folding

    found = trie_folding.sampled_structures(spark, 16, wanted=5, per_structure=8, seed=3, batch=100)
    assert found.count() >= 40 and found.join(structure_space.enumerate_structures(spark, 16), "structure", "left_anti").count() == 0
    paired = trie_folding.sampled_structures(spark, 16, wanted=2, per_structure=5, seed=3, batch=100, pairs=4)
    assert {r.structure.count("(") for r in paired.collect()} == {4}


def test_walks_step_by_step(spark):
    """Every step of a walk is one allowed change that keeps the structure, and rounds of any length give the same walks."""
    structures = folding.structure_list(structure_space.enumerate_structures(spark, 13), 13)
    seqs = sampling.random_sequences(spark.range(400), 13, 5).select("code").distinct()
    stable = ensemble.stability(folding.fold_by_enumeration(seqs, structures)).where("structure like '%(%'")
    starts = components._kept(stable.select("code").orderBy("code").limit(12)).crossJoin(spark.range(2).select(F.col("id").alias("draw")))
    whole = folding.neutral_walks(starts, structures, 60, 1, 7, turns=10**6).collect()
    for turns, together in ((7, 500), (50, 3)):
        assert sorted(map(str, folding.neutral_walks(starts, structures, 60, 1, 7, together, turns).collect())) == sorted(map(str, whole))
    lowest, walks = folding.Lowest(folding.Energies(structures)), {}
    for r in whole:
        walks.setdefault((r.code, r.draw), {})[r.step] = r
    assert len(walks) == 24
    for (code, _), steps in walks.items():
        if not steps[0].complete:
            assert len(steps) == 1
            continue
        assert sorted(steps) == list(range(60)) and steps[0].walked == code
        path = [steps[k].walked for k in range(60)]
        assert {structures[k] for k in lowest(np.array(path)).tolist()} == {steps[0].structure}
        mates = dict(folding.pairs_of(steps[0].structure)) | {b: a for a, b in folding.pairs_of(steps[0].structure)}
        for a, b in zip(path[:-1], path[1:], strict=True):
            sites = [k for k in range(13) if (a ^ b) >> 2 * (12 - k) & 3]
            assert len(sites) == 1 or (len(sites) == 2 and mates[sites[0]] == sites[1])
            for k in sites:
                if k in mates:
                    base = lambda at: b >> 2 * (12 - at) & 3
                    assert (base(k), base(mates[k])) in folding.PAIRED
    some = folding.neutral_walks(starts, structures, 60, 10, 7, turns=9).collect()
    at = {(r.code, r.draw, r.step): r for r in whole}
    assert {(r.code, r.draw, r.step) for r in some} <= set(at) and all(at[r.code, r.draw, r.step] == r for r in some)
    assert len([r for r in some if r.complete]) == 6 * len([w for w in walks.values() if w[0].complete])


def plain_size(dg, classes):
    """The additive model by recursion over its classes."""
    if not classes:
        return 1.0
    (impact, sites, k), rest = classes[0], classes[1:]
    most = sites if impact <= 0 else min(math.floor(abs(dg) / impact), sites)
    return sum(math.comb(sites, n) * (k - 1) ** n * plain_size(dg - n * impact if n else dg, rest) for n in range(most + 1))


def test_additive_curves_by_recursion(spark):
    rows = [("S2", 0.5, 1.25, 2.0, 0.25, 1.0, 1.5), ("S3", 0.75, 1.5, math.inf, 0.5, 1.0, 2.5), ("S4", 0.5, 1.0, 1.5, 0.5, 0.75, 1.0), ("L", 0.0, 0.25, 0.5, 0.0, 0.25, 0.5), ("B", 0.25, 0.5, 1.0, 0.25, 0.5, 0.75)]
    cols = "category string, " + ", ".join(f"{k}_{q} double" for k in ("point", "swaps") for q in ("lower", "median", "upper"))
    models = components._kept(additive.curve_models(spark.createDataFrame(rows, cols), 13))
    some = models.where("pmod(hash(model, dg), 40) = 0")
    got = {(r.model, r.dg): r["size"] for r in additive.additive_set_size(some).collect()}
    asked = some.collect()
    assert len(got) == len(asked) > 50 and len({m for m, _ in got}) > 5
    for r in asked:
        want = plain_size(r.dg, [tuple(c) for c in r.classes])
        assert abs(got[r.model, r.dg] - want) <= 1e-9 * want
