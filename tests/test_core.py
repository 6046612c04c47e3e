"""Exact toy cases of sequences, structures, components, epistasis and the additive model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldtable.functions import codec
from foldtable.operators import additive, components, ensemble, epistasis, folding, mutate, sampling, structure, summary
from foldtable.plans import registry
from foldtable.plans.fixtures import Tables
from foldtable.sources import tables


def code(seq):
    out = 0
    for b in seq:
        out = out * 4 + b
    return out


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))
    return row.select(column).first()[0]


def structures(spark, *names):
    return spark.createDataFrame([(s,) for s in names], "structure string")


def test_codes(spark):
    assert one(spark, codec.seq_to_code(F.col("s")), s="ACUTGa") == code([0, 1, 2, 2, 3, 0])
    assert one(spark, codec.seq_to_code(F.col("s")), s="AXA") is None
    assert one(spark, codec.code_to_seq(F.col("c"), 4), c=code([1, 2, 3, 1])) == "CUGC"
    assert one(spark, codec.structure_to_code(F.col("s")), s="..(((.....)))") == 69861397
    assert one(spark, codec.code_to_structure(F.col("c")), c=69861397) == "..(((.....)))"
    assert [one(spark, codec.is_unfolded(F.col("c")), c=c) for c in (0, 1, 2, 64, 69861397)] == [True, True, True, True, False]
    with pytest.raises(Exception, match="no structure"):
        one(spark, codec.code_to_structure(F.col("c")), c=2)
    a, b, c = code([1, 0, 2, 0, 1, 2, 3]), code([3, 0, 2, 0, 1, 2, 3]), code([0, 1, 2, 0, 1, 2, 2])
    assert [one(spark, codec.hamming(F.col("x"), F.col("y")), x=x, y=y) for x, y in ((a, c), (a, b), (b, c))] == [3, 1, 3]


def test_mutants(spark):
    seq = spark.createDataFrame([(code([1, 2, 3, 1]),)], "code long")
    found = {r.mutant for r in mutate.point_neighbours(seq, 4).collect()}
    want = {code([*[1, 2, 3, 1][:p], b, *[1, 2, 3, 1][p + 1 :]]) for p in range(4) for b in range(4)} - {code([1, 2, 3, 1])}
    assert found == want and len(found) == 12
    assert len({r.mutant for r in mutate.point_neighbours(seq, 4, F.lit(1)).collect()}) == 3
    folded = spark.createDataFrame([(code([3, 1, 0, 0, 0, 3, 1]), "((...))")], "code long, structure string")
    pairs = structure.base_pairs(structures(spark, "((...))"))
    assert mutate.bp_double_mutants(folded, pairs, 7).count() == 8
    assert mutate.bp_swaps_at_site(folded, pairs, 7, F.lit(0)).count() == 5
    assert one(spark, mutate.double_mutant(F.col("a"), F.col("b"), F.col("c")), a=code([1, 0, 3]), b=code([3, 0, 3]), c=code([1, 0, 2])) == code([3, 0, 2])


def roles_of(s):
    """(role, place, size of its stack or loop) of each site, from pairs and the loops that they close."""
    opened, mate, inside = [], {}, {None: []}
    around = []
    for k, c in enumerate(s):
        if c == ")":
            i = opened.pop()
            mate[i], mate[k] = k, i
        around.append(opened[-1] if opened else None)
        if c == "(":
            inside[around[-1]].append(k)
            inside[k] = []
            opened.append(k)
    out = []
    for k, c in enumerate(s):
        if c != ".":
            i, j = sorted((k, mate[k]))
            below, above = i, i
            while mate.get(below + 1) == mate[below] - 1:
                below += 1
            while above and mate.get(above - 1) == mate[above] + 1:
                above -= 1
            out.append(("stack", "middle" if above < i < below else "end", below - above + 1))
            continue
        a, b = k, k
        while a and s[a - 1] == ".":
            a -= 1
        while b < len(s) - 1 and s[b + 1] == ".":
            b += 1
        edge, i = k in (a, b), around[k]
        if i is None:
            role = "exterior loop"
        elif len(inside[i]) != 1:
            role = "multiloop" if inside[i] else "hairpin loop"
        else:
            (m,) = inside[i]
            role = "internal loop" if m > i + 1 and mate[m] < mate[i] - 1 else "bulge"
        out.append((role, "end" if edge else "middle", b - a + 1))
    return out


def test_roles_and_features(spark):
    ours = ["..((..(((...)))..((...))...))", "((.((....)).((...))))", "(((...)))..((((.....))))", "((((..((....)).)).))", ".....((((....))...)).", "(((((....)....)))...)"]
    known = [*ours, *(r.structure for r in folding.enumerate_structures(spark, 11, True).collect())]
    rows = {}
    for r in structure.site_features(structures(spark, *known)).collect():
        rows.setdefault(r.structure, {})[r.pos] = (r.role, r.place, r.element_length)
    assert set(rows) == set(known) and len(known) > 50
    for name, sites in rows.items():
        assert [sites[k] for k in range(len(name))] == roles_of(name), name
    assert {role for sites in rows.values() for role, *_ in sites.values()} == {"stack", "bulge", "internal loop", "multiloop", "hairpin loop", "exterior loop"}


def test_coarse_graining_and_validity(spark):
    names = {"((...))": "[_]", "..((.((...))))": "_[_[_]]", "((((...)).))": "[[_]_]", "(((..(((...))).)))..": "[_[_]_]_", "((...))((...))": "[_][_]", "((((...))((...))))": "[[_][_]]"}
    assert {r.structure: r.coarse for r in structure.coarse_grain(structures(spark, *names)).collect()} == names
    want = {"((....)).((((...)).)).": (True, True), "(....).((...))": (False, True), "((..)).((...))": (False, False), "((...)": (False, False), ".......": (False, False), "(y)": (False, False)}
    assert {r.structure: (r.valid, r.valid_with_isolated) for r in structure.validity(structures(spark, *want)).collect()} == want
    with pytest.raises(Exception, match="not balanced"):
        structure.base_pairs(structures(spark, "((.)")).collect()


def changed(c, pos, base):
    """c, a code of three sites, with another base at a site."""
    return c & ~(3 << 2 * (2 - pos)) | base << 2 * (2 - pos)


def near(c):
    return [(pos, n) for pos in range(3) for b in range(4) if (n := changed(c, pos, b)) != c]


def test_components_and_versatility(spark):
    labels = np.random.default_rng(8).choice(list("aabc"), 64).tolist()
    rows = spark.createDataFrame(list(enumerate(labels)), "code long, structure string")
    part = {}
    for c in range(64):
        wave = [c] if c not in part else []
        while wave:
            now = wave.pop()
            part[now] = c
            wave += [n for _, n in near(now) if n not in part and labels[n] == labels[c]]
    groups = {}
    for r in components.neutral_components(rows, 3).collect():
        groups.setdefault(r.nc_id, set()).add(r.code)
    want = {c: {k for k in part if part[k] == c} for c in part.values()}
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and len(want) > 3
    assert components.neutral_edges(rows, 3).count() == sum(labels[c] == labels[n] for c in range(64) for _, n in near(c)) / 2
    kept = {(r.code, r.pos): r.versatility for r in components.site_versatility(rows, 3).collect()}
    for c in range(64):
        for pos in range(3):
            assert math.isclose(kept[c, pos], sum(p == pos and labels[n] == labels[c] for p, n in near(c)) / 3)


def test_epistasis(spark):
    rng = np.random.default_rng(4)
    tenths = {1: {int(c): int(e) for c, e in zip(rng.choice(64, 40, False), rng.integers(0, 3, 40), strict=True)}, 2: dict.fromkeys(range(8), 7)}
    rows = spark.createDataFrame([(nc, c, e / 10) for nc, held in tenths.items() for c, e in held.items()], "nc_id long, code long, energy double")
    found = epistasis.squares(rows, 3)
    whole = {r.nc_id: r for r in epistasis.epistasis_fractions(rows, 3).collect()}
    total = 0
    for nc, e in tenths.items():
        corners = [
            (e[c], e[x], e[y], e[z])
            for c in e for p in range(3) for q in range(p + 1, 3) for a in range(4) for b in range(4)
            if (x := changed(c, p, a)) in e and (y := changed(c, q, b)) in e and (z := changed(x, q, b)) in e and c != x and c != y
        ]
        total += len(corners)
        for ignore in (False, True):
            counted = [k for k in corners if not ignore or (k[1] != k[0] and k[2] != k[0])]
            want = sum(k[0] + k[3] != k[1] + k[2] for k in counted) / len(counted) if counted else None
            got = epistasis.epistasis_fraction(found.where(F.col("nc_id") == nc), ignore).first().fraction
            both = whole[nc].fraction_nonzero if ignore else whole[nc].fraction
            assert (got, both) == (None, None) if want is None else math.isclose(got, want) and math.isclose(both, want)
    assert found.count() == total and total > 100


def test_additive_model(spark):
    classes = [(0.5, 3, 4), (2.0, 4, 3)]
    rows = [("m", dg, classes) for dg in (0.2, 1.7, 4.3, 50.0)]
    models = spark.createDataFrame(rows, "model string, dg double, classes array<struct<impact: double, sites: int, k: int>>")
    ways = {(n, m): math.comb(3, n) * 3**n * math.comb(4, m) * 2**m for n in range(4) for m in range(5)}
    want = {dg: sum(w for (n, m), w in ways.items() if n * 0.5 + m * 2.0 <= dg) for _, dg, _ in rows}
    assert {r.dg: r["size"] for r in additive.additive_set_size(models).collect()} == want


def test_additive_model_of_many_sites(spark):
    rows = [("a", 10.0, [(1.0, 21, 4)]), ("b", 10.0, [(1.0, 21, 4), None]), ("c", 25.0, [(1.0, 25, 2)])]
    models = spark.createDataFrame(rows, "model string, dg double, classes array<struct<impact: double, sites: int, k: int>>")
    got = {r.model: r["size"] for r in additive.additive_set_size(models).collect()}
    assert got == {"a": sum(math.comb(21, n) * 3**n for n in range(11)), "b": 28247379436, "c": 2**25}


def test_stability_and_effects(spark):
    rows = [(0, "(...)", -2.0), (0, ".....", 0.0), (1, ".....", 0.0), (2, "(...)", -1.0), (2, ".....", -1.0), (3, "(...)", -9e9), (3, ".....", 0.0)]
    table = spark.createDataFrame(rows, "code long, structure string, energy double")
    got = {r.code: r for r in ensemble.stability(table).collect()}
    assert got[0].energy_gap == 2.0 and math.isclose(got[0].dg_boltz, 2.0) and got[1].energy_gap is None and got[2].energy_gap == 0 and got[3].dg_boltz == math.inf
    effects = {r.mutant: r for r in ensemble.ddg_table(ensemble.stability(table), table, 5, ".....").where("code = 0").collect()}
    assert effects[1].ddg_gap == -math.inf and effects[1].d_mfe == math.inf


def test_enumeration_folding_and_walks(spark):
    found = folding.structure_list(folding.enumerate_structures(spark, 13), 13)
    assert len(found) == 60  # 59 and the unfolded one
    seqs = spark.createDataFrame([(code([3, 3, 3, 3, 0, 0, 0, 0, 0, 1, 1, 1, 1]),)], "code long")
    folds = folding.fold_by_enumeration(seqs, found)
    best = ensemble.stability(folds).first()
    assert best.structure == "((((.....))))" and math.isclose(best.mfe, -3.26 * 3 + 4)
    walk = folding.neutral_walks(seqs, found, 20, 5, 1).collect()
    assert len(walk) == 4
    ends = spark.createDataFrame([(r.walked,) for r in walk], "code long").distinct()
    assert {r.structure for r in ensemble.stability(folding.fold_by_enumeration(ends, found)).collect()} == {best.structure}


def test_effects_of_sequences_folded_in_place(spark):
    found = folding.structure_list(folding.enumerate_structures(spark, 13), 13)
    codes = [int(c) for c in np.random.default_rng(3).integers(0, 4**13, 60)] + [code([3, 3, 3, 3, 0, 0, 0, 0, 0, 1, 1, 1, 1])]
    seqs = spark.createDataFrame([(c,) for c in codes], "code long")
    near = mutate.point_neighbours(seqs, 13).select(F.col("mutant").alias("code")).unionByName(seqs).distinct()
    folds = folding.fold_by_enumeration(near, found)
    stable = ensemble.stability(folds)
    want = ensemble.ddg_table(stable, folds, 13, found[-1]).join(seqs, "code", "left_semi")
    want = want.join(stable.where("energy_gap is not null").select("code", "mfe", "energy_gap"), "code")
    key = lambda r: (r.code, r.structure, r.pos, r.new_base, round(r.mfe, 2), round(r.energy_gap, 2), round(r.ddg_gap, 2) + 0.0, round(r.d_mfe, 2) + 0.0)
    got = sorted(key(r) for r in folding.sequence_effects(seqs, found).collect())
    assert got == sorted(key(r) for r in want.collect()) and len({r[0] for r in got}) > 2


def test_walks_depend_on_their_start_and_draw_alone(spark):
    found = folding.structure_list(folding.enumerate_structures(spark, 13), 13)
    start = code([3, 3, 3, 3, 0, 0, 0, 0, 0, 1, 1, 1, 1])
    starts = spark.createDataFrame([(start, k) for k in range(1, 7)], "code long, draw long")
    walks = [sorted(map(tuple, folding.neutral_walks(rows, found, 300, 10, 1).collect())) for rows in (starts.coalesce(1), starts.repartition(6))]
    assert walks[0] == walks[1] and len(walks[0]) == 6 * 30 and len({w[4] for w in walks[0]}) > 100


def test_long_sequences_have_effects(spark):
    rows = registry.QUERIES["long_sequence_effects"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 1000 and {len(r.structure) for r in rows} == {30} and {"stack", "hairpin loop", "bulge"} <= {r.role for r in rows}


def test_keys_are_mixed_evenly(spark):
    got = [r.code for r in sampling.random_sequences(spark.range(10_000), 13, 7).collect()]
    assert len(set(got)) > 9_900
    bases = np.array(got)[:, None] >> 2 * np.arange(13)[None, :] & 3
    for k in range(13):
        assert (np.abs(np.bincount(bases[:, k], minlength=4) - 2500) < 250).all()
        for m in range(k):
            assert (np.abs(np.bincount(bases[:, k] * 4 + bases[:, m], minlength=16) - 625) < 150).all()
    picked = sorted(r.id for r in sampling.sample_n(spark.range(40_000), "id", 1000, 5).collect())
    gaps = np.diff(picked)
    assert len(set(gaps.tolist())) > 80 and 30 < gaps.mean() < 50


def test_running_sums_by_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), k, int(v)) for k, (g, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 2000), rng.integers(0, 9, 2000), strict=True))]
    table = spark.createDataFrame(rows, "g long, k long, v long").repartition(5)
    for keys in (["g"], []):
        seen, want = {}, {}
        for g, k, v in rows:
            own = g if keys else 0
            want[k] = seen.get(own, 0)
            seen[own] = want[k] + v
        got = sampling.running_sum(table, keys, ["k"], F.col("v"), "before")
        assert {r.k: r.before for r in got.collect()} == want and got.columns == ["g", "k", "v", "before"] if keys else {r.k: r.before for r in got.collect()} == want
    ranked = {r.v: r.ranked for r in summary.average_rank(table, "v", "ranked").collect()}
    values = [v for *_, v in rows]
    assert ranked == {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("(((...)))", 1.5)], "structure string, x double")
    tables.write_csv_table(rows, f"{tmp_path}/csv")
    assert tables.read_csv_table(spark, f"{tmp_path}/csv", "structure string, x double").collect() == rows.collect()
    tables.write_structures(structures(spark, "(((...)))", "(.)"), f"{tmp_path}/bad")
    with pytest.raises(Exception, match="no valid structure"):
        tables.read_structures(spark, f"{tmp_path}/bad").collect()
    assert tables.map_store(rows, f"{tmp_path}/m").count() == 1 and tables.map_store(rows.union(rows), f"{tmp_path}/m").count() == 1


def test_summaries(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(5)] + [("a", math.inf), ("a", math.nan)], "g string, ddg double")
    got = summary.box_stats(summary.finite_effects(rows), ["g"], "ddg").first()
    assert (got.p25, got.p50, got.p95) == (1.0, 2.0, 3.8)


def test_summary_keeps_every_valid_structure(spark):
    names = ["((......))...", "(((....)))...", "(...)........", "............."]
    rows = spark.createDataFrame(list(enumerate(names)), "code long, structure string")
    assert {r.code for r in structure.keep_valid(rows, rows).collect()} == {0, 1}
    dir_ = "/root/testdata/sf0.001"
    got = {r.structure: r["count"] for r in registry.QUERIES["sequence_summary"](spark, dir_).groupBy("structure").count().collect()}
    whole = {r.structure: r["count"] for r in Tables(spark, dir_).gpmap.groupBy("structure").count().collect()}
    assert whole.pop(".(.((....)).)") > 0  # one structure of the fixture has a pair that stands alone
    assert "((......))..." in got and got == whole


def test_walks_go_their_full_length(spark):
    found = folding.structure_list(folding.enumerate_structures(spark, 13), 13)
    energies = folding.Energies(found)
    codes = np.random.default_rng(1).integers(0, 4**13, 20000)
    assert (folding.Lowest(energies)(codes) == energies.table(codes).argmin(axis=1)).all()
    rows = registry.QUERIES["neutral_walk"](spark, "/root/testdata/sf0.001").collect()
    walks = {}
    for r in rows:
        walks.setdefault((r.structure, r.draw), []).append(r)
    names = {r.structure for r in rows}
    assert names and set(walks) == {(s, k) for s in names for k in range(1, 6)}
    for mine in walks.values():
        assert len(mine) == 100 and max(r.step for r in mine) < 10_000 if mine[0].complete else [r.walked for r in mine] == [mine[0].code]
    ends = np.array([r.walked for r in rows])
    assert [found[k] for k in energies.table(ends).argmin(axis=1)] == [r.structure for r in rows]


def test_coverage_is_against_the_whole_enumeration(spark):
    rows = structures(spark, "((......))...", "(((....)))...", "(...)........", "((..)).......")
    assert {r.structure for r in folding.not_enumerated(rows, 13).collect()} == {"(...)........", "((..))......."}
    assert [r.structure for r in registry.QUERIES["coverage_check"](spark, "/root/testdata/sf0.001").collect()] == [".(.((....)).)"]
