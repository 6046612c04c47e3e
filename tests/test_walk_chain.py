"""Walks, effects of what they sampled, and their summaries, against plain scoring of every mutant."""

import math

import numpy as np

from foldtable.operators import folding, structure_space
from foldtable.plans import map_queries, registry
from foldtable.plans.fixtures import Tables

SF, L = "/root/testdata/sf0.001", 13


def quantile(values, q):
    """Linear between places; infinity where one of two different neighbours is infinite."""
    values = sorted(values)
    at = q * (len(values) - 1)
    lo, hi = values[math.floor(at)], values[math.ceil(at)]
    return lo if lo == hi else math.inf if math.isinf(hi) else lo + (at - math.floor(at)) * (hi - lo)


def test_walk_chain(spark, monkeypatch):
    for name, value in (("WALKS", 2), ("STEPS", 60), ("EVERY", 12)):
        monkeypatch.setattr(map_queries, name, value)
    rows = registry.QUERIES["walk_chain"](spark, SF).collect()
    found = map_queries.walks(Tables(spark, SF))[0].collect()
    structures = folding.structure_list(structure_space.enumerate_structures(spark, L), L)
    table = folding.Energies(structures).table
    effects = {}

    def of(code):
        if code not in effects:
            mutants = [code ^ (m << 2 * k) for k in range(L) for m in (1, 2, 3)]
            scores = table(np.array([code, *mutants]))
            best, two = scores.argmin(axis=1), np.sort(scores, axis=1)[:, :2]
            gap, low, own = two[:, 1] - two[:, 0], two[:, 0], best[0]
            held = scores[1:, own]
            ddg = [g - gap[0] if b == own else w - h - gap[0] if math.isfinite(h) else -math.inf for g, b, w, h in zip(gap[1:], best[1:], low[1:], held, strict=True)]
            effects[code] = gap[0], [round(x, 2) for x in ddg], [round((w if b == own else h) - low[0], 2) for b, w, h in zip(best[1:], low[1:], held, strict=True)]
        return effects[code]

    samples = {}
    for r in found:
        samples.setdefault(r.structure, []).append(of(r.walked))
    assert len(samples) > 10 and len(rows) == 2 * len(samples)
    for r in rows:
        mine = samples[r.structure]
        gaps = [round(g, 2) for g, _, _ in mine]
        stable = [g for g in gaps if r.form == "free_energy" or abs(g) > 1e-5]
        sizes = [abs(x) for _, gap, mfe in mine for x in (gap if r.form == "energygap" else mfe)]
        want = (np.mean(stable) if stable else None, np.mean([abs(g) <= 1e-5 for g in gaps]), quantile(sizes, 0.25), quantile([x for x in sizes if math.isfinite(x)], 0.5))
        for a, b in zip((r.dg, r.fraction_dg_zero, r.lower_quartile_ddg, r.median_ddg), want, strict=True):
            assert (a is None and b is None) or a == b or abs(a - b) < 2e-6, (r, want)
