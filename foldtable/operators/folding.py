"""Folding by enumeration: every structure that a sequence can form, with an additive energy.

Energies sum published nearest-neighbour stacking terms and one constant for each loop, so they
are not those of a full folding library. Another provider is any function with the signature of
`ensemble_of`, passed to `fold_by_enumeration`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import BASES
from .components import _kept
from .structure_space import enumerate_structures

# Stacking energies (kcal/mol at 37 degrees) of Watson-Crick pairs, as 5'-XY-3' on
# its complement (Xia et al. 1998); stacks with a GU pair, and loops, have one value each here.
STACKS = {"AA": -0.93, "UU": -0.93, "AU": -1.10, "UA": -1.33, "CU": -2.08, "AG": -2.08, "CA": -2.11, "UG": -2.11, "GU": -2.24, "AC": -2.24, "GA": -2.35, "UC": -2.35, "CG": -2.36, "GG": -3.26, "CC": -3.26, "GC": -3.42}
WOBBLE, HAIRPIN, INNER, MULTI = -1.0, 4.0, 1.5, 2.5
PAIRED = {(0, 2), (2, 0), (3, 1), (1, 3), (3, 2), (2, 3)}


def not_enumerated(rows: DataFrame, length: int) -> DataFrame:
    """structure: those of rows that enumeration at their length doesn't find."""
    return rows.select("structure").distinct().join(enumerate_structures(rows.sparkSession, length), "structure", "left_anti")


def pairs_of(structure: str) -> list[tuple[int, int]]:
    opened, pairs = [], []
    for k, c in enumerate(structure):
        if c == "(":
            opened.append(k)
        elif c == ")":
            pairs.append((opened.pop(), k))
    return sorted(pairs)


def _stack_energies() -> np.ndarray:
    table = np.full((4, 4, 4, 4), WOBBLE)
    mate = {"A": "U", "U": "A", "C": "G", "G": "C"}
    for (x, y), e in STACKS.items():
        table[BASES.index(x), BASES.index(mate[x]), BASES.index(y), BASES.index(mate[y])] = e
    return table


class Energies:
    """Structures of one length, ready to be scored against batches of coded sequences."""

    def __init__(self, structures: list[str]):
        self.names, self.length = structures, len(structures[0])
        self.pairs = [np.array(pairs_of(s), "int64").reshape(-1, 2) for s in structures]
        self.stacks, self.loops = [], []
        self.stack, self.can = _stack_energies(), np.zeros((4, 4), bool)
        for a, b in PAIRED:
            self.can[a, b] = True
        for s in structures:
            pairs = pairs_of(s)
            inside = {p: [q for q in pairs if p[0] < q[0] and q[1] < p[1] and not any(p[0] < m[0] < q[0] and q[1] < m[1] < p[1] for m in pairs)] for p in pairs}
            stacked = [(i, j) for (i, j), below in inside.items() if below == [(i + 1, j - 1)]]
            loops = sum(HAIRPIN if not below else MULTI if len(below) > 1 else 0 if p in stacked else INNER for p, below in inside.items())
            self.stacks.append(np.array(stacked, "int64").reshape(-1, 2)), self.loops.append(loops)

    def bases(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, None] >> (2 * np.arange(self.length - 1, -1, -1)) & 3

    def table(self, codes: np.ndarray) -> np.ndarray:
        """Energy of each sequence in each structure, infinite where it can't form it."""
        b = self.bases(codes)
        out = np.full((len(codes), len(self.names)), np.inf)
        for k, (pairs, stacks) in enumerate(zip(self.pairs, self.stacks, strict=True)):
            ok = self.can[b[:, pairs[:, 0]], b[:, pairs[:, 1]]].all(axis=1)
            i, j = stacks[:, 0], stacks[:, 1]
            energy = self.stack[b[:, i], b[:, j], b[:, i + 1], b[:, j - 1]].sum(axis=1) + self.loops[k]
            out[ok, k] = np.round(energy[ok], 2)
        return out


def ensemble_of(codes: np.ndarray, energies: Energies) -> pd.DataFrame:
    table = energies.table(codes)
    at, which = np.nonzero(np.isfinite(table))
    return pd.DataFrame({"code": codes[at], "structure": np.array(energies.names, object)[which], "energy": table[at, which]})


def structure_list(structures: DataFrame, length: int, most: int = 100_000) -> list[str]:
    """The structures of a length for broadcasting, with the unfolded one; an error beyond `most`."""
    found = [r.structure for r in structures.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} structures: enumerate a shorter length")
    return [*sorted(found), "." * length]


def fold_by_enumeration(seqs: DataFrame, structures: list[str], provider=ensemble_of) -> DataFrame:
    """ensemble (code, structure, energy) of seqs (code); no shuffle, structures go to tasks whole."""
    energies = Energies(structures)

    def fold(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                yield provider(pdf["code"].to_numpy()[at : at + 2000], energies)

    return seqs.select("code").mapInPandas(fold, "code long, structure string, energy double")


class Lowest:
    """The structure of least energy for a few sequences at once, as the index that `table(codes).argmin(axis=1)` gives.

    Each pair and each stack that occurs is looked up once, and products with 0/1 matrices sum them
    by structure, in hundredths, so sums are exact.
    """

    def __init__(self, energies: Energies):
        self.bases, self.apart = energies.bases, ~energies.can
        self.stack = np.rint(energies.stack * 100).astype("float32")
        self.loops = np.rint(np.array(energies.loops) * 100).astype("float32")
        self.pairs, self.with_pair = self._incidence(energies.pairs)
        self.stacks, self.with_stack = self._incidence(energies.stacks)

    @staticmethod
    def _incidence(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        known = sorted({tuple(p) for part in parts for p in part.tolist()})
        at = {p: k for k, p in enumerate(known)}
        which = np.zeros((len(known), len(parts)), "float32")
        for k, part in enumerate(parts):
            which[[at[tuple(p)] for p in part.tolist()], k] = 1
        return np.array(known, "int64").reshape(-1, 2).T, which

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Energies in hundredths, a column for each structure; infinite where a sequence can't form it."""
        b, (i, j), (k, m) = self.bases(codes), self.pairs, self.stacks
        broken = self.apart[b[:, i], b[:, j]].astype("float32") @ self.with_pair
        energy = self.stack[b[:, k], b[:, m], b[:, k + 1], b[:, m - 1]] @ self.with_stack + self.loops
        return np.where(broken > 0, np.float32(np.inf), energy)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return self.scores(codes).argmin(axis=1)


def _two_lowest(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The structure of least energy (first of equals), that energy, and the gap to the next one."""
    rows = np.arange(len(scores))
    best = scores.argmin(axis=1)
    low = scores[rows, best].copy()
    rest = scores.copy()
    rest[rows, best] = np.inf
    return best, low, rest.min(axis=1) - low


EFFECTS = "code long, structure string, mfe double, energy_gap double, pos int, new_base int, ddg_gap double, d_mfe double"


def sequence_effects(seqs: DataFrame, structures: list[str], least_gap: float = -1.0, piece: int = 1 << 22) -> DataFrame:
    """EFFECTS of every point mutation of the folded sequences among seqs (code) whose energy gap is over least_gap.

    A sequence is folded where it lies, and so are its mutants, so nothing is shuffled. Effects are
    those of `ensemble.ddg_table`, infinite where a mutant can't form the structure; a sequence
    with one structure alone has no gap and is left out.
    """
    energies = Energies(structures)
    lowest, length = Lowest(energies), len(structures[0])
    rows = max(1, piece // len(structures))

    def effects(codes: np.ndarray) -> pd.DataFrame:
        best, low, gap = _two_lowest(lowest.scores(codes))
        kept = (best < len(structures) - 1) & np.isfinite(gap) & (np.abs(gap) > least_gap * 100)
        codes, best, low, gap = codes[kept], best[kept], low[kept], gap[kept]
        pos, turn = (x.ravel() for x in np.meshgrid(np.arange(length), np.arange(1, 4), indexing="ij"))
        shift = 2 * (length - 1 - pos)
        mutants = (codes[:, None] ^ (turn << shift)[None, :]).ravel()
        of = np.repeat(np.arange(len(codes)), len(pos))
        found = [np.zeros((3, 0))]
        for at in range(0, len(mutants), rows):
            some, own = slice(at, at + rows), of[at : at + rows]
            scores = lowest.scores(mutants[some])
            new, new_low, new_gap = _two_lowest(scores)
            held, same = scores[np.arange(len(own)), best[own]], new == best[own]
            ddg = np.where(same, new_gap - gap[own], np.where(np.isfinite(held), new_low - held - gap[own], -np.inf))
            found.append(np.stack([ddg, np.where(same, new_low, held) - low[own], new_gap]))
        ddg, d_mfe, _ = np.concatenate(found, axis=1) / 100
        base = (codes[:, None] >> shift[None, :] & 3 ^ turn[None, :]).ravel()
        names = np.array(structures, object)[best[of]]
        return pd.DataFrame({"code": codes[of], "structure": names, "mfe": low[of].astype("float64") / 100, "energy_gap": gap[of].astype("float64") / 100, "pos": np.tile(pos, len(codes)), "new_base": base, "ddg_gap": np.round(ddg, 2), "d_mfe": np.round(d_mfe, 2)})

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                yield effects(pdf["code"].to_numpy()[at : at + rows])

    return seqs.select("code").mapInPandas(run, EFFECTS)


def _dice(*parts) -> np.ndarray:
    """Repeatable 64-bit numbers from integers or arrays of them."""
    x = np.zeros(1, "uint64")
    for p in parts:
        x = (x ^ np.asarray(p).astype("uint64")) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(32))
    return x


def _chosen(code: int, draw: int, steps: int, every: int, seed: int) -> list[int]:
    """Which steps of a walk are kept: steps // every of them, without replacement; its start alone if that is none."""
    if steps < every:
        return [0]
    order = np.argsort(_dice(seed + 1, code, draw, np.arange(steps)), kind="stable")
    return np.sort(order[: steps // every]).tolist()


#: A walker, or a step that is kept (`step` not null): of a walker, `taken` steps to `now`, `idle` turns without a move, the steps to keep and how many of them are.
WALKERS = "code long, draw long, mine int, now long, taken long, idle int, chosen array<long>, kept int, step long, walked long, complete boolean"


def _advance(pdf: pd.DataFrame, lowest: Lowest, pairs: list, length: int, steps: int, seed: int, first: int, turns: int) -> pd.DataFrame:
    """Walkers after `turns` turns from turn `first` on, with the steps that are kept; walkers at their end are left out."""
    codes, draws, mine = (pdf[c].to_numpy("int64") for c in ("code", "draw", "mine"))
    now, taken, idle, kept = (pdf[c].to_numpy("int64").copy() for c in ("now", "taken", "idle", "kept"))
    chosen = np.array(pdf["chosen"].tolist(), "int64").reshape(len(pdf), -1)
    chosen = np.column_stack([chosen, np.full(len(pdf), -1)])  # no step is -1
    partner = np.full((len(pdf), length), -1)
    for k, m in enumerate(mine.tolist()):
        for a, b in pairs[m].tolist():
            partner[k, a], partner[k, b] = b, a
    put = lambda c, pos, b: c & ~(np.int64(3) << 2 * (length - 1 - pos)) | np.int64(b) << 2 * (length - 1 - pos)
    found, most = [], np.iinfo("uint64").max

    def keep(at: np.ndarray, step: np.ndarray, walked: np.ndarray) -> None:
        hit = chosen[at, kept[at]] == step
        found.append((at[hit], step[hit], walked[hit]))
        kept[at[hit]] += 1

    live = np.arange(len(pdf)) if steps > 1 else np.zeros(0, "int64")
    for turn in range(first, first + turns):
        if not len(live):
            break
        pos, here = turn % length, now[live]
        other = partner[live, pos]
        single = np.stack([put(here, pos, min(b, 3)) for b in range(6)], axis=1)
        double = np.stack([put(put(here, pos, a), np.maximum(other, 0), b) for a, b in sorted(PAIRED)], axis=1)
        options = np.where(other[:, None] >= 0, double, single)
        fits = (options != here[:, None]) & ((other[:, None] >= 0) | (np.arange(6) < 4))
        row, col = np.nonzero(fits)
        fits[row, col] = lowest(options[row, col]) == mine[live[row]]
        order = np.where(fits, _dice(seed, codes[live, None], draws[live, None], turn, np.arange(6)), most)
        moved = fits.any(axis=1)
        at = live[moved]
        # A start that moves counts as a step; one that can't is all there is of its walk.
        fresh = at[taken[at] == 1]
        keep(fresh, np.zeros(len(fresh), "int64"), now[fresh])
        now[at] = options[moved, order[moved].argmin(axis=1)]
        keep(at, taken[at], now[at])
        taken[at] += 1
        idle[live] += 1
        idle[at] = 0
        live = live[(taken[live] < steps) & (idle[live] < length)]
    stuck = np.flatnonzero((taken == 1) & ((idle >= length) | (steps <= 1)))
    found.append((stuck, np.zeros(len(stuck), "int64"), now[stuck]))
    who, step, walked = (np.concatenate(c) for c in zip(*found, strict=True))
    samples = pd.DataFrame({"code": codes[who], "draw": draws[who], "mine": mine[who], "step": step, "walked": walked, "complete": (taken[who] > 1) | (steps <= 1)})
    state = pdf.iloc[live].assign(now=now[live], taken=taken[live], idle=idle[live], kept=kept[live])
    empty = {"now": None, "taken": None, "idle": None, "chosen": None, "kept": None}
    rows = pd.concat([samples.assign(**empty), state.assign(step=None, walked=None, complete=None)], ignore_index=True).astype(object)
    return rows[[c.split()[0] for c in WALKERS.split(", ")]].where(lambda x: x.notna(), None)


def neutral_walks(starts: DataFrame, structures: list[str], steps: int, every: int, seed: int, together: int = 500, turns: int = 2600) -> DataFrame:
    """code, draw, structure, step, walked, complete of site-scanning walks, every `every`-th of `steps` neutral steps.

    starts: code and, where several walks start at a code, draw. Sites are visited in turn; at an
    unpaired site the three substitutions, at a paired one the other pairs, are tried in random
    order, and the first that keeps the structure is taken. A walk goes its full length unless a
    scan of all sites finds no neutral move. Moves can be undone, so then the start itself has
    none: it is the one row, and not complete. `together` walks of a task advance at once; a
    walk is decided by its start, its draw and the seed alone.

    Walkers are a table that is written after every `turns` turns, with the steps that are kept, which are
    chosen beforehand: no path is held, and a lost executor costs a round of its walks.
    """
    energies = Energies(structures)
    lowest = Lowest(energies)

    def begin(batches):
        for pdf in batches:
            codes, draws = pdf["code"].to_numpy("int64"), pdf["draw"].to_numpy("int64")
            mine = np.concatenate([lowest(codes[a : a + together]) for a in range(0, len(codes), together)] or [np.zeros(0, "int64")])
            picked = [_chosen(c, d, steps, every, seed) for c, d in zip(codes.tolist(), draws.tolist(), strict=True)]
            yield pd.DataFrame({"code": codes, "draw": draws, "mine": mine, "now": codes, "taken": 1, "idle": 0, "chosen": picked, "kept": 0, "step": None, "walked": None, "complete": None})

    def advance(first: int):
        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), together):
                    yield _advance(pdf.iloc[at : at + together], lowest, energies.pairs, energies.length, steps, seed, first, turns)

        return run

    draw = F.col("draw").cast("long") if "draw" in starts.columns else F.lit(1).cast("long")
    now, first, found = _kept(starts.select("code", draw.alias("draw")).mapInPandas(begin, WALKERS)), 0, None
    while not now.isEmpty():
        rows = _kept(now.mapInPandas(advance(first), WALKERS))
        samples = rows.where("step is not null")
        found = samples if found is None else found.unionByName(samples)
        now, first = rows.where("step is null"), first + turns
    names = F.array(*map(F.lit, structures))
    out = now if found is None else found
    return out.select("code", "draw", F.element_at(names, F.col("mine") + 1).alias("structure"), "step", "walked", "complete")
