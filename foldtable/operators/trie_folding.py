"""Folding and effects of mutations by descent in the trie of all structures.

A sequence follows only helices whose pairs it can form, and turns back where what lies below can't
be lower than the two lowest energies it has seen. Results are those of scoring it against
every structure, and of long sequences a small share of the trie is visited.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folding import EFFECTS, HAIRPIN, INNER, MULTI, PAIRED, _stack_energies
from .sampling import random_sequences, sample_until_distinct
from .structure import count_pairs
from .structure_space import Trie, build_trie, share_trie, structures_of_keys

#: Hundredths of a unit, in which sums are exact.
LOOPS = tuple(round(100 * x) for x in (HAIRPIN, INNER, MULTI))
FAR = np.int32(1 << 20)


def folding_trie(spark, length: int) -> str:
    """The trie of a length under this energy model, handed to all tasks; its name."""
    return share_trie(spark, build_trie(spark, length, LOOPS, round(100 * _stack_energies().min())), "fold")


class Descent:
    """Folds batches of coded sequences by descent in a trie; `visited` and `folded` count nodes and sequences."""

    def __init__(self, trie: Trie):
        self.trie, self.length = trie, trie.length
        self.i, self.j, self.m = trie.helices.astype("int64").T
        self.can = np.zeros((4, 4), bool)
        for a, b in PAIRED:
            self.can[a, b] = True
        self.stack = np.rint(_stack_energies() * 100).astype("int32")
        self.visited = self.folded = 0

    def helix_energies(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the stacks of each helix in each sequence, FAR where some pair can't be formed."""
        b = (codes[:, None] >> 2 * np.arange(self.length - 1, -1, -1) & 3).astype("int64")
        pair = self.can[b[:, :, None], b[:, None, :]]
        here, there = b[:, :-1, None], b[:, None, 1:]
        # stacked[i, j]: pair (i, j) on pair (i + 1, j - 1)
        step = np.full((len(codes), self.length, self.length), FAR, "int32")
        inner = self.stack[here, there, b[:, 1:, None], b[:, None, :-1]]
        step[:, :-1, 1:] = np.where(pair[:, :-1, 1:] & pair[:, 1:, :-1], inner, FAR)
        out = np.where(pair[:, self.i, self.j], np.int32(0), FAR)
        for t in range(int(self.m.max(initial=1)) - 1):
            at = np.flatnonzero(self.m > t + 1)
            old, more = out[:, at], step[:, self.i[at] + t, self.j[at] - t]
            out[:, at] = np.where((old < FAR) & (more < FAR), old + more, FAR)
        return out

    def fold(self, energies: np.ndarray, limit: np.ndarray | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node of least energy (of equals the first as text), that energy, and the next lowest energy (FAR without one), in hundredths.

        energies: as `helix_energies` gives them. limit: what the next lowest energies are known not to
        exceed. seen: gets (sequence, node, energy) of what is visited.
        """
        t, n = self.trie, len(energies)
        low, second, best = np.zeros(n, "int32"), np.full(n, FAR, "int32"), np.zeros(n, "int64")
        seq, node, held = np.arange(n), np.zeros(n, "int64"), np.zeros(n, "int32")
        limit = np.full(n, FAR, "int32") if limit is None else limit
        flat, width = energies.ravel(), energies.shape[1]
        self.folded += n
        while len(seq):
            most = np.minimum(second, limit)
            # What only equals the second lowest matters where it may be the lowest, too, and come first as text.
            most = np.where((most < second) | (low == second), most, most - 1)
            go = (t.kids[node] > 0) & (held + t.below[node] <= most[seq])
            seq, node, held = seq[go], node[go], held[go]
            kids = t.kids[node].astype("int64")
            ends = np.cumsum(kids)
            if not len(seq):
                break
            child = np.arange(ends[-1]) + np.repeat(t.first[node] - (ends - kids), kids)
            own = flat[np.repeat(seq * width, kids) + t.helix[child]]
            fits = np.flatnonzero(own < FAR)
            of = np.searchsorted(ends, fits, side="right")
            seq, node, held = seq[of], child[fits], held[of] + own[fits]
            self.visited += len(seq)
            if len(seq):
                energy = held + t.loops[node]
                self._lower(seq, node, energy, low, second, best)
                if seen is not None:
                    seen.append((seq, node, energy))
        return best, low, second

    def _lower(self, seq, node, energy, low, second, best) -> None:
        """Takes the energies of nodes, which come sequence by sequence, into the two lowest."""
        key = self.trie.key
        starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        who, sizes = seq[starts], np.diff(np.append(starts, len(seq)))
        least = np.minimum.reduceat(energy, starts)
        first = energy == np.repeat(least, sizes)
        ways = np.add.reduceat(first.astype("int32"), starts)
        other = np.minimum.reduceat(np.where(first, FAR, energy), starts)
        other = np.where(ways > 1, least, other)
        at = np.flatnonzero(first)
        names = np.full(len(who), np.iinfo("int64").max)
        np.minimum.at(names, np.repeat(np.arange(len(who)), sizes)[at], key[node[at]])
        mine = np.flatnonzero(key[node] == np.repeat(names, sizes))
        mine = mine[first[mine]]
        chosen = np.zeros(len(who), "int64")
        chosen[np.repeat(np.arange(len(who)), sizes)[mine]] = node[mine]
        below, equal = least < low[who], least == low[who]
        second[who] = np.where(below, np.minimum(low[who], other), np.where(equal, low[who], np.minimum(second[who], least)))
        better = below | (equal & (names < key[best[who]]))
        low[who] = np.minimum(low[who], least)
        best[who] = np.where(better, chosen, best[who])

    def _lowest_nodes(self, seen: list, n: int, most: int = 6) -> np.ndarray:
        """A few nodes of least energy of each of n sequences, 0 where there are fewer."""
        out = np.zeros((n, most), "int64")
        if seen:
            seq, node, energy = (np.concatenate(c) for c in zip(*seen, strict=True))
            order = np.lexsort((energy, seq))
            seq, node = seq[order], node[order]
            rank = np.arange(len(seq)) - np.searchsorted(seq, seq)
            out[seq[rank < most], rank[rank < most]] = node[rank < most]
        return out

    def energy_of(self, energies: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Energy of the structure of a node in each row's sequence, FAR where it can't form it."""
        t, total = self.trie, self.trie.loops[nodes].astype("int64")
        at, broken = nodes.copy(), np.zeros(len(nodes), bool)
        while at.any():
            own = np.where(at > 0, energies[rows, t.helix[at]], 0)
            broken |= own == FAR
            total += own
            at = t.parent[at].astype("int64")
        return np.where(broken, FAR, total)

    def effects(self, codes: np.ndarray, least_gap: float) -> pd.DataFrame:
        """EFFECTS of the point mutations of those codes that fold with a gap over least_gap."""
        length, seen = self.length, []
        best, low, second = self.fold(self.helix_energies(codes), seen=seen)
        near = self._lowest_nodes(seen, len(codes))
        kept = (best > 0) & (second < FAR) & (np.abs(second - low) > least_gap * 100)
        codes, best, low, gap, near = codes[kept], best[kept], low[kept], (second - low)[kept], near[kept]
        pos, turn = (x.ravel() for x in np.meshgrid(np.arange(length), np.arange(1, 4), indexing="ij"))
        shift = 2 * (length - 1 - pos)
        mutants = (codes[:, None] ^ (turn << shift)[None, :]).ravel()
        of = np.repeat(np.arange(len(codes)), len(pos))
        ddg, d_mfe = np.zeros(len(mutants)), np.zeros(len(mutants))
        step = 64
        for a in range(0, len(mutants), step):
            some, own = mutants[a : a + step], of[a : a + step]
            energies = self.helix_energies(some)
            # What a sequence's lowest structures have in the mutant bounds the mutant's two lowest energies.
            rows = np.repeat(np.arange(len(some)), near.shape[1])
            known = np.where(near[own] > 0, self.energy_of(energies, rows, near[own].ravel()).reshape(len(some), -1), FAR)
            known = np.sort(np.column_stack([known, np.zeros(len(some), "int64")]), axis=1)
            new, new_low, new_second = self.fold(energies, limit=known[:, 1].astype("int32"))
            held = self.energy_of(energies, np.arange(len(some)), best[own])
            same, fits = new == best[own], held < FAR
            new_gap = np.where(new_second < FAR, new_second - new_low, np.inf)
            ddg[a : a + step] = np.where(same, new_gap - gap[own], np.where(fits, new_low - held - gap[own], -np.inf))
            d_mfe[a : a + step] = np.where(same, new_low, np.where(fits, held, np.inf)) - low[own]
        base = (codes[:, None] >> shift[None, :] & 3 ^ turn[None, :]).ravel()
        names = structures_of_keys(self.trie.key[best], length)
        return pd.DataFrame({
            "code": codes[of], "structure": names[of], "mfe": low[of] / 100, "energy_gap": gap[of] / 100, "pos": np.tile(pos, len(codes)),
            "new_base": base, "ddg_gap": np.round(ddg / 100, 2), "d_mfe": np.round(d_mfe / 100, 2),
        })


_tries: dict[str, Trie] = {}


def _mapped(length: int, name: str) -> Trie:
    """A task's trie, mapped once in a worker."""
    return _tries.get(name) or _tries.setdefault(name, Trie.mapped(length, name))


def trie_effects(seqs: DataFrame, length: int, least_gap: float = -1.0, together: int = 64) -> DataFrame:
    """EFFECTS as `folding.sequence_effects` gives them, by descent: no list of structures travels, and nothing is shuffled."""
    name = folding_trie(seqs.sparkSession, length)

    def run(batches):
        descent = Descent(_mapped(length, name))
        for pdf in batches:
            for at in range(0, len(pdf), together):
                yield descent.effects(pdf["code"].to_numpy()[at : at + together], least_gap)

    return seqs.select("code").mapInPandas(run, EFFECTS)


def trie_folds(seqs: DataFrame, length: int, together: int = 64) -> DataFrame:
    """code, structure, mfe, energy_gap (null without a second structure) and visited, the share of the trie's nodes that the code's batch went through."""
    return _folds(seqs, length, folding_trie(seqs.sparkSession, length), together)


def _folds(seqs: DataFrame, length: int, name: str, together: int = 64) -> DataFrame:
    def run(batches):
        descent = Descent(_mapped(length, name))
        for pdf in batches:
            for at in range(0, len(pdf), together):
                codes, before = pdf["code"].to_numpy()[at : at + together], descent.visited
                best, low, second = descent.fold(descent.helix_energies(codes))
                share = (descent.visited - before) / len(codes) / len(descent.trie.key)
                gap = np.where(second < FAR, (second - low) / 100, np.nan)
                yield pd.DataFrame({"code": codes, "structure": structures_of_keys(descent.trie.key[best], length), "mfe": low / 100, "energy_gap": gap, "visited": share})

    return seqs.select("code").mapInPandas(run, "code long, structure string, mfe double, energy_gap double, visited double")


def sampled_structures(spark, length: int, wanted: int, per_structure: int = 1000, seed: int = 1, batch: int = 10_000, pairs: int | None = None) -> DataFrame:
    """structure: at least per_structure * wanted different ones into which random sequences of a length fold.

    Sequences are drawn and folded in rounds until there are enough (`sampling.sample_until_distinct`).
    Unfolded ones don't count; with `pairs`, only structures of that many pairs do. `sampling.weighted_sample`
    then draws `wanted` of them with every number of stacks as likely as any other.
    """
    name = folding_trie(spark, length)

    def draw(first: int, n: int) -> DataFrame:
        seqs = random_sequences(spark.range(first, first + n), length, seed).select("code")
        found = _folds(seqs, length, name).select("structure")
        return found.where(F.col("structure").contains("(") if pairs is None else count_pairs(F.col("structure")) == pairs)

    return sample_until_distinct(draw, per_structure, wanted, batch)
