"""All structures of a length: counted, numbered, sampled, and as a trie that sequences descend.

Structures follow one grammar: a stretch of sites is empty, or an unpaired site and a stretch, or a
helix (pairs right inside each other, as many as there are) and a stretch. What a helix encloses
has three sites at least and is no helix that fills it, as that would be the same helix.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HAIRPIN_SITES = 3
#: Codes of two bits a site hold structures of this many sites.
LONGEST = 31


@lru_cache(maxsize=64)
def counts(length: int, least: int) -> tuple[list[int], list[int], list[int]]:
    """How many stretches, helices and insides of helices there are of each number of sites; helices have `least` pairs or more."""
    stretch, helix, inside = [1], [0], [0]
    for n in range(1, length + 1):
        helix.append(sum(inside[n - 2 * m] for m in range(least, n // 2 + 1)))
        inside.append(stretch[n - 1] + sum(helix[k] * stretch[n - k] for k in range(1, n)) if n >= HAIRPIN_SITES else 0)
        stretch.append(stretch[n - 1] + sum(helix[k] * stretch[n - k] for k in range(1, n + 1)))
    return stretch, helix, inside


def how_many(length: int, isolated: bool = False) -> int:
    """Structures of a length with at least one pair."""
    return counts(length, 1 if isolated else 2)[0][length] - 1


def nth_structure(rank: int, length: int, least: int = 2) -> str:
    """The structure of a rank from 1 to how_many; rank 0 is the unfolded one. Choices are undone one by one, each by what it leaves to choose from."""
    stretch, helix, inside = counts(length, least)
    out = []
    todo = [(rank, length, False)]  # rank, sites and whether a stretch is the inside of a helix; texts are taken as they are
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            out.append(top)
            continue
        rank, n, inner = top
        if n == 0:
            continue
        if rank < stretch[n - 1]:
            out.append(".")
            todo.append((rank, n - 1, False))
            continue
        rank -= stretch[n - 1]
        for k in range(1, n + (not inner)):
            ways = helix[k] * stretch[n - k]
            if rank < ways:
                break
            rank -= ways
        own, after = divmod(rank, stretch[n - k])
        todo.append((after, n - k, False))
        for m in range(least, k // 2 + 1):
            if own < inside[k - 2 * m]:
                break
            own -= inside[k - 2 * m]
        todo += [")" * m, (own, k - 2 * m, True), "(" * m]
    return "".join(out)


def shuffled_rank(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A permutation of 0 to size - 1, by four rounds of a Feistel network on just enough bits; values that fall outside go round again."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), x.astype("uint64")
    away = np.ones(len(x), bool)
    while away.any():
        left, right = x[away] >> np.uint64(half), x[away] & mask
        for turn in range(4):
            mixed = (right + np.uint64(seed * 4 + turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & mask)
        x[away] = left << np.uint64(half) | right
        away = x >= size
    return x.astype("int64")


def enumerate_structures(spark: SparkSession, length: int, isolated: bool = False, num_samples: int | None = None, seed: int = 0) -> DataFrame:
    """structure: every structure of a length with a pair, hairpins of three sites at least, and, unless wanted, no lonely pair.

    Each is found from its number alone, so there is no frontier and no shuffle. With num_samples, that
    many distinct ones in an order that the seed decides, or all if there are no more.
    """
    total, least = how_many(length, isolated), 1 if isolated else 2
    if total >= 1 << 62:
        raise ValueError(f"more structures of {length} sites than can be numbered")
    chosen = total if num_samples is None else min(num_samples, total)

    def build(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            ranks = ids if num_samples is None else shuffled_rank(ids, total, seed)
            yield pd.DataFrame({"structure": [nth_structure(r + 1, length, least) for r in ranks.tolist()]})

    return spark.range(chosen).mapInPandas(build, "structure string")


def structure_keys(structures: list[str]) -> np.ndarray:
    """Two bits a site, `(` 0, `)` 1, `.` 2: ordered as the texts are."""
    codes = np.frombuffer("".join(structures).encode(), "uint8").reshape(len(structures), -1)
    digits = np.where(codes == ord("."), 2, codes - ord("(")).astype("int64")
    key = np.zeros(len(structures), "int64")
    for column in digits.T:
        key = key << 2 | column
    return key


def structures_of_keys(keys: np.ndarray, length: int) -> np.ndarray:
    symbols = np.frombuffer(b"().", "uint8")[keys[:, None] >> 2 * np.arange(length - 1, -1, -1) & 3]
    return np.ascontiguousarray(symbols).view(f"S{length}").ravel().astype(str).astype(object)


def _helices(length: int, least: int) -> list[tuple[int, int, int]]:
    """(first site, last site, pairs) of every helix that a structure of a length can have."""
    return [(i, j, m) for i in range(length) for j in range(i + 2 * least + HAIRPIN_SITES - 1, length) for m in range(least, (j - i + 1 - HAIRPIN_SITES) // 2 + 1)]


def _subtree(root: tuple[int, int, int], number: dict, length: int, least: int, loops: tuple[int, int, int]) -> dict[str, np.ndarray]:
    """The structures whose first helix is `root`, in preorder: depth, last helix, loop energy, stacks, key.

    Helices are added in the order of their first sites, so a structure without its last helix is
    its parent. `loops` are the energies of what a helix encloses: nothing paired, one helix, several.
    """
    hairpin, inner, multi = loops
    depths, helices, energies, stacks, keys = [], [], [], [], []
    dot = sum(2 << 2 * k for k in range(length))
    # A region: from, to, and the helix around it as its number in `kids` (None outside), whose whole inside may not be one helix.
    def add(helix, depth, energy, stacked, key, regions, kids):
        i, j, m = helix
        for t in range(m):
            key -= 2 << 2 * (length - 1 - i - t)
            key -= 1 << 2 * (length - 1 - j + t)
        energy, stacked = energy + hairpin, stacked + m - 1
        depths.append(depth), helices.append(number[helix]), energies.append(energy), stacks.append(stacked), keys.append(key)
        open_ = [(i + m, j - m + 1, len(kids), True), *regions]
        kids = (*kids, 0)
        for at, (lo, hi, around, whole) in enumerate(open_):
            for a in range(lo, hi - 2 * least - HAIRPIN_SITES + 1):
                for b in range(a + 2 * least + HAIRPIN_SITES - 1, hi):
                    if whole and a == lo and b == hi - 1:
                        continue
                    n = 0 if around is None else kids[around]
                    more = energy if around is None or n > 1 else energy + (inner - hairpin if n == 0 else multi - inner)
                    now = kids if around is None else (*kids[:around], n + 1, *kids[around + 1 :])
                    left = [(b + 1, hi, around, False), *open_[at + 1 :]]
                    for size in range(least, (b - a + 1 - HAIRPIN_SITES) // 2 + 1):
                        add((a, b, size), depth + 1, more, stacked, key, left, now)

    add(root, 1, 0, 0, dot, [(root[1] + 1, length, None, False)], ())
    kinds = {"depth": (depths, "int8"), "helix": (helices, "int16"), "loops": (energies, "int16"), "stacks": (stacks, "int8"), "key": (keys, "int64")}
    return {c: np.array(v, kind) for c, (v, kind) in kinds.items()}


FIELDS = ("depth", "helix", "loops", "stacks", "key")


@dataclass
class Trie:
    """Structures as nodes of a trie of helices, level by level, children side by side; node 0 is the unfolded one.

    below: the least loop energy of what lies under a node, with every further stack counted as
    `best`, the lowest energy that any stack has; a bound for what a descent can still find.
    """

    length: int
    helices: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    kids: np.ndarray
    helix: np.ndarray
    loops: np.ndarray
    below: np.ndarray
    key: np.ndarray

    @staticmethod
    def assemble(parts: list[dict[str, np.ndarray]], length: int, least: int, best: int) -> Trie:
        """From subtrees in preorder, in the order of their first helices."""
        root = {"depth": [0], "helix": [0], "loops": [0], "stacks": [0], "key": [sum(2 << 2 * k for k in range(length))]}
        depth, helix, loops, stacks, key = (np.concatenate([np.array(root[c], parts[0][c].dtype if parts else "int64"), *[p[c] for p in parts]]) for c in FIELDS)
        n = len(depth)
        order = np.argsort(depth, kind="stable")
        place = np.empty(n, "int64")
        place[order] = np.arange(n)
        # In preorder a node's parent is the last one before it that is one level up.
        parent = np.zeros(n, "int64")
        for d in range(1, int(depth.max()) + 1):
            at, up = np.flatnonzero(depth == d), np.flatnonzero(depth == d - 1)
            parent[at] = up[np.searchsorted(up, at) - 1]
        parent = place[parent[order]]
        parent[0] = 0
        kids = np.bincount(parent[1:], minlength=n)
        first = 1 + np.cumsum(kids) - kids
        bound = loops[order].astype("int64") + best * stacks[order].astype("int64")
        under = np.full(n, 1 << 20, "int64")
        for d in range(int(depth.max()), 0, -1):
            at = np.flatnonzero(depth[order] == d)
            np.minimum.at(under, parent[at], np.minimum(bound[at], under[at]))
        below = np.minimum(under - best * stacks[order].astype("int64"), 32_000)
        return Trie(length, np.array(_helices(length, least), "int8"), parent.astype("int32"), first.astype("int32"), kids.astype("int32"), helix[order], loops[order].astype("int16"), below.astype("int16"), key[order])

    ARRAYS = ("helices", "parent", "first", "kids", "helix", "loops", "below", "key")

    def save(self, folder: str, name: str) -> list[str]:
        paths = [os.path.join(folder, f"{name}-{c}.npy") for c in self.ARRAYS]
        for path, c in zip(paths, self.ARRAYS, strict=True):
            np.save(path, getattr(self, c))
        return paths

    @staticmethod
    def mapped(length: int, name: str, found=SparkFiles.get) -> Trie:
        return Trie(length, *[np.load(found(f"{name}-{c}.npy"), mmap_mode="r") for c in Trie.ARRAYS])


def build_trie(spark: SparkSession, length: int, loops: tuple[int, int, int], best: int, isolated: bool = False) -> Trie:
    """The trie of a length: tasks build the subtrees of the first helices, whose flat arrays are put together here.

    The number of structures is known beforehand and bounded by the length, and over 2^24 is an error.
    """
    least = 1 if isolated else 2
    if length > LONGEST or how_many(length, isolated) > 1 << 24:
        raise ValueError(f"too many structures of {length} sites for a trie")
    helices = _helices(length, least)
    number = {h: k for k, h in enumerate(helices)}

    def build(batches):
        for pdf in batches:
            for k in pdf["id"].tolist():
                yield pd.DataFrame([{"id": k} | {c: v.tobytes() for c, v in _subtree(helices[k], number, length, least, loops).items()}])

    if not helices:
        return Trie.assemble([], length, least, best)
    # Early helices have the largest subtrees, so they are dealt round.
    tasks = min(len(helices), 8 * spark.sparkContext.defaultParallelism)
    dealt = spark.range(len(helices)).repartition(tasks, F.col("id") % tasks)
    rows = dealt.mapInPandas(build, "id long, " + ", ".join(f"{c} binary" for c in FIELDS)).collect()  # bounded by the length
    kinds = dict(zip(FIELDS, ("int8", "int16", "int16", "int8", "int64"), strict=True))
    return Trie.assemble([{c: np.frombuffer(r[c], kinds[c]) for c in FIELDS} for r in sorted(rows)], length, least, best)


def share_trie(spark: SparkSession, trie: Trie, name: str) -> str:
    """Hands the trie's arrays to all tasks as files, which map them; the name to map them by."""
    name = f"{name}-{trie.length}-{len(trie.key)}"
    for path in trie.save(tempfile.mkdtemp(prefix="trie-"), name):  # Spark copies the files to the executors from here
        spark.sparkContext.addFile(path)
    return name
