"""Connected components of a large edge list, by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable number of each of n nodes, for edges held in memory."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for ends in (root[a], root[b], a, b):
            np.minimum.at(new, ends, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _rank(node: Column, turn: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(turn)), node)


def _round(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Nodes join their neighbour of lowest random rank, or the one that it joins, if that one stays."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min(_rank(F.col("b"), turn)).alias("r"))
    moved = lowest.where(F.col("r") < _rank(F.col("a"), turn)).select(F.col("a").alias("node"), F.col("r")["b"].alias("parent"))
    below = stage(moved, "cc-below")
    upper = below.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
    jumped = below.join(upper, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"))
    moved = stage(jumped.join(upper.select("parent"), "parent", "left_anti").select("node", "parent"), "cc-parents")
    drop_staged(below)
    to = lambda c: moved.select(F.col("node").alias(c), F.col("parent").alias(f"to_{c}"))
    # Plain reads on both sides, so that the adaptive skew join splits the edges of a hub.
    left = edges.join(to("a"), "a", "left").select(F.coalesce("to_a", "a").alias("a"), "b")
    left = stage(left, "cc-half")
    new = left.join(to("b"), "b", "left").select("a", F.coalesce("to_b", "b").alias("b")).where("a <> b")
    new = stage(new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    drop_staged(left)
    return moved, new


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b), component being the smallest node in it.

    Nodes are of any type that has an order.

    A constant share of the nodes that still have edges is expected to disappear in a round,
    however long the paths or large the hubs are. Loops and repeated or reversed edges change nothing;
    edges with a null end are ignored; no edges give no rows. All state between rounds is in
    files of the shared folder.
    """
    first = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = stage(first.where("a <> b and a is not null and b is not null").distinct(), "cc-edges")
    moves = []
    while not now.isEmpty():
        moved, new = _round(now, len(moves))
        drop_staged(now)
        moves.append(moved)
        now = new
    if not moves:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = moves.pop()
    while moves:
        earlier = moves.pop()
        later = found.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        joined = earlier.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
        merged = stage(joined.unionByName(found), "cc-found")
        drop_staged(earlier)
        drop_staged(found)
        found = merged
    roots = found.groupBy("parent").agg(F.least(F.min("node"), F.col("parent")).alias("component"))
    roots = stage(roots, "cc-roots")
    members = found.join(roots, "parent").select("node", "component")
    return stage(members.unionByName(roots.select(F.col("parent").alias("node"), "component")), "cc-members")
