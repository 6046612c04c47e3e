"""Neutral components, edges and versatility by site groups.

Sequences of one structure that agree outside one site are all neighbours, so a group on
(structure, site, code with the site masked) holds at most four members and replaces a join. Which
members it has is four bits, that combine before the shuffle and to which repeated rows add nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..sources.tables import drop_path, new_path
from .mutate import site_groups


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: loops keep short plans and survive lost executors."""
    path = new_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(*kept: DataFrame) -> None:
    """Deletes the files of _kept frames that nothing reads any more."""
    for df in kept:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            drop_path(df.sparkSession, folder)


def base_groups(seqs: DataFrame, length: int, codes=codec) -> DataFrame:
    """structure, pos, masked, bases: which of the four bases (bit b for base b) sequences of a structure have at a site, all else being equal."""
    rows = site_groups(seqs.select("structure", "code"), length, codes)
    bit = F.call_function("shiftleft", F.lit(1), codes.base_at(F.col("code"), F.col("pos"), length))
    return rows.groupBy("structure", "pos", "masked").agg(F.bit_or(bit).alias("bases"))


def _members(length: int, codes=codec) -> Column:
    """Codes of the members of a group, ascending."""
    there = F.filter(F.array(*map(F.lit, range(4))), lambda b: F.call_function("shiftright", F.col("bases"), b).bitwiseAND(F.lit(1)) == 1)
    return F.transform(there, lambda b: codes.with_base(F.col("masked"), F.col("pos"), b, length))


#: Edges that one task takes at once.
IN_ONE_TASK = 1 << 19


def _finished(edges: DataFrame) -> DataFrame:
    """What _contracted gives, of edges (structure, a, b) few enough for one task, whose codes are integers."""
    kind = f"structure string, node {edges.schema['a'].dataType.simpleString()}, label {edges.schema['a'].dataType.simpleString()}"

    def run(batches):
        whole = pd.concat([pd.DataFrame({"structure": [], "a": [], "b": []}), *batches], ignore_index=True)
        if not len(whole):
            return
        names, s = np.unique(whole["structure"].to_numpy(str), return_inverse=True)
        ends = np.concatenate([whole["a"].to_numpy("int64"), whole["b"].to_numpy("int64")])
        order = np.lexsort((ends, np.tile(s, 2)))
        sorted_s, sorted_ends = np.tile(s, 2)[order], ends[order]
        new = np.concatenate([[True], (sorted_s[1:] != sorted_s[:-1]) | (sorted_ends[1:] != sorted_ends[:-1])])
        # Nodes are numbered by structure and code, so the smallest number that is reached has the smallest code.
        number = np.empty(len(order), "int64")
        number[order] = np.cumsum(new) - 1
        a, b = number[: len(whole)], number[len(whole) :]
        root = np.arange(int(new.sum()))
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            for side in (root[a], root[b]):
                np.minimum.at(root, side, low)
            while (root[root] != root).any():
                root = root[root]
        moved = np.flatnonzero(root != np.arange(len(root)))
        codes, owner = sorted_ends[new], names[sorted_s[new]]
        yield pd.DataFrame({"structure": owner[moved], "node": codes[moved], "label": codes[root[moved]]})

    return edges.coalesce(1).mapInPandas(run, kind)


def _contracted(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """structure, node, label of all ends of edges (structure, a < b): the smallest code that edges lead to, for ends that aren't that themselves.

    Edges are contracted by rounds until they fit into one task, which finishes. Each round moves a label to its smallest neighbour, jumps twice, and rewrites the edges; those
    within one label go, so what is shuffled falls from round to round and components that are
    done take no part.
    """
    moves, now = [], _kept(edges)
    keys = ["structure"]
    plain = edges.schema["a"].dataType.simpleString() == "bigint"
    while (left := now.count()) and not (plain and left <= in_one_task):
        hooks = _kept(now.groupBy(*keys, F.col("b").alias("node")).agg(F.min("a").alias("to")))
        ahead = hooks.select(*keys, F.col("node").alias("to"), F.col("to").alias("far"))
        low = hooks
        for _ in range(2):
            low = low.join(ahead, [*keys, "to"], "left").select(*keys, "node", F.coalesce("far", "to").alias("to"))
        low = _kept(low)
        _drop(hooks)
        at = lambda end: low.select(*keys, F.col("node").alias(end), F.col("to").alias(f"to_{end}"))
        moved = now.join(at("a"), [*keys, "a"], "left").join(at("b"), [*keys, "b"], "left").select(*keys, F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        new = _kept(moved.where("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        _drop(now)
        moves.append(low)
        now = new
    if left:
        found = _kept(_finished(now))
    elif moves:
        found = moves.pop().withColumnRenamed("to", "label")
    else:
        return edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("label")).limit(0)
    _drop(now)
    while moves:
        earlier = moves.pop()
        ahead = found.select(*keys, F.col("node").alias("to"), "label")
        # A node that others moved to while it moved itself comes again, as their label.
        later = found.join(earlier.select(*keys, "node"), [*keys, "node"], "left_anti").select(*keys, "node", "label")
        merged = _kept(earlier.join(ahead, [*keys, "to"], "left").select(*keys, "node", F.coalesce("label", "to").alias("label")).unionByName(later))
        _drop(earlier, found)
        found = merged
    return found


def neutral_components(seqs: DataFrame, length: int, codes=codec, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """seqs (code, structure) with nc_id, the smallest code that neutral point mutations reach. codes: `codec`, or `wide_codec` for long sequences.

    Sequences are dealt to site groups once; each group links its members to its smallest. Repeated
    rows are one; a null structure is a structure of its own; no rows give none.
    """
    members = base_groups(seqs.withColumn("structure", F.coalesce("structure", F.lit(""))), length, codes).withColumn("m", _members(length, codes)).where(F.size("m") > 1)
    edges = members.select("structure", F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 3)).alias("b"))
    labels = _contracted(edges, in_one_task).select(F.col("structure").alias("_s"), F.col("node").alias("_c"), "label")
    same = (F.coalesce("structure", F.lit("")) == F.col("_s")) & (F.col("code") == F.col("_c"))
    return seqs.select("code", "structure").distinct().join(labels, same, "left").select("code", "structure", F.coalesce("label", "code").alias("nc_id"))


def neutral_edges(seqs: DataFrame, length: int) -> DataFrame:
    """structure, code_a < code_b of neighbouring sequences of equal structure, each once."""
    groups = base_groups(seqs, length).withColumn("m", _members(length)).where(F.size("m") > 1)
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return groups.select("structure", F.explode(pairs).alias("e")).select("structure", F.col("e.a").alias("code_a"), F.col("e.b").alias("code_b"))


def site_versatility(seqs: DataFrame, length: int) -> DataFrame:
    """code, structure, pos, versatility: the share of the three mutants that keep the structure; repeated rows are one."""
    groups = base_groups(seqs, length)
    return groups.select(F.explode(_members(length)).alias("code"), "structure", "pos", ((F.bit_count("bases") - 1) / 3).alias("versatility"))
