"""Filter interaction audit: what each filter removes at its step, in every order of the filters.

Documents are first counted by the mask of filters that they fail, so what is left of a part, of
whatever size, is a row for each mask. A part's masks become a decision diagram: a node asks one
filter, its two edges carry counts of the documents that pass and that fail. Orders are visited so
that each differs from the one before by two neighbouring filters, which is one swap of adjacent
levels in the diagram. The path that passes all filters then reads off that order's steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, stage

LETTERS = "ABCDE"
#: What a mask's rows are counted by: documents, good ones, toxic ones.
COUNTS = ["docs", "good", "toxic"]
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (too short), B (too repetitive), C (too many capitals), D (symbols); null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def _mask(failures: list[Column]) -> Column:
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: how many documents of each source fail just the filters of a mask.

    Bit k of a mask stands for letter k of LETTERS. E fails if some smaller doc_id has the same text,
    wherever it is; a null doc_id is neither smaller nor larger than any. A null source is the
    empty part, a null text the empty text. A document is good (toxic) if any row of labels says so.
    Texts are read once; after that only digests travel, equal rows combined, so copies of one
    text are spread over their ids.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        _mask(text_failures(F.col("text"))).alias("mask"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
    )
    rows = stage(slim.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("docs")), "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    marked = rows.join(first, ["doc_id", "digest"], "left").join(said, "doc_id", "left")
    whole = marked.withColumn("mask", F.col("mask") + F.when(copy, 1 << 4).otherwise(0))
    share = lambda c: F.sum(F.col("docs") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    found = stage(whole.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), share("good"), share("toxic")), "audit-masks")
    drop_staged(rows)
    return found


def adjacent_orders(n: int):
    """All orders of n things, each but the first as the place k whose thing changed with the one at k + 1: plain changes."""
    places, ways = list(range(n)), [-1] * n
    yield tuple(places), None
    while True:
        movable = [x for x in range(n) if 0 <= places.index(x) + ways[x] < n and places[places.index(x) + ways[x]] < x]
        if not movable:
            return
        x = max(movable)
        at = places.index(x)
        k = min(at, at + ways[x])
        places[k], places[k + 1] = places[k + 1], places[k]
        for y in range(x + 1, n):
            ways[y] = -ways[y]
        yield tuple(places), k


class Diagram:
    """A reduced decision diagram over failure masks whose edges carry counts.

    A node is a pair of edges (pass, fail); an edge is its counts and the node of the next level
    below. Equal nodes of a level are one, and an edge without counts leads nowhere. As counts
    are added up along edges (what enters a node is its two edges' sum), a swap of two
    neighbouring levels makes new nodes of those two levels alone.
    """

    NOTHING = ((0, 0, 0), None)

    def __init__(self, masks: dict[int, tuple[int, ...]], n: int):
        self.order = list(range(n))
        self.levels: list[dict] = [{} for _ in range(n)]
        self.root = self._grow(list(masks.items()), 0)

    def _node(self, level: int, low, high):
        """The edge to the one node with these two edges."""
        total = tuple(a + b for a, b in zip(low[0], high[0], strict=True))
        if not total[0]:
            return self.NOTHING
        known = self.levels[level]
        return total, known.setdefault((low, high), (level, low, high))

    def _grow(self, rows, level: int):
        if level == len(self.order):
            return tuple(map(sum, zip(*(c for _, c in rows), strict=True))) if rows else (0, 0, 0), None
        parts = [[(m, c) for m, c in rows if m >> self.order[level] & 1 == side] for side in (0, 1)]
        return self._node(level, *(self._grow(p, level + 1) for p in parts))

    def swap(self, k: int) -> None:
        """Levels k and k + 1 change places; what lies below stays as it is, what lies above is pointed at the new nodes."""
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
        above = self.levels[: k + 1]
        self.levels[k], self.levels[k + 1] = {}, {}
        memo: dict = {}

        def turned(edge):
            _, node = edge
            if node is None:
                return edge
            if id(node) not in memo:
                (_, low, high) = node
                ll, lh = low[1][1:] if low[1] else (self.NOTHING, self.NOTHING)
                hl, hh = high[1][1:] if high[1] else (self.NOTHING, self.NOTHING)
                memo[id(node)] = self._node(k, self._node(k + 1, ll, hl), self._node(k + 1, lh, hh))
            return memo[id(node)]

        def rebuilt(edge):
            node = edge[1]
            if node is None:
                return edge
            if node[0] == k:
                return turned(edge)
            if id(node) not in memo:
                memo[id(node)] = self._node(node[0], rebuilt(node[1]), rebuilt(node[2]))
            return memo[id(node)]

        for level in range(k):
            self.levels[level] = {}
        # Nodes above are kept alive until all of them are replaced, so that their ids stay theirs.
        self.root = rebuilt(self.root)
        del above

    def all_pass(self):
        """For each level, what enters it when all before have passed, and what passes it."""
        edge = self.root
        for _ in self.order:
            low = edge[1][1] if edge[1] else self.NOTHING
            yield edge[0], low[0]
            edge = low


def diagram_steps(masks: dict[int, tuple[int, ...]], letters: str = LETTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) over all orders of the letters."""
    n = len(letters)
    failing = [sum(c[0] for m, c in masks.items() if m >> f & 1) for f in range(n)]
    alone = [masks.get(1 << f, (0, 0, 0))[0] for f in range(n)]
    diagram, removed_by, found = Diagram(masks, n), [0] * n, []
    for order, k in adjacent_orders(n):
        if k is not None:
            diagram.swap(k)
        assert tuple(diagram.order) == order
        name = "".join(letters[f] for f in order)
        for step, (f, (came, went)) in enumerate(zip(order, diagram.all_pass(), strict=True), 1):
            lost = [a - b for a, b in zip(came, went, strict=True)]
            removed_by[f] += lost[0]
            found.append((name, step, f, went[0], lost[0], failing[f] - lost[0], alone[f], lost[1], lost[2]))
    return [(name, step, *rest, removed_by[f]) for name, step, f, *rest in found]


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """STEPS of every part of masks (part, mask, docs, good, toxic): a diagram for each part, in the task that has the part.

    Masks of a part that come twice are added up. At most 2^n rows make up a part of n filters; n! orders come out, so n is 8 at most.
    """
    if len(letters) > 8:
        raise ValueError("all orders of more than 8 filters are too many")
    names = STEPS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: dict[int, np.ndarray] = {}
        for mask, *counts in pdf[["mask", *COUNTS]].itertuples(index=False):
            sums[int(mask)] = sums.get(int(mask), 0) + np.array(counts, "int64")
        rows = diagram_steps({m: tuple(map(int, c)) for m, c in sums.items()}, letters)
        return pd.DataFrame([(pdf["part"].iloc[0], *r) for r in rows], columns=names)

    combined = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return combined.groupBy("part").applyInPandas(steps, STEPS)


def audit_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """STEPS of all 120 orders of A to E for each source of docs; an empty table has no parts and gives no rows."""
    return audit(failure_masks(docs, labels))
