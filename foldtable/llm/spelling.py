"""Spelling variants: words that differ by one code point, found by walking a trie of all words in step.

The trie is a table of edges. A state is a pair of its nodes: the first stands for (word, position)
of every word that begins with it, the second is the node that the other word has come to, and
between them lies just one edit. All words with a prefix share its states, so no node, the root
included, is met more often than it has edges. Level by level, states are joined with the
edge table on both nodes; where both end, two words are neighbours.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_lists, drop_staged, slices, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, LEAST, SPOILED = 5, 3, 97
RATIO = 2
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
U64 = np.uint64


def spoiled_words(text: bytes, doc_id, shortest: int = SHORTEST, every: int = SPOILED) -> dict[str, int]:
    """The words of a text with their counts: runs in lower case (A-Z alone), of which one in `every` loses a code point, as the document's id says."""
    counts: dict[str, int] = {}
    for run in RUN.findall(text.lower().decode()):  # lower() of bytes changes A-Z alone
        if len(run) >= shortest:
            counts[run] = counts.get(run, 0) + 1
    seed, found = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), {}
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), seed)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        found[run] = found.get(run, 0) + n
    return found


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, held: int = HELD) -> DataFrame:
    """word, n: words of at least `shortest` code points and `least` occurrences in all of docs (doc_id, text).

    Tasks hand on counts, of which they hold `held` at most, so a frequent word is a row for each
    task that has it.
    """
    import pyarrow as pa

    def count(batches):
        sums: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, 1000):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), byte_lists(part, "text"), strict=True):
                    for word, n in spoiled_words(text, doc_id, shortest).items():
                        sums[word] = sums.get(word, 0) + n
                    if len(sums) > held:
                        yield pa.RecordBatch.from_pydict({"word": list(sums), "n": list(sums.values())})
                        sums = {}
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(sums), "string"), "n": pa.array(list(sums.values()), "int64")})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def trie_paths(words: list[str], ids: np.ndarray, seed: int) -> pd.DataFrame:
    """Every edge on the path of every word: node, symbol, child, the word's id, a number of what follows the child, and whether the word ends there.

    A node is a number made from its parent's and the symbol; what follows is numbered from the end alike.
    """
    sizes = np.array([len(w) for w in words], "int64")
    symbols = np.frombuffer("".join(words).encode("utf-32-le"), "uint32").astype("uint64")
    starts = np.cumsum(sizes) - sizes
    node, child, rest = (np.zeros(len(symbols), "uint64") for _ in range(3))
    at, back = np.full(len(words), _mixed(np.array([seed], "uint64"))[0]), np.zeros(len(words), "uint64")
    step = lambda x, c: _mixed(x * U64(0x9E3779B97F4A7C15) + c + U64(1))
    for k in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > k)
        here = starts[live] + k
        node[here] = at[live]
        at[live] = child[here] = step(at[live], symbols[here])
        end = starts[live] + sizes[live] - 1 - k
        rest[end] = back[live]
        back[live] = step(back[live], symbols[end])
    last = np.zeros(len(symbols), bool)
    last[(starts + sizes - 1)[sizes > 0]] = True
    return pd.DataFrame({"node": node.view("int64"), "c": symbols.astype("int32"), "child": child.view("int64"), "wid": np.repeat(ids, sizes), "rest": rest.view("int64"), "last": last})


PATHS = "node long, c int, child long, wid long, rest long, last boolean"


def trie_edges(words: DataFrame, seed: int = 0, piece: int = 1 << 21) -> DataFrame:
    """The trie of words (wid, word) as a table of edges: node, c, child, and of the words through the child:

    n (how many), wid (of one of them), rest (a number of what follows, for one alone), marks (a bit
    for each of those numbers, so that subtrees without a common bit share no ending) and term
    (the word that ends at the child, or null). Two nodes of one number would be one node, so the
    table is built again with another seed if that happens.
    """

    def paths(batches):
        for pdf in batches:
            cut = pdf["word"].str.len().cumsum() // piece
            for _, some in pdf.groupby(cut, sort=False):
                yield trie_paths(some["word"].tolist(), some["wid"].to_numpy("int64"), seed)

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rest").bitwiseAND(F.lit(63)).cast("int"))
    rows = words.select("wid", "word").mapInPandas(paths, PATHS)
    edges = rows.groupBy("node", "c", "child").agg(
        F.count("*").alias("n"), F.min("wid").alias("wid"), F.min("rest").alias("rest"), F.bit_or(bit).alias("marks"), F.max(F.when(F.col("last"), F.col("wid"))).alias("term"),
    )
    edges = stage(edges, "trie-edges")
    if edges.groupBy("child").count().where("count > 1").isEmpty():
        return edges
    drop_staged(edges)
    return trie_edges(words, seed + 1, piece)


HELD_BY_NODE = ("node", "n", "wid", "rest", "marks", "term")


def _side(prefix: str, kind: str = "child") -> list[Column]:
    """The node behind an edge as columns of a state."""
    return [F.col(f"{prefix}.{kind if c == 'node' else c}").alias(f"{prefix}_{c}") for c in HELD_BY_NODE]


#: Two subtrees can share an ending: their marks do, and single words have the same one.
_MAY_MEET = "x.marks & y.marks <> 0 and (x.n > 1 or y.n > 1 or x.rest = y.rest)"


def _smaller_first(states: DataFrame) -> DataFrame:
    """States whose first node has the fewer words below, as the next join follows its edges."""
    turn = F.col("x_n") <= F.col("y_n")
    pick = lambda a, b, c: F.when(turn, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).alias(f"{a}_{c}")
    return states.select(*[pick("x", "y", c) for c in HELD_BY_NODE], *[pick("y", "x", c) for c in HELD_BY_NODE])


def _arrived(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of words that states end in, and the states that go on. Two single words that may meet are a pair: what follows is the same."""
    single = (F.col("x_n") == 1) & (F.col("y_n") == 1)
    both = F.col("x_term").isNotNull() & F.col("y_term").isNotNull()
    pair = F.when(single, F.struct(F.col("x_wid").alias("a"), F.col("y_wid").alias("b"))).when(both, F.struct(F.col("x_term").alias("a"), F.col("y_term").alias("b")))
    return states.select(pair.alias("p")).where("p is not null").select("p.a", "p.b"), states.where(~single)


def near_ids(edges: DataFrame) -> list[DataFrame]:
    """Staged tables (a, b) of ids of words with one code point inserted, deleted or replaced, each pair once, where numbers of endings don't coincide by chance.

    The edit lies at the first symbol in which two words differ. A replacement is a pair of edges
    of one node; a deletion pairs an edge's child with the node it comes from, whose next symbol must
    be another. From there both sides follow equal symbols. Rounds end when no state is left: at
    most as many as the longest word has symbols, and in fact as long as more than one word goes on.
    """
    x, y, up = edges.alias("x"), edges.alias("y"), edges.alias("up")
    replaced = x.join(y, F.expr(f"x.node = y.node and x.c < y.c and {_MAY_MEET}")).select(*_side("x"), *_side("y"))
    # up is the deleted symbol: the longer word goes on from its child, the shorter one from its node.
    longer = up.join(x, F.expr("x.node = up.child")).join(y, F.expr(f"y.node = up.node and y.c = x.c and y.c <> up.c and {_MAY_MEET}"))
    deleted = longer.select(*_side("x"), *_side("y"))
    ended = up.where("term is not null").join(x.where("term is not null"), F.expr("up.node = x.child")).select(F.col("up.term").alias("a"), F.col("x.term").alias("b"))
    found, now = [stage(ended, "trie-pairs")], stage(_smaller_first(replaced.unionByName(deleted)), "trie-states")
    while not now.isEmpty():
        pairs, onward = _arrived(now)
        found.append(stage(pairs, "trie-pairs"))
        s = onward.alias("s")
        step = s.join(x, F.expr("x.node = s.x_node")).join(y, F.expr(f"y.node = s.y_node and y.c = x.c and {_MAY_MEET}"))
        new = stage(_smaller_first(step.select(*_side("x"), *_side("y"))), "trie-states")
        drop_staged(now)
        now = new
    drop_staged(now)
    return found


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of words (word, n, distinct): each unordered pair at one edit once. Candidates of the trie are checked by their very words."""
    named = words.withColumn("wid", F.xxhash64("word"))
    edges = trie_edges(named)
    found = near_ids(edges)
    drop_staged(edges)
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    side = lambda c: named.select(F.col("wid").alias(c), F.struct("word", "n").alias(f"w{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.levenshtein("wa.word", "wb.word") == 1)
    first, second = F.least("wa", "wb"), F.greatest("wa", "wb")
    ordered = both.select(first.alias("f"), second.alias("s")).distinct()
    out = stage(ordered.select(F.col("f.word").alias("a"), F.col("f.n").alias("n_a"), F.col("s.word").alias("b"), F.col("s.n").alias("n_b")), "near-words")
    for f in found:
        drop_staged(f)
    return out


def follow_forms(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the last of a chain, the word itself if it has no form.

    Jumps double, so rounds grow with the logarithm of the longest chain. Chains must end, as they do where a form is more frequent than its word.
    """
    now = stage(forms.select("word", F.col("form").alias("root")).where("root is not null"), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = stage(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "forms")
        drop_staged(now)
        now = jumped
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n, distinct).

    form: the near word of largest n (ties: the smallest in code-point order) if its n is at least
    `ratio` times the word's; root: where forms lead; n_near: how many near words there are.
    """
    near = near_words(words)
    ways = near.select("a", F.struct(F.col("n_b").alias("n"), F.col("b").alias("w")).alias("o")).unionByName(near.select(F.col("b").alias("a"), F.struct(F.col("n_a").alias("n"), F.col("a").alias("w")).alias("o")))
    best = ways.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("o.n")).alias("m"), F.col("o.w").alias("w"))).alias("o"))
    counted = words.join(best, "word", "left")
    fit = -F.col("o.m") >= ratio * F.col("n")
    formed = stage(counted.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fit, F.col("o.w")).alias("form"), F.when(fit, -F.col("o.m")).alias("form_n")), "formed")
    drop_staged(near)
    roots = follow_forms(formed)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """group_variants of the words of all docs.

    A null text has no words, a null id counts as an empty one, repeated rows count again; without
    documents or words there are no rows.
    """
    return group_variants(stage(count_words(docs), "spelling-words"))
