"""Spelling variants against all pairs of words."""

import random
import re
import zlib

from foldtable.llm import spelling
from foldtable.llm.common import table
from foldtable.llm.queries import QUERIES

from .data import SF, documents, empty_documents


def plain_words(docs):
    counts = {}
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d.doc_id is None else d.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_groups(words):
    """By deleting each code point: words are near if one is the other without one, or both give the same, deleted at one place."""
    near, holes = {w: set() for w in words}, {}
    for w in words:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            if less in near:
                near[w].add(less), near[less].add(w)
            holes.setdefault((k, less), []).append(w)
    for same in holes.values():
        for a in same:
            near[a] |= {b for b in same if b != a}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(map(str, rows))


def mine(df):
    return sorted(str(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_groups_of_all_documents(spark):
    want = plain_groups(plain_words(table(spark, SF, "documents").collect()))
    assert mine(QUERIES["op12_spelling"](spark, SF)) == want
    assert sum("None, '" not in x for x in want) > 20


def test_dense_words(spark):
    """Short words over few letters: nearly all are near to others, so every kind of edit and chain occurs."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abÀ") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 500) for _ in range(600)}
    words |= {"a" * k: 4**k for k in range(5, 12)} | {"prefix" + "q" * 20 + x: n for x, n in (("a", 3), ("b", 9), ("ab", 4), ("", 99))} | {"xprefix" + "q" * 20: 300}
    rows = spark.createDataFrame([*words.items()], "word string, n long")
    assert mine(spelling.group_variants(rows)) == plain_groups(words)


def test_chains_are_followed_to_their_end(spark):
    forms = spark.createDataFrame([(f"w{k:03}", f"w{k + 1:03}" if k < 40 else None) for k in range(41)], "word string, form string")
    assert {r.root for r in spelling.follow_forms(forms).collect()} == {"w040"}


def test_words_of_awkward_rows(spark):
    docs = documents(spark, ["Straße straße STRASSE naïve naïve Naïve ÀÉ× " * 3, None, "", "hello hello hello hellO1hello", "x" * 30000] + ["words, wordz; wordz"] * 5)
    assert {r.word: r.n for r in spelling.count_words(docs, held=2).collect()} == plain_words(docs.collect())
    assert mine(spelling.group_spellings(spark, docs)) == plain_groups(plain_words(docs.collect()))
    assert spelling.group_spellings(spark, empty_documents(spark)).count() == 0
    assert spelling.group_spellings(spark, docs.where("text is null")).count() == 0


def test_trie_edges(spark):
    """Prefixes are shared, and every node has a number of its own."""
    rows = spark.createDataFrame([(1, "abcde"), (2, "abcdf"), (3, "zbcde")], "wid long, word string")
    edges = spelling.trie_edges(rows)
    assert edges.count() == 5 + 1 + 5 and edges.select("child").distinct().count() == 11
    assert edges.where("c = ascii('b') and n = 2").count() == 1
