"""Decontamination against plain window search."""

import hashlib
import random
import re

from foldtable.llm import common, decontaminate
from foldtable.llm.queries import QUERIES

from .data import SF, documents, empty_documents


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def check(rows, docs, items):
    windows = {}
    for i in items:
        w = plain_words(i.text)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i.item_id)
    sizes, want, hits = {len(w) for w in windows}, [], 0
    for d in docs:
        words, hit, met = plain_words(d.text), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (names := windows.get(tuple(words[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    met |= {str(x) for x in names if x is not None}
        sha = hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()
        want.append(str((d.doc_id, len(words), len(hit), len(met), sha, len(hit) > 0 and 20 * len(hit) >= len(words))))
        hits += bool(hit)
    assert sorted(want) == sorted(str(tuple(r)) for r in rows)
    return hits


def test_decontamination(spark):
    docs, items = (common.table(spark, SF, n).collect() for n in ("documents", "benchmark"))
    assert check(QUERIES["op8_decontamination"](spark, SF).collect(), docs, items) > 0


def awkward_items(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, long), (2, "Same TEXT"), (3, None), (4, "..."), (5, "same"), (6, "a b"), (7, " ".join(["aa"] * 20)), (8, long.replace("w15", "v")), (None, "Same text twice"), (9, "é!É"), (10, "Same TEXT")]
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, n_words int")


def test_decontamination_of_awkward_rows(spark):
    rng = random.Random(2)
    items = awkward_items(spark)
    texts = [" ".join(rng.choice(["aa", "a", "b", "c", "same", "text"]) for _ in range(200)) for _ in range(30)]
    texts += [" ".join(f"W{k}" for k in range(a, b)) for a, b in ((0, 30), (0, 12), (5, 18), (20, 40))] + ["aa " * 50, "aa " * 12, "É é", *(x for x in documents(spark).toPandas().text)]
    docs = documents(spark, texts)
    assert check(decontaminate.judge_documents(spark, docs, items).collect(), docs.collect(), items.collect()) > 30
    assert decontaminate.judge_documents(spark, empty_documents(spark), items).count() == 0
    assert check(decontaminate.judge_documents(spark, docs, items.limit(0)).collect(), docs.collect(), []) == 0
    # More items than one automaton holds give the same.
    whole = sorted(map(str, decontaminate.find_spans(docs, items).collect()))
    assert sorted(map(str, decontaminate.find_spans(docs, items, block_words=8).collect())) == whole
    assert sorted(map(str, decontaminate.find_spans(docs, items, block_words=8, held=2).collect())) == whole
    assert len(decontaminate.build_automata(items.selectExpr("string(item_id) item_id", "coalesce(text, '') text"), 13, 8)) > 2 * 2


def test_removal(spark):
    items = awkward_items(spark)
    passage = " ".join(f"W{k}," for k in range(13))
    docs = documents(spark, [f"Keep {passage} this.", f"{passage} " + "other " * 400, "clean"])
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut[0] == "Keep , this." and cut[1].strip().startswith(", other") and cut[2] == "clean"
    both = decontaminate.remove_spans(docs, items, drop=True)
    assert {r.doc_id: r.text for r in both.where("doc_id is not null").collect()} == {1: cut[1], 2: "clean"} and both.columns == docs.columns
    kept = decontaminate.remove_contaminated(docs, items)
    assert sorted(x.doc_id for x in kept.where("doc_id is not null").collect()) == [1, 2, 2] and kept.columns == docs.columns


def test_columns_of_clashing_names_stay(spark):
    docs = documents(spark, ["w0 same text", "other"]).selectExpr("doc_id", "text", "777 as n_words", "'s' as spans", "1.5D as n_hit", "'c' as contaminated", "2 as item_ids", "3 as c0")
    want = sorted(map(str, docs.collect()))
    assert sorted(map(str, decontaminate.remove_contaminated(docs, awkward_items(spark).limit(0)).collect())) == want
    assert sorted(map(str, decontaminate.remove_spans(docs, awkward_items(spark).limit(0)).collect())) == want


def test_coverage_is_exact(spark):
    found = spark.createDataFrame([(n, [[0, h]]) for n, h in ((10, 3), (10, 2), (1000, 299), (1000, 300), (7, 0))], "n_words long, spans array<array<int>>")
    limits = {c: [r.contaminated for r in decontaminate.judged(found, c).orderBy("n_words", "n_hit").collect()] for c in (0.3, 0.0, 1.0)}
    assert limits == {0.3: [False, False, True, False, True], 0.0: [False, True, True, True, True], 1.0: [False] * 5}
