"""License scans against plain search of all windows."""

import math
import random
import re

from foldtable.llm import license_scan
from foldtable.llm.common import table
from foldtable.llm.queries import QUERIES

from .data import SF, documents, empty_documents


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text, templates, least):
    """All blocks of all templates, compared as sets without any filter."""
    words, labels, best = plain_words(text), set(), 0.0
    for label, t in templates:
        want = set(plain_words(t))
        if not want:
            continue
        half = 4
        while half < len(plain_words(t)):
            half *= 2
        need = math.ceil(round(len(want) * least, 9))
        for start in range(0, max(1, len(words)), half):
            common = len(want & set(words[start : start + 2 * half]))
            if common >= max(1, need):
                labels.add(label)
                best = max(best, common / len(want))
    return labels, best


def check(rows, docs, templates, least):
    want = []
    for d in docs:
        words = plain_words(d.text)
        at = [(k, label) for label, p in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        base = {x for _, x in at}
        labels, best = plain_scan(d.text, templates, least)
        places = [k for k, _ in at]
        want.append((d.doc_id, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if at else round(best, 9)))
    got = [(*r[:7], round(r[7], 9)) for r in (tuple(x[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for x in rows)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return want


def test_whole_documents(spark):
    docs = table(spark, SF, "documents").collect()
    want = check(QUERIES["op13_license_scan"](spark, SF).collect(), docs, license_scan.TEMPLATES, license_scan.LEAST)
    assert sum(bool(w[2]) for w in want) and sum(w[5] != w[6] for w in want)


def test_random_texts_and_thresholds(spark):
    rng = random.Random(4)
    templates = [(f"t{k}", " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n))) for k, n in enumerate((1, 2, 3, 5, 8, 12, 20, 33))] + [("none", "..."), ("t1", "ax ax ax")]
    texts = [" ".join(rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(rng.randrange(0, 80))) for _ in range(40)]
    texts += [" ".join(t.split()[k:] + t.split()[:k]) for _, t in templates for k in (0, 2)]
    docs = documents(spark, [*texts, "cc by nc cc BY-NC under the MIT License Apache License, Version 2", *documents(spark).toPandas().text])
    rows = docs.collect()
    for least in (0.5, 0.8, 0.95, 1.0):
        check(license_scan.scan_licenses(spark, docs, templates, least=least).collect(), rows, templates, least)


def test_licenses_that_differ_by_a_word_stay_apart(spark):
    texts = ["x " * 50 + "This work is licensed under the GNU General Public License, version 3. " + "y " * 50, "Licensed under CC BY-NC 4.0.", "the license of the work, all of it and the software"]
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark, documents(spark, texts)).where("doc_id is not null").collect()}
    assert got == {0: "gpl-3", 1: "cc-by-nc", 2: ""}
    words = [set(plain_words(t)) for _, t in license_scan.TEMPLATES]
    assert not any(a <= b for i, a in enumerate(words) for j, b in enumerate(words) if i != j)


def test_no_rows_and_no_templates(spark):
    assert license_scan.scan_licenses(spark, empty_documents(spark)).count() == 0
    rows = license_scan.scan_licenses(spark, documents(spark, ["cc by nc"]), templates=[]).collect()
    assert [(r.base_labels, r.labels, r.score) for r in rows if r.doc_id == 0] == [("cc-by-nc", "cc-by-nc", 1.0)] * 2
