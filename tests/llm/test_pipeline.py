"""The pipeline, stage by stage, against brute force on the stage's own input."""

import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foldtable.llm import common

from .data import SF, components, documents
from .test_decontaminate import plain_words
from .test_duplicates import plain_fingerprint
from .test_line_dedup import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs, kept = common.table(spark, SF, "documents"), []
    for _, step in corpus_pipeline.STAGES:
        docs = common.stage(step(spark, docs, SF), "t")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert len(kept) == 5 or docs.columns == COLUMNS
    scored, lines, groups, clean, ids = kept
    labels = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    assert sum(labels.get(i) == 1 for i in scored) >= 0.97 * sum(labels.values())
    assert sum(labels.get(i) == 0 for i in scored) <= 3

    want, _ = plain(sorted((i, r.text) for i, r in scored.items()))
    assert {i: r.text for i, r in lines.items()} == {i: t for i, t, n, k in want if k or not n}
    assert all(r.n_chars == len(r.text) for r in lines.values())

    fps = {i: plain_fingerprint(r.text) for i, r in lines.items()}
    comp = components(fps, [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4])
    assert set(groups) == set(comp.values()) and all(groups[i] == lines[i] for i in groups)

    windows = set()
    for r in common.table(spark, SF, "benchmark").collect():
        w = plain_words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12)) if w}

    def contaminated(text):
        words, hit = plain_words(text), set()
        for n in {len(w) for w in windows}:
            hit |= {p for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows for p in range(k, k + n)}
        return hit and 20 * len(hit) >= len(words)

    def without_passages(text):
        words, hit = plain_words(text), [False] * len(plain_words(text))
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
        runs = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[h] for h in hit))]
        for a, b in reversed([r for r in runs if r[1] - r[0] >= 13]):
            text = text[: at[a][0]] + text[at[b - 1][1] :]
        return text

    assert set(clean) == {i for i, r in groups.items() if not contaminated(r.text)}
    assert all(r.text == without_passages(groups[i].text) and (r.text != groups[i].text or r == groups[i]) and r.n_chars == len(r.text) for i, r in clean.items())
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {i: list(r.tokens) for i, r in ids.items()} == {i: coder.encode(r.text, add_special_tokens=False).ids for i, r in clean.items()}


def test_awkward_rows_go_through(spark):
    docs = documents(spark).select(*COLUMNS)
    for _, step in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = step(spark, given, SF)
            assert given is docs or out.count() == 0
        docs = common.stage(step(spark, docs, SF), "t")
    assert docs.where(F.col("n_tokens") < 0).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 20 < rows.count() < 200


def test_stages_keep_one_worker_a_task(spark):
    docs = common.table(spark, SF, "documents")
    for step in (corpus_pipeline.drop_contaminated, corpus_pipeline.tokenize):
        plan = step(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall("MapInArrow", plan)) == 1  # each runs beside the others, in a Python worker of its own
