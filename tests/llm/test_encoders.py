"""BPE and quality scores against the tokenizers library, brute force and held-out labels."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldtable.llm import bpe, common, quality
from foldtable.llm.queries import QUERIES
from foldtable.llm.token_store import ChunkEncoder

from .data import SF, documents, empty_documents

BYTE, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = "abcXYZéÉßŁσΣςİıǅﬁÅ \n\t\r\x0b\x1c\x85\xa0.,'!?<|>s t re 012٣½_-́̈ͅ　  中한\U0001f600‍"


def odd_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(n)] + ["<|ENDOFTEXT|> a<|endoftext|>.B", "<|endoftext|>", "a\n <|endoftext|> b"]


def library(path):
    coder = Tokenizer.from_file(path)
    coder.no_truncation(), coder.no_padding()
    return coder


def by_doc(ids, counts):
    at = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_encoders_match_the_library():
    texts = odd_texts(3000)
    want = [e.ids for e in library(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert by_doc(*ChunkEncoder(WORDS).encode([t.encode() for t in texts])) == want
    vocabulary = bpe.Vocabulary(BYTE)
    some = sorted({w.encode() for t in texts[::2] for w in bpe.WORD.findall(t)})
    lexicon = bpe.Transducer.build([(w, vocabulary.merge(w)) for w in some])
    coder = library(BYTE)
    ids, counts = bpe.LexiconEncoder(BYTE, lexicon).encode([t.encode() for t in texts])
    assert by_doc(ids, counts) == [e.ids for e in coder.encode_batch(texts, add_special_tokens=False)]
    assert [t.decode() for t in vocabulary.decode(ids, counts)] == [coder.decode(x, skip_special_tokens=False) for x in by_doc(ids, counts)]


def test_merging_long_words():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 63, 64, 65, 300)] + ["ab" * 200, "a" * 500, "".join(rng.choice("abcdefgh") for _ in range(1_000_000))]
    lexicon = bpe.Transducer.build([])
    for path, coder in ((WORDS, ChunkEncoder(WORDS)), (BYTE, bpe.LexiconEncoder(BYTE, lexicon))):
        want = [e.ids for e in library(path).encode_batch(texts, add_special_tokens=False)]
        started = time.time()
        assert by_doc(*coder.encode([t.encode() for t in texts])) == want
        assert time.time() - started < 60


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="white space"):
        ChunkEncoder(BYTE)


def test_transducer(tmp_path):
    words = sorted({b"a", b"ab", b"talking", b"walking", b"walk", b"\xff\x00", b"king", b"taking", b"x" * 300})
    found = bpe.Transducer.build([(w, [k, k + 1][: 1 + k % 2]) for k, w in enumerate(words)])
    (tmp_path / "t").write_bytes(found.to_bytes())
    for t in (found, bpe.Transducer.mapped(str(tmp_path / "t"))):
        asked = [*words, b"", b"tal", b"walkin", b"kings", b"zz"]
        assert t.numbers(asked).tolist() == [*range(len(words)), *[-1] * 5]
    shared = bpe.Transducer.build([(w, [0]) for w in (b"talking", b"walking")])
    assert len(shared.final) == 8  # one path of seven letters, as the suffix is shared
    assert bpe.Transducer.build([]).numbers([b"a"]).tolist() == [-1]


def check_bpe(rows, docs):
    coder, want = library(BYTE), []
    for d in docs:
        ids = coder.encode(d.text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append(str((d.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(coder.decode(ids, skip_special_tokens=False).encode()))))
    assert sorted(want) == sorted(str(tuple(r)) for r in rows)


def test_bpe(spark):
    check_bpe(QUERIES["op2_bpe"](spark, SF).collect(), common.table(spark, SF, "documents").collect())


def test_bpe_of_awkward_rows(spark):
    docs = documents(spark)
    check_bpe(bpe.round_trip(spark, docs).collect(), docs.collect())
    assert bpe.round_trip(spark, empty_documents(spark)).count() == 0
    encoded = bpe.encode(docs, BYTE, keep=("doc_id", "source"), words=3)
    back = bpe.decode(encoded, BYTE).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((r.doc_id, r.text or "")) for r in docs.collect())


def test_encoding_is_bounded_by_pieces(tmp_path, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(20_000)) for _ in range(150)]
    (tmp_path / "t").write_bytes(bpe.Transducer.build([]).to_bytes())
    monkeypatch.setattr(bpe, "SparkFiles", type("Files", (), {"get": lambda name: str(tmp_path / name)}))
    monkeypatch.setattr(bpe, "_encoders", {})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    found = list(bpe._encode(BYTE, "t", ["doc_id"])([batch]))
    assert max(b.num_rows for b in found) <= 60  # pieces of about a megabyte, where all were one before
    want = [e.ids for e in library(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert [x for b in found for x in b.column("tokens").to_pylist()] == want
    held = bpe._encoders["t"]
    assert not held.known and not held.merged and not len(held.flat)  # a waiting worker keeps no units


def auc(scores, y):
    better = sum((a > b) + 0.5 * (a == b) for a, p in zip(scores, y, strict=True) if p for b, q in zip(scores, y, strict=True) if not q)
    return better / (sum(y) * (len(y) - sum(y)))


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op4_quality_classifier"](spark, d).collect()}
    assert len(rows) == common.table(spark, d, "documents").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(rows[r.doc_id].score, r.quality) for r in common.table(spark, d, "labels").collect() if rows[r.doc_id].held_out]
    assert auc(*zip(*held, strict=True)) > 0.97
    assert sum((s >= 0.3) == q for s, q in held) / len(held) > 0.93


def test_quality_never_sees_held_out_labels(spark):
    docs, labels = (common.table(spark, SF, n) for n in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    got = [sorted(map(str, quality.score_documents(spark, docs, x).collect())) for x in (labels, flipped)]
    assert got[0] == got[1]


def test_quality_of_awkward_rows(spark):
    docs, labels = documents(spark), common.table(spark, SF, "labels")
    rows = quality.score_documents(spark, docs, labels).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r.score) for r in rows)
    assert quality.score_documents(spark, empty_documents(spark), labels).count() == 0
    assert {r.score for r in quality.score_documents(spark, docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(common.table(spark, SF, "documents").withColumn("score", F.lit("s")), labels)
    good = {r.doc_id for r in QUERIES["op4_quality_classifier"](spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns[-1] == "score"


def test_scores_against_one_machine(spark):
    docs, labels = common.table(spark, SF, "documents").toPandas(), common.table(spark, SF, "labels").toPandas()
    x = np.array([quality.statistics((t or "").encode()) for t in docs.text])
    folds = np.array([zlib.crc32(str(i).encode()) % 5 for i in docs.doc_id])
    marks = dict(zip(labels.doc_id, labels.quality, strict=True))
    y = np.array([marks.get(i, -1) for i in docs.doc_id], "float64")
    train = (y >= 0) & (folds > 0)
    project = quality.Projection(x[train].mean(0), x[train].std(0), 11)

    def ridge(at):
        z = project(x[at])
        a = z.T @ z
        return np.linalg.solve(a + quality.RIDGE * max(1.0, a[-1, -1]) * np.eye(len(a)), z.T @ y[at])

    raw = np.zeros(len(x))
    for k in range(1, 5):
        own = train & (folds == k)
        raw[own] = np.clip(project(x[own]) @ ridge(train & (folds != k)), -1, 2)
    bins = np.floor((raw[train] + 1) / 3 * quality.BINS)
    groups = [(raw[train][bins == b].mean(), y[train][bins == b].sum(), (bins == b).sum()) for b in np.unique(bins)]
    at, value = quality.isotonic(*(np.array(c, "float64") for c in zip(*groups, strict=True)))
    last = np.clip(project(x) @ ridge(train), -1, 2)
    want = 0.99 * np.interp(last, at, value) + 0.01 * np.clip(last, 0, 1)
    got = {r.doc_id: r.score for r in QUERIES["op4_quality_classifier"](spark, SF).collect()}
    assert max(abs(got[i] - s) for i, s in zip(docs.doc_id, want, strict=True)) < 0.02


def test_isotonic():
    x, y, n = np.arange(6.0), np.array([0.0, 3, 1, 2, 2, 4]), np.array([4.0] * 6)
    at, value = quality.isotonic(x, y, n)
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all() and len(at) == 3
