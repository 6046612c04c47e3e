"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The corpus' most frequent words are compiled, with their ids, into one automaton that shares
prefixes and suffixes; arc outputs add up to a word's number, which leads to its ids. It is a
file that tasks map into memory. Words that it lacks are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_lists, new_path, slices, stage
from .encoding import BYTE_CHARS, Merges, UnitEncoder, gather

#: White space as the tokenizer has it. A unit is white space and what follows it, up to the next:
#: the pattern of words never looks beyond a unit.
SPACE = r"\t-\r \x85\xa0  -     　"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORD = regex.compile(public_tokenizers.PATTERN)
#: Bytes of text that a task takes at a time: what it needs to split, encode and decode them is some fifty times as much.
PIECE = 1 << 20


class Vocabulary:
    """Vocabulary, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        vocab = spec["model"]["vocab"]
        self.merges = Merges(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = {c: b for b, c in BYTE_CHARS.items()}
        pieces = {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocab.items() if t not in self.special}
        pieces |= {i: t.encode() for t, i in self.special.items()}
        sizes = np.array([len(pieces.get(i, b"")) for i in range(max(pieces) + 1)])
        self.flat, self.sizes, self.starts = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(sizes))), "uint8"), sizes, np.cumsum(sizes) - sizes

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        return self.merges.long(word)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of the text of each run of ids; bytes that are no character become U+FFFD."""
        out, ends = gather(self.flat, self.starts[ids], self.sizes[ids])
        at, data = ends[np.concatenate([[0], np.cumsum(counts)])].tolist(), out.tobytes()
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(at[:-1], at[1:], strict=True)]


class Transducer:
    """A minimal acyclic automaton of words, whose arc outputs add up to a word's number."""

    FIELDS = (("arcs", "<i8"), ("targets", "<i4"), ("outputs", "<i4"), ("final", "<i4"), ("starts", "<i4"), ("counts", "<i4"), ("ids", "<i4"))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, entries: list[tuple[bytes, list[int]]]) -> Transducer:
        """From distinct words with their ids, in ascending order of the words.

        Words come in order, so what hangs on the last word's path beyond the next word's
        common prefix is complete: it is replaced by an equal state met before, if there is one.
        """
        met: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []  # final, arcs (byte, target)
        path: list[list] = [[False, []]]  # states of the last word: final, arcs

        def close(depth: int) -> None:
            while len(path) > depth:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in met:
                    met[key] = len(states)
                    states.append(key)
                if path:
                    path[-1][1][-1] = (path[-1][1][-1][0], met[key])

        last = b""
        for word, _ in entries:
            same = next((k for k, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
            close(same + 1)
            for byte in word[same:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            last = word
        close(0)
        reach, arcs, targets, outputs = [], [], [], []
        for number, (final, out) in enumerate(states):  # targets come before the states that lead to them
            before = int(final)
            for byte, target in out:
                arcs.append(number * 256 + byte), targets.append(target), outputs.append(before)
                before += reach[target]
            reach.append(before)
        counts = np.array([len(ids) for _, ids in entries], "<i4")
        arrays = {"arcs": arcs, "targets": targets, "outputs": outputs, "final": [s[0] for s in states], "starts": np.cumsum(counts) - counts, "counts": counts, "ids": list(chain.from_iterable(ids for _, ids in entries))}
        return cls({name: np.asarray(arrays[name], kind) for name, kind in cls.FIELDS})

    def to_bytes(self) -> bytes:
        head = np.array([len(getattr(self, name)) for name, _ in self.FIELDS], "<i8")
        return head.tobytes() + b"".join(getattr(self, name).tobytes() for name, _ in self.FIELDS)

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        data, arrays = np.memmap(path, "uint8", "r"), {}
        sizes, at = data[: 8 * len(cls.FIELDS)].view("<i8"), 8 * len(cls.FIELDS)
        for (name, kind), n in zip(cls.FIELDS, sizes.tolist(), strict=True):
            end = at + n * np.dtype(kind).itemsize
            arrays[name], at = np.frombuffer(data[at:end], kind), end
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for a word that isn't here; all words step together."""
        out = np.full(len(words), -1, "int64")
        if not len(self.arcs) or not words:
            return out
        sizes = np.fromiter(map(len, words), "int64", len(words))
        flat, starts = np.frombuffer(b"".join(words), "uint8").astype("int64"), np.cumsum(sizes) - sizes
        live = np.flatnonzero(sizes > 0)
        state, total, step = np.full(len(live), len(self.final) - 1, "int64"), np.zeros(len(live), "int64"), 0
        while len(live):
            key = state * 256 + flat[starts[live] + step]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[at] == key
            live, at = live[ok], at[ok]
            state, total, step = self.targets[at].astype("int64"), total[ok] + self.outputs[at], step + 1
            done = sizes[live] == step
            hit = done & (self.final[state] == 1)
            out[live[hit]] = total[hit]
            live, state, total = live[~done], state[~done], total[~done]
        return out


class LexiconEncoder(UnitEncoder):
    """Encodes by units: their words are looked up in the transducer, and merged where it lacks them."""

    def __init__(self, tokenizer: str, lexicon: Transducer, held: int = 250_000, held_words: int = 125_000):
        super().__init__(held)
        self.merged: dict[str, list[int]] = {}
        self.held_words = held_words
        self.vocabulary, self.lexicon = Vocabulary(tokenizer), lexicon
        self.special = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")

    def forget_all(self) -> None:
        """Units and words: a worker that waits for its next task holds the vocabulary alone."""
        self.forget()
        self.merged = {}

    def split(self, text: bytes) -> list[str]:
        whole = text.decode()
        if not self.special.search(whole):
            return UNIT.findall(whole)
        parts = self.special.split(whole)
        return [u for k, p in enumerate(parts) for u in ([p] if k % 2 else UNIT.findall(p))]

    def ask(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [WORD.findall(u) if u not in self.vocabulary.special else [] for u in units]
        if len(self.merged) > self.held_words:
            self.merged = {}
        ids = self.merged
        distinct = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in ids]
        spelt = [w.encode() for w in distinct]
        numbers = self.lexicon.numbers(spelt)
        at = np.flatnonzero(numbers >= 0)
        held, sizes = self.lexicon.starts[numbers[at]], self.lexicon.counts[numbers[at]].astype("int64")
        rest = np.flatnonzero(numbers < 0)
        merged, counts = self.vocabulary.merges.words([spelt[k] for k in rest.tolist()])
        for where, flat, n in ((at, gather(self.lexicon.ids, held, sizes)[0], sizes), (rest, merged, counts)):
            stops = [0, *np.cumsum(n).tolist()]
            own = flat.tolist()
            ids.update(zip([distinct[k] for k in where.tolist()], [own[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)], strict=True))
        found = [[i for w in ws for i in ids[w]] if ws else [self.vocabulary.special[u]] for u, ws in zip(units, words, strict=True)]
        counts = np.fromiter(map(len, found), "int64", len(found))
        return np.fromiter(chain.from_iterable(found), "int64", counts.sum()), counts


def _count(batches):
    """Words and how often they come, added up as far as memory is bounded."""

    def words(units: Counter) -> pa.RecordBatch:
        total: Counter = Counter()
        for unit, n in units.items():
            for word in WORD.findall(unit):
                total[word] += n
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for some in slices(batch, 500):
            for text in byte_lists(some, "text"):
                held.update(UNIT.findall(text.decode()))
            if len(held) > 400_000:
                yield words(held)
                held = Counter()
    if held:
        yield words(held)


def frequent_words(docs: DataFrame, size: int) -> list[bytes]:
    """At most `size` words, those that come most often in all of docs; for the driver.

    Counts fall into classes a few percent wide, of which there are some hundreds; the most
    frequent classes that fit are taken whole, so only words that are chosen leave the executors.
    """
    counted = docs.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    classed = stage(counted.select("word", F.floor(F.log2("n") * 16).cast("int").alias("class")), "bpe-words")
    least, room = None, size
    for row in classed.groupBy("class").count().orderBy(F.desc("class")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["class"]
    if least is None:
        return []
    return [r.word.encode() for r in classed.where(F.col("class") >= least).select("word").collect()]


def publish(spark: SparkSession, data: bytes) -> str:
    """Put a file in the shared folder and have Spark bring it to every executor; its name there."""
    path = new_path(spark, "lexicon")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jvm_path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


_encoders: dict[str, LexiconEncoder] = {}


def _encoder(tokenizer: str, lexicon: str) -> LexiconEncoder:
    if lexicon not in _encoders:
        _encoders.clear()
        _encoders[lexicon] = LexiconEncoder(tokenizer, Transducer.mapped(SparkFiles.get(lexicon)))
    return _encoders[lexicon]


def _encode(tokenizer: str, lexicon: str, names: list[str]):
    def run(batches):
        encoder = _encoder(tokenizer, lexicon)
        try:
            for batch in batches:
                for some in slices(batch, 1000, most=PIECE):
                    ids, counts = encoder.encode(byte_lists(some, "text"))
                    tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("int32")), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), tokens], [*names, "tokens"])
        finally:
            encoder.forget_all()

    return run


def _lexicon(docs: DataFrame, tokenizer: str, words: int) -> str:
    """Choose and publish the lexicon of docs; its file's name on the executors."""
    vocabulary = Vocabulary(tokenizer)
    chosen = sorted(w for w in frequent_words(docs, words) if w.decode() not in vocabulary.special)
    flat, counts = vocabulary.merges.words(chosen)
    ids = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if chosen else []
    return publish(docs.sparkSession, Transducer.build(list(zip(chosen, ids, strict=True))).to_bytes())


def encode(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), words: int = 1 << 16) -> DataFrame:
    """The columns `keep` of docs and `tokens`, the ids of the whole text.

    Null and empty texts have no ids; the strings of special tokens are those tokens, as the
    library has it. All rows count for the lexicon and all are encoded. `words` bounds the
    lexicon; what it leaves out changes no id.
    """
    lexicon = _lexicon(docs, tokenizer, words)
    schema = docs.select(*keep, F.array(F.lit(0)).alias("tokens")).schema
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_encode(tokenizer, lexicon, list(keep)), schema)


def _tokens(batch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("tokens")
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The rows of encoded with `text` in place of `tokens`."""
    names = [c for c in encoded.columns if c != "tokens"]

    def run(batches):
        vocabulary = Vocabulary(tokenizer)
        for batch in batches:
            for some in slices(batch, 1000, "tokens", 2 << 20):
                texts = pa.array([t.decode() for t in vocabulary.decode(*_tokens(some))], pa.string())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), texts], [*names, "text"])

    return encoded.mapInArrow(run, encoded.select(*names, F.lit("").alias("text")).schema)


def digests(docs: DataFrame, tokenizer: str, tokens: bool = False, words: int = 1 << 16) -> DataFrame:
    """doc_id of docs, n_tokens and digests of the ids and of the text that they decode to; the ids too if wanted.

    A piece is decoded by the task that encoded it: a second pass over the ids would be a second
    Python worker beside each of the first.
    """
    lexicon = _lexicon(docs, tokenizer, words)
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", tokens array<int>" * tokens
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches):
        vocabulary = _encoder(tokenizer, lexicon).vocabulary
        for some in _encode(tokenizer, lexicon, ["doc_id"])(batches):
            ids, counts = _tokens(some)
            at = np.concatenate([[0], np.cumsum(counts)]).tolist()
            raw = ids.astype("<u4")
            hashed = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            texts = [hashlib.sha256(t).hexdigest() for t in vocabulary.decode(ids, counts)]
            columns = [some.column("doc_id"), pa.array(counts.astype("int64")), pa.array(hashed, pa.string()), pa.array(texts, pa.string()), some.column("tokens")]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def round_trip(spark, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode all documents, decode them, and report on both."""
    return digests(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
