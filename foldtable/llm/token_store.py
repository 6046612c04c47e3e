"""Token ids as Parquet list columns that can be read selectively.

Documents are ordered by id, encoded where they lie, and written with small row groups and
pages: token ids dictionary-encoded, ids and offsets delta-encoded, column and page indexes on.
A reader that wants a range of documents, or only their lengths, touches only those pages.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_lists, drop_staged, new_path, parts_for, slices, stage, utf8_size
from .encoding import Merges, UnitEncoder, gather

#: Writer settings: row groups of 16 MB, pages of 64 KB, version 2 pages for delta encoding.
LAYOUT = {
    "parquet.block.size": 16 << 20,
    "parquet.page.size": 64 << 10,
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "compression": "zstd",
}
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"


#: Lower-case ASCII letters, and ASCII marks after them; and the same with any letters.
MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~"
PLAIN = re.compile(rb"([a-z]+)([%b]*)" % re.escape(MARKS).encode())


class ChunkEncoder(UnitEncoder):
    """Encodes texts with a tokenizer that drops white space, one white-space chunk at a time.

    Normalising and splitting never look across white space, so a chunk's ids don't depend on
    its neighbours. A chunk of letters, and ASCII marks after them, is two words to the
    tokenizer; letters that normalising leaves alone are merged directly.
    """

    #: Fixed value: how a file that this holds for splits a text into words, which is by kind of character.
    WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str, held: int = 700_000):
        super().__init__(held)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        if not self.fits(spec):
            raise ValueError(f"{path}: only tokenizers that drop white space and case, and merge words of one kind of character")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = Merges(spec["model"])
        self.tails: dict[bytes, list[int]] = {b"": []}

    @classmethod
    def fits(cls, spec: dict) -> bool:
        model, kinds = spec["model"], lambda x: [y["type"] for y in (x or {}).get("normalizers", (x or {}).get("pretokenizers", []))]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        by_word = kinds(spec["pre_tokenizer"]) == ["Split", "ByteLevel"] and split["pattern"] == {"Regex": cls.WORDS} and split["behavior"] == "Removed" and split["invert"]
        marked = all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        return model["type"] == "BPE" and plain and by_word and marked and kinds(spec["normalizer"]) == ["NFC", "Replace", "Lowercase"] and spec["post_processor"] is None

    def split(self, text: bytes) -> list[bytes]:
        # Lower case joins chunks that encode alike; a text that may spell a special token keeps its own.
        return (text if b"<|" in text else text.lower()).split()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ask(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A unit has two pieces: letters, and marks after them; or itself, if it is of another kind, and nothing."""
        words, at, tails, rest = [], [], [], []
        match = PLAIN.fullmatch
        for k, unit in enumerate(units):
            if found := match(unit):
                word, tail = found.groups()
            else:
                text = unit.decode()
                core = text.rstrip(MARKS)
                if not (core.isalpha() and is_normalized("NFC", core) and core.lower() == core):
                    rest.append(k)
                    continue
                word, tail = core.encode(), text[len(core) :].encode()
            words.append(word), at.append(k), tails.append(tail)
        if len(self.tails) > 10_000:
            self.tails = {b"": []}
        new = [t for t in dict.fromkeys(tails) if t not in self.tails]
        self.tails.update(zip(new, self.whole([t.decode() for t in new]), strict=True))
        ids, counts = self.merges.words(words)
        others = self.whole([units[k].decode() for k in rest])
        ends = [self.tails[t] for t in tails]
        more = [*others, *ends]
        sizes = np.fromiter(map(len, more), "int64", len(more))
        pool = np.concatenate([ids, np.fromiter(chain.from_iterable(more), "int64", sizes.sum())])
        starts = len(ids) + np.cumsum(sizes) - sizes
        piece = np.zeros((2, len(units), 2), "int64")  # start and number of ids of each unit's two pieces
        piece[0, at, 0], piece[1, at, 0] = np.cumsum(counts) - counts, counts
        piece[0, at, 1], piece[1, at, 1] = starts[len(rest) :], sizes[len(rest) :]
        piece[0, rest, 0], piece[1, rest, 0] = starts[: len(rest)], sizes[: len(rest)]
        return gather(pool, piece[0].ravel(), piece[1].ravel())[0], piece[1].sum(1)


_encoders: dict[str, ChunkEncoder] = {}


def _encode(path: str, end_id: int):
    def run(batches):
        coder = _encoders.get(path) or _encoders.setdefault(path, ChunkEncoder(path))
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in slices(batch, 1000):
                ids, counts = coder.encode(byte_lists(some, "text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(ids, pa.int32()))
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(np.full(n, part, "int32")), pa.array(start + ends - counts), pa.array(counts), tokens],
                    ["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, part_bytes: int = 32 << 20) -> None:
    """Write the ids of every text of docs (doc_id, text), each followed by `end_id`, to `path`.

    Files are in ascending doc_id order: nulls first, rows of equal id in the order of a hash of their text. Null text
    is empty, and an empty text has the end id alone. Rows that repeat each other are told apart
    by their place in the input, so that any number of them spans several files. Other columns are
    left out. An empty table writes no rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(utf8_size(F.col("text")) + 64)).first()[0]
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", F.xxhash64("text"), "place"]
    ordered = placed.repartitionByRange(parts_for(spark, total, part_bytes), *order).sortWithinPartitions(*order)
    rows = ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id), SCHEMA)
    rows.write.options(**{k: str(v) for k, v in LAYOUT.items()}).parquet(path)


def _bases(stored: DataFrame, parts_at_once: int = 4096) -> DataFrame:
    """part, base: the ids of all parts before each. Parts are summed up in runs, so that no window has more rows than a run has parts, or there are runs."""
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = stage(stored.groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("run", F.floor(F.col("part") / parts_at_once)), "part-totals")
    inside = totals.withColumn("inside", before(Window.partitionBy("run").orderBy("part")))
    runs = totals.groupBy("run").agg(F.sum("total").alias("total")).withColumn("outside", before(Window.partitionBy(F.lit(0)).orderBy("run")))
    bases = stage(inside.join(runs.drop("total"), "run").select("part", (F.col("inside") + F.col("outside")).alias("base")), "part-bases")
    drop_staged(totals)
    return bases


def read_tokens(spark, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents and their ids, `start` counting the ids of all documents before each.

    Files keep each start within its part; what comes before a part is a table of a row for each, from the
    lengths alone. It is stored, so Spark knows its size and decides how to join it. `first` and
    `last` limit doc_id and reach the page index.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    bases = _bases(stored)
    if first is not None:
        stored = stored.where(F.col("doc_id") >= first)
    if last is not None:
        stored = stored.where(F.col("doc_id") <= last)
    joined = stored.join(bases, "part")
    return joined.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def _digest(batches):
    for batch in batches:
        column = batch.column("tokens")
        at, ids = column.offsets.to_numpy(), column.values.to_numpy()
        sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype("int64")), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def store_documents(spark, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Store the ids of all documents and report on each as the files have it."""
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    stored = read_tokens(spark, path)
    return stored.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
