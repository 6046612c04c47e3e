"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words stream through it, and
the state tells the longest run ending at each word that some item has too. Where that reaches a
window (13 words, or a whole shorter item), its words are hit.
"""

from __future__ import annotations

import base64
import json
import math
import re
import uuid
from array import array
from bisect import bisect_left
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_lists, drop_staged, new_path, slices, stage

WINDOW = 13
COVERAGE = 0.05
#: Bytes of an automaton in one line of its file, a multiple of three.
LINE = 3 << 18

#: Words are runs of digits, letters and all that is not ASCII, with A-Z in lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Builder:
    """A generalised suffix automaton over item words, grown word by word.

    States are rows of flat arrays. Nearly all have one edge, which stands in them; a dictionary
    holds what more a state has.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.names: list[str | None] = []
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.word, self.target = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.seen = array("i")  # pairs of a state and an item: windows of the item end there
        self.whole = array("i")  # the same of whole items that are shorter than a window

    def _next(self, s: int, c: int) -> int:
        if self.word[s] == c:
            return self.target[s]
        more = self.more.get(s)
        return more.get(c, -1) if more else -1

    def _lead(self, s: int, c: int, to: int) -> None:
        if self.word[s] in (c, -1):
            self.word[s], self.target[s] = c, to
        else:
            self.more.setdefault(s, {})[c] = to

    def _state(self, length: int, link: int) -> int:
        self.link.append(link), self.length.append(length), self.word.append(-1), self.target.append(-1)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for p's longest run followed by c, parted from longer runs that don't end alike."""
        q = self._next(p, c)
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q])
        self.word[copy], self.target[copy] = self.word[q], self.target[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self._next(p, c) == q:
            self._lead(p, c, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if self._next(last, c) >= 0:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and self._next(p, c) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def add(self, name: str | None, words: list[bytes]) -> None:
        """A run from an item's start is always the longest of its state, now and after every split."""
        item, last = len(self.names), 0
        self.names.append(name)
        for k, w in enumerate(words, 1):
            last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
            if k >= self.window:
                self.seen.extend((last, item))
        if 0 < len(words) < self.window:
            self.whole.extend((last, item))

    def finish(self) -> ItemAutomaton:
        """The automaton as sorted arrays."""
        link, length, n = self.link.tolist(), np.array(self.length), len(self.link)
        one = np.flatnonzero(np.array(self.word) >= 0)
        edges = [(s, c, t) for s, out in self.more.items() for c, t in out.items()]
        more = np.array(edges, "int64").reshape(-1, 3)
        source = np.concatenate([one, more[:, 0]])
        word, target = (np.concatenate([np.array(x)[one], more[:, k]]) for k, x in ((1, self.word), (2, self.target)))
        order = np.lexsort((word, source))
        whole, whole_at = _grouped(np.array(self.whole).reshape(-1, 2), n)
        ends = (np.diff(whole_at) > 0).tolist()
        upper, short, sizes = [0] * n, [-1] * n, length.tolist()
        for s in np.argsort(length, kind="stable")[1:].tolist():
            up = link[s]
            upper[s] = s if sizes[up] < self.window else upper[up]
            short[s] = s if ends[s] else short[up]
        seen = np.array(self.seen).reshape(-1, 2)
        owners, owners_at = _grouped(np.column_stack([np.array(upper)[seen[:, 0]], seen[:, 1]]), n)
        shortest = min([self.window, *length[np.diff(whole_at) > 0].tolist()])
        arrays = {
            "about": [self.window, shortest], "at": np.searchsorted(source[order], np.arange(n + 1)), "words": word[order], "targets": target[order],
            "link": link, "length": length, "upper": upper, "short": short, "owners_at": owners_at, "owners": owners, "whole_at": whole_at, "whole": whole,
            "vocab": np.frombuffer(b" ".join(self.vocab), "uint8"), "names": np.frombuffer(json.dumps(self.names).encode(), "uint8"),
        }
        return ItemAutomaton({name: np.asarray(arrays[name]).astype(kind) for name, kind in ItemAutomaton.FIELDS})


def _grouped(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct second values by first one, and where those of each of n first ones begin."""
    pairs = np.unique(pairs.astype("int64"), axis=0)
    return pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(n + 1))


class ItemAutomaton:
    """A generalised suffix automaton over item words, with the items behind each window, as arrays that may be mapped.

    A state's edges are `words` and `targets` from at[state] on, by word; the root has one for
    each word of the vocabulary, so those stand at their words' numbers. upper: the suffix state that holds the
    run of just `window` words. short: the nearest suffix state where a short item ends, or -1.
    """

    FIELDS = (
        ("about", "<i4"), ("at", "<i4"), ("words", "<i4"), ("targets", "<i4"), ("link", "<i4"), ("length", "<i4"), ("upper", "<i4"), ("short", "<i4"),
        ("owners_at", "<i4"), ("owners", "<i4"), ("whole_at", "<i4"), ("whole", "<i4"), ("vocab", "uint8"), ("names", "uint8"),
    )

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.window, self.shortest = arrays["about"].tolist()
        self.views = [memoryview(arrays[c]) for c in ("at", "words", "targets", "link", "length", "upper", "short")]

    def to_bytes(self) -> bytes:
        head = np.array([len(self.arrays[name]) for name, _ in self.FIELDS], "<i8")
        return head.tobytes() + b"".join(self.arrays[name].tobytes() for name, _ in self.FIELDS)

    @classmethod
    def mapped(cls, path: str) -> ItemAutomaton:
        data, arrays, at = np.memmap(path, "uint8", "r"), {}, 8 * len(cls.FIELDS)
        for (name, kind), n in zip(cls.FIELDS, data[:at].view("<i8").tolist(), strict=True):
            end = at + n * np.dtype(kind).itemsize
            arrays[name], at = np.frombuffer(data[at:end], kind), end
        return cls(arrays)

    def vocabulary(self) -> list[bytes]:
        return self.arrays["vocab"].tobytes().split()

    def items(self, states: set[int], kind: str) -> set[int]:
        """The numbers of the items behind states: `owners` of windows, or `whole` short ones."""
        at, held = self.arrays[f"{kind}_at"], self.arrays[kind]
        return {x for s in states for x in held[at[s] : at[s + 1]].tolist()}

    def named(self, numbers: set[int]) -> list[str]:
        names = self.__dict__.setdefault("_names", json.loads(self.arrays["names"].tobytes()))
        return [names[x] for x in numbers if names[x] is not None]

    def match(self, ids: list[int], start: int, spans: list[list[int]], met: set[int], short_met: set[int]) -> None:
        """Streams ids, all of them in the vocabulary: adds hit spans from position `start` on, and the states of what was met."""
        at, words, targets, link, length, upper, short = self.views
        window, state, n = self.window, 0, 0
        for k, c in enumerate(ids, start + 1):
            while state:
                lo, hi = at[state], at[state + 1]
                if hi - lo > 1:
                    lo = bisect_left(words, c, lo, hi)
                if lo < hi and words[lo] == c:
                    state = targets[lo]
                    break
                state = link[state]
                n = length[state]
            else:
                state = targets[c]
            n += 1
            hit = 0
            if n >= window:
                hit = window
                met.add(upper[state])
            s = short[state]
            while s >= 0:
                if length[s] <= n:
                    hit = max(hit, length[s])
                    short_met.add(s)
                s = short[link[s]]
            if hit:
                if spans and spans[-1][1] >= k - hit:
                    while len(spans) > 1 and spans[-2][1] >= k - hit:
                        spans.pop()
                    spans[-1] = [min(spans[-1][0], k - hit), k]
                else:
                    spans.append([k - hit, k])


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Automata:
    """Automata of one pass and the words of all of them, which a text's words are looked up in once."""

    def __init__(self, held: list[ItemAutomaton]):
        self.held, self.vocab = held, {}
        numbers = [[self.vocab.setdefault(w, len(self.vocab)) for w in auto.vocabulary()] for auto in held]
        self.own = np.full((len(held), len(self.vocab) + 1), -1, "int32")  # a word's number in each; the last stands for all other words
        for k, own in enumerate(numbers):
            self.own[k, own] = np.arange(len(own))

    def scan(self, texts: list[bytes]) -> tuple[list[int], dict[int, tuple[list, set]]]:
        """Word counts, and by text the hit spans and names of items."""
        words = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), "int64", len(words))
        get, other = self.vocab.get, len(self.vocab)
        all_ids = np.fromiter((get(w, other) for x in words for w in x), "int64", counts.sum())
        ends = np.cumsum(counts)
        cut = np.zeros(len(all_ids) + 1, bool)
        cut[0], cut[ends] = True, True
        found: dict[int, tuple[list, set]] = {}
        for auto, own in zip(self.held, self.own, strict=True):
            # A word that no item has, or a document's end, takes the automaton back to its start: only
            # runs of known words that are as long as the shortest window can complete one.
            ids = own[all_ids]
            known = np.concatenate([[False], ids >= 0, [False]])
            opens = np.flatnonzero(known[1:-1] & (cut[:-1] | ~known[:-2]))
            closes = np.flatnonzero(known[1:-1] & (cut[1:] | ~known[2:])) + 1
            long = closes - opens >= auto.shortest
            hits: dict[int, tuple[list, set, set]] = {}
            for a, b in zip(opens[long].tolist(), closes[long].tolist(), strict=True):
                doc = int(np.searchsorted(ends, a, side="right"))
                auto.match(ids[a:b].tolist(), a - int(ends[doc] - counts[doc]), *hits.setdefault(doc, ([], set(), set())))
            for doc, (spans, met, short_met) in hits.items():
                if spans:
                    had, names = found.get(doc, ([], set()))
                    found[doc] = (_merged([*had, *spans]), names.union(auto.named(auto.items(met, "owners") | auto.items(short_met, "whole"))))
        return counts.tolist(), found


def cut_spans(text: bytes, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]]).decode("utf-8")


FOUND = "n_words long, spans array<array<int>>, item_ids array<string>"


def _build(window: int):
    """The automaton of a partition's items, as lines of text that one file holds."""

    def run(batches):
        builder = Builder(window)
        for batch in batches:
            for name, text in zip(batch.column("item_id").to_pylist(), byte_lists(batch, "text"), strict=True):
                builder.add(name, words_of(text))
        if builder.vocab:
            data = builder.finish().to_bytes()
            for k in range(0, len(data), LINE):
                yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(data[k : k + LINE]).decode()])], ["value"])

    return run


def build_automata(items: DataFrame, window: int, block_words: int) -> list[str]:
    """Build the automata of items (item_id, text) in tasks, and have Spark bring their files to every executor; the files' names there."""
    spark = items.sparkSession
    items = items.select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 6 / block_words))
    path = new_path(spark, "automata")
    dealt = items.repartitionById(blocks, F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    dealt.mapInArrow(_build(window), "value string").write.text(path)
    files = sorted(spark.read.text(path).inputFiles())
    for file in files:
        spark.sparkContext.addFile(file)
    return [f.rsplit("/", 1)[1] for f in files]


def _mapped(file: str) -> ItemAutomaton | None:
    """The automaton that a distributed file spells out, mapped from its bytes; the first worker of an executor puts those beside it."""
    text = SparkFiles.get(file)
    data = Path(f"{text}.bin")
    if not data.exists():
        new = Path(f"{text}.{uuid.uuid4().hex}")
        with open(text, "rb") as lines, open(new, "wb") as out:
            for line in lines:
                out.write(base64.b64decode(line))
        new.replace(data)
    return ItemAutomaton.mapped(str(data)) if data.stat().st_size else None


_automata: dict[tuple, Automata] = {}


def _loaded(files: tuple[str, ...], window: int) -> Automata:
    """The automata of one pass; a worker holds those of one pass at a time."""
    if files not in _automata:
        _automata.clear()
        found = [auto for auto in map(_mapped, files) if auto]
        _automata[files] = Automata(found or [Builder(window).finish()])
    return _automata[files]


def _pass(files: tuple[str, ...], window: int, text_col: str, names: list[str], first: bool, then=None):
    def run(batches):
        automata = _loaded(files, window)
        for batch in batches:
            for some in slices(batch, 1000, text_col):
                texts = byte_lists(some, text_col)
                spans = [[]] * len(texts) if first else some.column("spans").to_pylist()
                items = [[]] * len(texts) if first else some.column("item_ids").to_pylist()
                counts, found = automata.scan(texts)
                for k, (hit, met) in found.items():
                    spans[k] = _merged([*spans[k], *hit])
                    items[k] = sorted({*items[k], *met})
                extra = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([*(some.column(c) for c in names), *extra], [*names, "n_words", "spans", "item_ids"])
                yield then(out) if then else out

    return run


def find_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, block_words: int = 1_000_000, held: int = 16, then=None) -> DataFrame:
    """docs with n_words, the hit spans of words (merged, in order) and the ids of the items met.

    items: item_id, text. Null texts have no words, and items without words no window; an item
    without id hits words but is not named. Columns of docs named as those added are replaced.
    One automaton holds about `block_words` words of items, whatever their number; it is built in a task and mapped
    from a file by those that use it, so a worker itself holds the vocabulary alone. Documents stream through `held`
    automata in one pass; where there are more, they are written to the shared folder with what was
    found, and stream through the next ones. Items that repeat each other whole count once.
    `then` makes rows of docs' columns alone from each batch of the last pass, in the task that scanned it.
    """
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    files = build_automata(sized, window, block_words)
    out = docs.drop("n_words", "spans", "item_ids")
    names, before = out.columns, None
    schema = StructType([*out.schema, *docs.sparkSession.createDataFrame([], FOUND).schema])
    for k in range(0, max(1, len(files)), held):
        last = then if k + held >= len(files) else None
        out = out.mapInArrow(_pass(tuple(files[k : k + held]), window, text_col, names, k == 0, last), StructType(schema[: len(names)]) if last else schema)
        if k + held < len(files):
            out = stage(out, "hits")
            if before is not None:
                drop_staged(before)
            before = out
    return out


def _reaches(n_hit, n_words, coverage: float):
    """Whether so many hit words make up the coverage; of numbers or columns."""
    share = Fraction(str(coverage))
    return (n_hit > 0) & (n_hit * share.denominator >= n_words * share.numerator)


def judged(found: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """With n_hit and contaminated: some words are hit, and at least `coverage` of all words."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.withColumn("n_hit", hits).withColumn("contaminated", _reaches(F.col("n_hit"), F.col("n_words"), coverage))


def _found(docs: DataFrame, items: DataFrame, coverage: float) -> tuple[DataFrame, list[str]]:
    """The verdicts on docs, whose columns have inner names, so that none of them can clash; and those names."""
    inner = [f"c{k}" for k in range(len(docs.columns))]
    return judged(find_spans(docs.toDF(*inner), items, inner[docs.columns.index("text")]), coverage), inner


def remove_contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without the contaminated ones; hits below the limit leave a document as it is. All columns of docs stay, whatever their names."""
    found, inner = _found(docs, items, coverage)
    return found.where(~F.col("contaminated")).select(*inner).toDF(*docs.columns)


def _cut(inner: list[str], text: str, longest: int, coverage: float, drop: bool):
    def cut(batch):
        new, stays = [], []
        for whole, spans, n_words in zip(*(batch.column(c).to_pylist() for c in (text, "spans", "n_words")), strict=True):
            contaminated = _reaches(sum(b - a for a, b in spans), n_words, coverage)
            stays.append(not (drop and contaminated))
            gone = [s for s in spans if contaminated or s[1] - s[0] >= longest] if stays[-1] else []
            new.append(cut_spans(whole.encode(), gone) if gone else whole)
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(c) for c in inner], inner).filter(pa.array(stays))

    return cut


def remove_spans(docs: DataFrame, items: DataFrame, longest: int = WINDOW, coverage: float = COVERAGE, drop: bool = False) -> DataFrame:
    """docs with hit spans of at least `longest` words cut out of the text.

    Documents whose hits reach `coverage` lose all spans, or go altogether with `drop`. All
    columns of docs stay, whatever their names; null texts and rows without hits are as they were.
    """
    inner = [f"c{k}" for k in range(len(docs.columns))]
    text = inner[docs.columns.index("text")]
    return find_spans(docs.toDF(*inner), items, text, then=_cut(inner, text, longest, coverage, drop)).toDF(*docs.columns)


def judge_documents(spark, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The verdict on every document."""
    found = judged(find_spans(docs.select("doc_id", "text"), items))
    joined = F.array_join("item_ids", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(joined, "UTF-8"), 256).alias("items_sha256"), "contaminated",
    )
