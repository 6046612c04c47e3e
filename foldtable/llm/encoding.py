"""What byte-level encoders share: the byte alphabet, exact merging, and encoding unit by unit."""

from __future__ import annotations

import heapq
from itertools import chain, repeat

import numpy as np

#: The characters that stand for bytes in the vocabulary. Printable bytes of
#: Latin-1 stand for themselves, the others follow from 256 on in order.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
OTHERS = [b for b in range(256) if b not in PRINTABLE]
BYTE_CHARS = {b: chr(b if b in PRINTABLE else 256 + OTHERS.index(b)) for b in range(256)}


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` at starts, one after another, and where each begins, with the end."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    return flat[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])], ends


class Merges:
    """Byte-pair merging as a tokenizer file's model has it: the pair of lowest rank first, leftmost first, until none is left."""

    def __init__(self, model: dict, longest: int = 64):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.longest = longest
        self.inner = np.array([vocab[BYTE_CHARS[b]] for b in range(256)], "int64")
        self.last = np.array([vocab[BYTE_CHARS[b] + end] for b in range(256)], "int64")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: The id that the pair of each rank becomes.
        self.new = np.array([vocab[a[: len(a) - len(end)] + b if end and a.endswith(end) else a + b] for a, b in pairs], "int64")
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], "int64")
        self.none, order = len(pairs), np.argsort(keys)
        self.keys, self.rank = np.append(keys[order], np.iinfo("int64").max), np.append(order, self.none)
        self.ranks = dict(zip(keys.tolist(), range(len(pairs)), strict=True))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def long(self, word: bytes) -> list[int]:
        """One word of any length: its pairs wait in a heap, and what is left of it is a linked list."""
        ids = [*self.inner[np.frombuffer(word[:-1], "uint8")].tolist(), int(self.last[word[-1]])]
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        find = self.ranks.get
        heap = [(r, k) for k in range(len(ids) - 1) if (r := find(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            m = after[k]
            if ids[k] < 0 or m < 0 or find(ids[k] << 32 | ids[m]) != rank:
                continue  # one of the two has gone into another pair
            ids[k], ids[m], after[k] = int(self.new[rank]), -1, after[m]
            if after[m] >= 0:
                before[after[m]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (r := find(ids[left] << 32 | ids[after[left]])) is not None:
                    heapq.heappush(heap, (r, left))
        return [i for i in ids if i >= 0]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has; every word takes a merge at a time, all of them together."""
        sizes = np.fromiter(map(len, words), "int64", len(words))
        brief = np.flatnonzero((sizes > 0) & (sizes <= self.longest))
        counts = np.zeros(len(words), "int64")
        flat, counts[brief] = self._brief([words[k] for k in brief.tolist()], sizes[brief])
        at = np.flatnonzero(sizes > self.longest).tolist()
        if not at:
            return flat, counts
        whole = [self.long(words[k]) for k in at]
        starts = np.cumsum(counts) - counts
        starts[at] = len(flat) + np.cumsum([0, *map(len, whole[:-1])])
        counts[at] = list(map(len, whole))
        return gather(np.concatenate([flat, *whole]).astype("int64"), starts, counts)[0], counts

    def _brief(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, "int64"), sizes
        flat = np.frombuffer(b"".join(words), "uint8")
        n, ends = len(flat), np.cumsum(sizes)
        starts = ends - sizes
        ids = self.inner[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[starts] = -1, -1
        none = self.none * n
        key = np.full(n, none)
        at = np.flatnonzero(after >= 0)
        key[at] = self._ranks(ids[at], ids[at + 1]) * n + at
        key[key > none] = none
        while True:
            least = np.minimum.reduceat(key, starts)
            least = least[least < none]
            if not len(least):
                break
            rank, k = np.divmod(least, n)
            gone = after[k]
            follow = after[gone]
            ids[k], ids[gone], key[gone], key[k], after[k] = self.new[rank], -1, none, none, follow
            has = follow >= 0
            before[follow[has]] = k[has]
            left = np.concatenate([before[k][before[k] >= 0], k[has]])
            found = self._ranks(ids[left], ids[after[left]])
            key[left] = np.where(found < self.none, found * n + left, none)
        kept = ids >= 0
        return ids[kept], np.add.reduceat(kept, starts, dtype="int64")


class UnitEncoder:
    """Encodes texts by units whose ids don't depend on their neighbours, asking for each once.

    `held` bounds the memory of units; when it is reached they are forgotten and asked for again.
    """

    def __init__(self, held: int):
        self.held = held
        self.forget()

    def split(self, text: bytes) -> list:
        raise NotImplementedError

    def ask(self, units: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and how many each has."""
        raise NotImplementedError

    def forget(self) -> None:
        self.known: dict = {}
        self.flat, self.starts, self.counts = (np.zeros(0, dtype=k) for k in ("int32", "int64", "int64"))

    def learn(self, units: list) -> None:
        parts = [self.ask(units[at : at + 20_000]) for at in range(0, len(units), 20_000)]
        counts = np.concatenate([c for _, c in parts])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, *[ids.astype("int32") for ids, _ in parts]])
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if len(self.known) > self.held:
            self.forget()
        split = [self.split(t) for t in texts]
        n = np.fromiter(map(len, split), "int64", len(split))
        units = list(chain.from_iterable(split))
        codes = np.fromiter(map(self.known.get, units, repeat(-1)), "int64", len(units))
        new = np.flatnonzero(codes < 0).tolist()
        if new:
            self.learn(list(dict.fromkeys([units[k] for k in new])))
            codes[new] = [self.known[units[k]] for k in new]
        ids, ends = gather(self.flat, self.starts[codes], self.counts[codes])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(n)])])
