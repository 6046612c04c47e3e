"""Fuzzy line deduplication by MinHash.

A line is near another when their sets of character shingles have a Jaccard similarity of at
least `THRESHOLD`. Signatures of shingle hashes are cut into bands; lines that agree on a band
are compared exactly, on their text; what is near is united, and of each component one line
stays. Equal lines are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_lists, drop_staged, parts_for, slices, stage
from .components import connected_components

SHINGLE, THRESHOLD = 8, 0.8
#: With 12 bands of 4, a pair at the threshold meets in one with probability 0.998.
BANDS, ROWS = 12, 4
BINS = BANDS * ROWS
ROLL, MIX32 = np.uint32(0x9E3779B1), (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))  # odd multipliers
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # odd 64-bit multipliers

FOUND = np.dtype([("key", "<u4"), ("line", "<i8")])


def normal(line: str) -> str:
    """A line as it is compared: lower case, white space as single spaces."""
    if line.isprintable() and "  " not in line and line[:1] != " " != line[-1:]:
        return line.lower()  # what is printable has no white space but the space
    return " ".join(line.lower().split())


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def _mixed32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * MIX32[0]
    x ^= x >> np.uint32(13)
    x *= MIX32[1]
    x ^= x >> np.uint32(16)
    return x


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash: a row of BINS values for each line (none of them empty).

    The upper half of a shingle's hash says which bin it falls in, the lower half counts there
    first; an empty bin takes the value of the next one that isn't. Shorter lines are one shingle.
    """
    sizes = np.fromiter(map(len, lines), "int64", len(lines))
    rolled = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)
    span = 1  # hashes of windows of 1, 2, 4 and 8 characters
    while span < SHINGLE:
        p = np.uint32(pow(int(ROLL), span, 1 << 32))
        rolled = rolled[: len(rolled) - span] * p + rolled[span:] if len(rolled) > span else rolled[:0]
        span *= 2
    hashes = _mixed32(rolled)
    owner = np.repeat(np.arange(len(lines), dtype="int32") * np.int32(BINS), sizes)[: len(hashes)]
    ends = np.cumsum(sizes)
    crossing = (ends[:, None] - np.arange(1, SHINGLE)[None, :]).ravel()  # windows that reach into the next line
    crossing = crossing[(crossing >= 0) & (crossing < len(hashes))]
    slots = owner + ((hashes >> np.uint32(16)) * np.uint32(BINS) >> np.uint32(16)).astype("int32")
    values32 = (hashes << np.uint32(16)) | (hashes >> np.uint32(16))
    none = np.uint32(0xFFFFFFFF)
    values32[crossing] = none
    least = np.full(len(lines) * BINS, none)
    np.minimum.at(least, slots, values32)
    short = np.flatnonzero(sizes < SHINGLE)
    if len(short):
        whole = np.array([xxhash.xxh32_intdigest(lines[k].encode()) for k in short], "uint32")
        least.reshape(-1, BINS)[short] = none
        least.reshape(-1, BINS)[short, 0] = np.minimum(whole, none - np.uint32(1))
    values = least.reshape(-1, BINS).astype("uint64")
    empty = least.reshape(-1, BINS) == none
    if empty.any():
        where = np.where(empty, 2 * BINS, np.arange(BINS)[None, :])
        ahead = np.minimum.accumulate(np.concatenate([where, where + BINS], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        values = np.take_along_axis(values, ahead % BINS, axis=1)
    return values


def band_keys(lines: list[str]) -> np.ndarray:
    """A 64-bit key for each line and band."""
    values = signatures(lines).reshape(len(lines), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype="uint64")[None, :], values.shape[:2]) * MIX[0]
    for r in range(ROWS):
        key = _mixed(key * MIX[1] + values[:, :, r])
    return key


def shingles(line: str) -> set[str]:
    return {line[k : k + SHINGLE] for k in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _split(text: bytes) -> list[str]:
    return text.decode().split("\n")


def row_key() -> Column:
    """Tells rows apart that have the same doc_id; repeated rows are one document."""
    return F.xxhash64("doc_id", "text")


def _grouped(found: np.ndarray, band: np.ndarray):
    """Entries sorted by key, without repeats, and the flags of those that share their key with another."""
    order = np.lexsort((found["line"], band))
    found, band = found[order], band[order]
    new = np.concatenate([[True], (band[1:] != band[:-1]) | (found["line"][1:] != found["line"][:-1])])[: len(found)]
    found, band = found[new], band[new]
    first = np.concatenate([[True], band[1:] != band[:-1]])[: len(found)]
    last = np.concatenate([first[1:], [True]])[: len(found)]
    return found, band, first, ~(first & last)


def _emit(buckets: int, most: int):
    """Band entries of one task, by bucket.

    Lines of one task that share a key are told as a group right away (in a bucket that only
    passes them on), and one of them stands for the group where tasks meet: a key that countless
    lines share comes to its bucket once from each task.
    """

    def run(batches):
        task = TaskContext.get().partitionId()
        keys, lines, held = [], [], 0

        def flush():
            band, line = np.concatenate(keys), np.concatenate(lines)
            found = np.empty(len(line), FOUND)
            found["key"], found["line"] = band & np.uint64(0xFFFFFFFF), line
            found, band, first, shared = _grouped(found, band)
            out = []
            if shared.any():
                group = np.empty(int(shared.sum()), [("band", "<u8"), ("line", "<i8")])
                group["band"], group["line"] = band[shared], found["line"][shared]
                out.append((buckets + task % buckets, group.tobytes()))
            found, band = found[first], band[first]
            bucket = ((band >> np.uint64(32)) % np.uint64(buckets)).astype("int64")
            order = np.argsort(bucket, kind="stable")
            found, bucket = found[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            out += [(b, found[edges[b] : edges[b + 1]].tobytes()) for b in range(buckets) if edges[b] < edges[b + 1]]
            keys.clear(), lines.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "entries"])

        for batch in batches:
            for some in slices(batch, 400):
                distinct = list(dict.fromkeys(n for t in byte_lists(some, "text") for x in _split(t) if (n := normal(x))))
                if distinct:
                    ids = np.frombuffer(b"".join(line_key(x)[:8] for x in distinct), "<i8")
                    keys.append(band_keys(distinct).ravel()), lines.append(np.repeat(ids, BANDS))
                    held += len(distinct) * BANDS
                if held > most:
                    held = 0
                    yield flush()
        if keys:
            yield flush()

    return run


def _meet(buckets: int):
    """(key, line) of lines that share a key with another."""

    def run(batches):
        parts, bucket = [], 0
        for batch in batches:
            for b, entries in zip(batch.column("bucket").to_pylist(), batch.column("entries"), strict=True):
                bucket = b
                if b >= buckets:
                    group = np.frombuffer(entries.as_py(), [("band", "<u8"), ("line", "<i8")])
                    low, upper = group["band"] & np.uint64(0xFFFFFFFF), (group["band"] >> np.uint64(32)) % np.uint64(buckets)
                    yield pa.RecordBatch.from_arrays([pa.array((upper.astype("int64") << 32) + low.astype("int64")), pa.array(group["line"])], ["key", "h"])
                else:
                    parts.append(np.frombuffer(entries.as_py(), FOUND))
        if parts:
            found, band, _, shared = _grouped(whole := np.concatenate(parts), whole["key"])
            yield pa.RecordBatch.from_arrays([pa.array((bucket << 32) + band[shared].astype("int64")), pa.array(found["line"][shared])], ["key", "h"])

    return run


def candidates(docs: DataFrame, total: int, entry_bytes: int = 24 << 20) -> DataFrame:
    """(hub, h): lines, by the first half of their key, that share a band's key with another line.

    All that share a key form a group, and its smallest line is its hub. Groups of one hub are put
    together, so a line that meets another in many bands comes here once.
    """
    buckets = parts_for(docs.sparkSession, total // 100 * BANDS * FOUND.itemsize // 3, entry_bytes)
    emitted = docs.select("text").mapInArrow(_emit(buckets, 3_000_000), "bucket int, entries binary")
    met = stage(emitted.repartitionById(2 * buckets, F.col("bucket")).mapInArrow(_meet(buckets), "key long, h long"), "lines-met")
    hubs = met.groupBy("key").agg(F.min("h").alias("hub"))
    groups = stage(met.join(hubs, "key").select("hub", "h").distinct(), "lines-groups")
    drop_staged(met)
    return groups


#: One occurrence of a line: the halves of its key, and where it is. Rows without doc_id come first.
SPOT = np.dtype([("h", "<i8"), ("low", "<u8"), ("known", "u1"), ("doc", "<i8"), ("rid", "<i8"), ("pos", "<i4")])
PLACE = ["known", "doc", "rid", "pos"]


def _settled(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first occurrence of each line, in order of the lines, and of those that come later."""
    order = np.lexsort([spots[f] for f in reversed(["h", "low", *PLACE])])
    lines, places = spots[["h", "low"]][order], spots[PLACE][order]
    new = np.concatenate([[True], lines[1:] != lines[:-1]])[: len(order)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[new], order[places != places[first]]


def _spread(buckets: int, most: int):
    """Blocks of the distinct lines of a task, by bucket of the line, and of occurrences that aren't the first there.

    What is not the first in its own task is not the first of all, so a line comes to its bucket
    once from each task, however common it is.
    """

    def run(batches):
        packer, task = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        spots: list[tuple] = []
        words: list[str] = []
        held = 0

        def flush():
            found = np.array(spots, SPOT)
            first, later = _settled(found)
            out = [(task % buckets, GONE, found[later[k : k + 100_000]].tobytes()) for k in range(0, len(later), 100_000)]
            bucket = found["h"][first] % buckets
            by = np.argsort(bucket, kind="stable")
            for at in np.split(first[by], np.flatnonzero(np.diff(bucket[by])) + 1):
                texts = [words[k].encode() for k in at.tolist()]
                head = np.array([len(at)], "<i8").tobytes() + found[at].tobytes() + np.array(list(map(len, texts)), "<i8").tobytes()
                out.append((int(found["h"][at[0]] % buckets), LINES, packer.compress(head + b"".join(texts))))
            spots.clear(), words.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.nulls(len(out), pa.int64()), pa.array([x[2] for x in out], pa.binary())], BLOCK)

        for batch in batches:
            for some in slices(batch, 400):
                for text, doc, rid in zip(byte_lists(some, "text"), some.column("doc_id").to_pylist(), some.column("rid").to_pylist(), strict=True):
                    for pos, raw in enumerate(_split(text)):
                        if line := normal(raw):
                            key = line_key(line)
                            spots.append((int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little"), doc is not None, doc or 0, rid, pos))
                            words.append(line)
                            held += len(line)
                if held > most:
                    held = 0
                    yield flush()
        if spots:
            yield flush()

    return run


LINES, GONE, WANTED = 0, 1, 2
BLOCK = ["bucket", "kind", "h", "block"]
PLACED = "h long, line binary, words string, doc_id long, rid long, pos int"


def _unpacked_lines(data: bytes, wanted: np.ndarray):
    """Occurrences of a block, and the texts of those whose line is wanted."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    spots = np.frombuffer(data, SPOT, n, 8)
    sizes = np.frombuffer(data, "<i8", n, 8 + n * SPOT.itemsize)
    ends = np.cumsum(sizes) + 8 + n * (SPOT.itemsize + 8)
    at = np.flatnonzero(np.isin(spots["h"], wanted))
    return spots, {int(k): data[int(ends[k] - sizes[k]) : int(ends[k])] for k in at}


def _placed(spots: np.ndarray, words: list[bytes] | None) -> pa.RecordBatch:
    """Rows of PLACED: of lines with their text, or of occurrences alone."""
    n = len(spots)
    docs = pa.array(spots["doc"], pa.int64(), mask=spots["known"] == 0)
    if words is None:
        what = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string())]
    else:
        raw = np.stack([spots["h"].view("<u8"), spots["low"]], axis=1).tobytes()
        keys = [raw[k : k + 16] for k in range(0, 16 * n, 16)]
        what = [pa.array(spots["h"]), pa.array(keys, pa.binary()), pa.array(words, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*what, docs, pa.array(spots["rid"]), pa.array(spots["pos"])], ["h", "line", "words", "doc_id", "rid", "pos"])


def _settle(batches):
    """Of one bucket: the occurrences that aren't the first of their line, and wanted lines with text and first occurrence."""
    opener, packed, wanted = zstandard.ZstdDecompressor(), [], [np.zeros(0, "int64")]
    for batch in batches:
        kinds = np.asarray(batch.column("kind"))
        wanted.append(batch.column("h").filter(pa.array(kinds == WANTED)).to_numpy())
        for kind, block in zip(kinds.tolist(), batch.column("block"), strict=True):
            if kind == GONE:
                yield _placed(np.frombuffer(block.as_py(), SPOT), None)
            elif kind == LINES:
                packed.append(block.as_py())
    asked, spots, texts, at = np.concatenate(wanted), [], {}, 0
    for block in packed:
        some, words = _unpacked_lines(opener.decompress(block), asked)
        texts |= {at + k: w for k, w in words.items()}
        spots.append(some)
        at += len(some)
    if spots:
        whole = np.concatenate(spots)
        first, later = _settled(whole)
        yield _placed(whole[later], None)
        met = [k for k in first.tolist() if k in texts]
        for k in range(0, len(met), 2000):
            yield _placed(whole[met[k : k + 2000]], [texts[x] for x in met[k : k + 2000]])


def settled_lines(docs: DataFrame, groups: DataFrame, total: int, bucket_bytes: int = 24 << 20) -> DataFrame:
    """Rows of PLACED: occurrences of lines that have an earlier one, with h null, and each line of groups where it comes first."""
    buckets = parts_for(docs.sparkSession, total, bucket_bytes)
    blocks = docs.mapInArrow(_spread(buckets, 64 << 20), "bucket int, kind int, h long, block binary")
    asked = groups.select("h").distinct()
    asked = asked.select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), F.lit(WANTED).alias("kind"), "h", F.lit(None).cast("binary").alias("block"))
    return blocks.unionByName(asked).repartitionById(buckets, F.col("bucket")).mapInArrow(_settle, PLACED)


def _pack(names: list[str]):
    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for some in slices(batch, 1000):
                packed = pa.array([packer.compress(t) for t in byte_lists(some, "text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), packed], [*names, "packed"])

    return run


def _unpacked(batch) -> list[bytes]:
    opener = zstandard.ZstdDecompressor()
    return [opener.decompress(x) for x in batch.column("packed").to_pylist()]


CELLS = 256


def _codes(lines: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The shingles of each line as sorted numbers, equal for equal shingles, and how many of its windows fall in each of CELLS cells.

    A line shorter than a shingle has none, as nothing is like it.
    """
    whole = "".join(lines)
    sizes = np.fromiter(map(len, lines), "int64", len(lines))
    starts, counts = np.cumsum(sizes) - sizes, np.maximum(0, sizes - SHINGLE + 1)
    if not whole.isascii() and max(whole) > "\xff" and len(letters := sorted(set(whole))) <= CELLS:
        whole, letters = whole.translate({ord(c): k for k, c in enumerate(letters)}), []
    try:
        raw = whole.encode("latin-1")
        windows = np.ndarray(max(0, len(raw) - SHINGLE + 1), "<u8", raw, 0, (1,)).astype("uint64")
    except UnicodeEncodeError:  # too many letters for a byte each
        number: dict[str, int] = {}
        windows = np.array([number.setdefault(whole[k : k + SHINGLE], len(number)) for k in range(len(whole) - SHINGLE + 1)], "uint64")
    inside = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    windows, ends = windows[inside], np.cumsum(counts).tolist()
    cells = np.repeat(np.arange(len(lines)) * CELLS, counts) + ((windows * MIX[0]) >> np.uint64(56)).astype("int64")
    held = np.bincount(cells, minlength=len(lines) * CELLS).reshape(-1, CELLS)
    codes = []
    for at, end in zip([0, *ends], ends, strict=False):
        own = np.sort(windows[at:end])
        codes.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return codes, held.astype("uint16" if sizes.max() < 1 << 16 else "int64")


def unite(lines: list[str], root: np.ndarray, side: int, threshold: float) -> np.ndarray:
    """Roots (positions) after uniting all near lines; lines of equal root are near by way of others already.

    Pairs with both ends before `side`, or both from there on, are known; a side of 0 knows none.
    A pair is left out only if its ends are united already, or if so few windows fall in the same
    cells that they can't share enough shingles.
    """
    codes, held = _codes(lines)
    sizes, root = np.array([max(1, len(c)) for c in codes], "int64"), root.copy()
    for j in range(max(1, side), len(lines)):
        open_ = np.flatnonzero(root[: side or j] != root[j])
        if not len(open_):
            continue
        least = np.minimum(np.minimum(held[open_], held[j]).sum(1, dtype="int64"), np.minimum(sizes[open_], sizes[j]))
        most = least / (sizes[open_] + sizes[j] - least)
        able = most >= threshold
        maybe = open_[able][np.argsort(-most[able], kind="stable")]
        while len(maybe):
            i = maybe[0]
            merged = np.sort(np.concatenate([codes[i], codes[j]]))
            both = int(np.count_nonzero(merged[1:] == merged[:-1]))
            if both / int(sizes[i] + sizes[j] - both) >= threshold:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
                maybe = maybe[root[maybe] != root[j]]
            else:
                maybe = maybe[1:]
    return root


LINKED = "a binary, b binary, hub long, part int, parts int, block binary"


def _packed_block(keys: list[bytes], lines: list[str], root: np.ndarray) -> bytes:
    texts = [x.encode() for x in lines]
    head = np.concatenate([[len(keys)], root, list(map(len, texts))]).astype("<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join([*keys, *texts]))


def _unpacked_block(block: bytes) -> tuple[list[bytes], list[str], np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    root, sizes = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 * (n + 1))
    at = 8 * (2 * n + 1)
    ends = np.cumsum(sizes) + at + 16 * n
    texts = [data[e - z : e].decode() for e, z in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return [data[at + 16 * k : at + 16 * (k + 1)] for k in range(n)], texts, root


def _forest(keys: list[bytes], root: np.ndarray, before: np.ndarray) -> list[tuple]:
    """Edges of what was united: one for each root that is none any more."""
    moved = np.flatnonzero((root != before) & (before == np.arange(len(before))))
    return [(keys[root[k]], keys[k], None, None, None, None) for k in moved.tolist()]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["a", "b", "hub", "part", "parts", "block"])


def _runs(batches, names: list[str], more: list[str]):
    """Rows that follow each other with equal values of `names`: those values, and lists of the other columns."""
    last, held = None, [[] for _ in more]
    for batch in batches:
        values = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        columns = [batch.column(c).to_pylist() for c in more]
        start = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or values[k] != values[start]:
                if last is not None and values[start] != last:
                    yield last, held
                    held = [[] for _ in more]
                last = values[start]
                for h, c in zip(held, columns, strict=True):
                    h += c[start:k]
                start = k
    if last is not None:
        yield last, held


def _within(threshold: float):
    """Edges that unite the near lines of each block, and the block itself where its group has several."""

    def run(batches):
        out, size = [], 0
        for (hub, part, parts), (keys, lines) in _runs(batches, ["hub", "part", "parts"], ["line", "words"]):
            before = np.arange(len(keys))
            root = unite(lines, before, 0, threshold)
            out += _forest(keys, root, before)
            if parts > 1:
                out.append((None, None, hub, part, parts, _packed_block(keys, lines, root)))
                size += len(out[-1][-1])
            if len(out) > 5000 or size > 16 << 20:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    return run


def _across(threshold: float):
    """Edges that unite the near lines of two blocks of a group."""

    def run(batches):
        for _, (blocks,) in _runs(batches, ["hub", "low", "high"], ["block"]):
            if len(blocks) < 2:  # no line fell into the other one
                continue
            (keys, lines, root), (more, others, apart) = map(_unpacked_block, blocks)
            before = np.concatenate([root, apart + len(keys)])
            found = _forest(keys + more, unite(lines + others, before, len(keys), threshold), before)
            if found:
                yield _rows(found)

    return run


def _parts(chars: Column, least: int, most: int) -> Column:
    """Blocks of a group: they grow with the root of its size, and reach `most` characters at last."""
    return F.greatest(F.ceil(F.sqrt(chars / least)), F.ceil(chars / most)).cast("int")


def near_lines(groups: DataFrame, texts: DataFrame, threshold: float, least: int = 32 << 10, most: int = 4 << 20, task_chars: int = 32 << 20) -> DataFrame:
    """Edges (a, b) that connect just those lines that near pairs of a group connect.

    A group (hub, h) is compared where its lines are put together, and gives a forest of its near
    lines, never their pairs. One of over `least` characters is cut into blocks: each is
    compared in itself, then any two of them meet as packed rows.
    """
    joined = stage(groups.join(texts, "h").select("hub", "line", "words", F.length("words").alias("chars")), "lines-joined")
    large = joined.groupBy("hub").agg(F.sum("chars").alias("size")).where(F.col("size") > least)
    large = stage(large.select("hub", "size", _parts(F.col("size"), least, most).alias("parts")), "lines-large")
    spark, copied = groups.sparkSession, large.agg(F.sum(F.col("size") * F.col("parts"))).first()[0]
    cut = joined.join(large.drop("size"), "hub", "left").select("hub", "line", "words", F.coalesce("parts", F.lit(1)).alias("parts"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
    by = ["hub", "part"]
    total = joined.agg(F.sum("chars")).first()[0]
    dealt = cut.repartition(parts_for(spark, total, task_chars), *by).sortWithinPartitions(*by)
    linked = stage(dealt.mapInArrow(_within(threshold), LINKED), "lines-linked")
    blocks = linked.where("block is not null").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> other")
    blocks = blocks.select("hub", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "block")
    by = ["hub", "low", "high"]
    met = blocks.repartition(parts_for(spark, copied, task_chars), *by).sortWithinPartitions(*by, "part")
    across = met.mapInArrow(_across(threshold), LINKED)
    found = stage(linked.where("block is null").select("a", "b").unionByName(across.select("a", "b")), "lines-edges")
    for t in (joined, large, linked):
        drop_staged(t)
    return found


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, rid, pos of each line of docs (doc_id, rid, text) of whose component another line stays.

    The line that stays is the first by (doc_id, rid, pos); a repeated row loses the lines that
    its twin loses. Lines without anything but white space have no component.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = candidates(docs, total)
    settled = stage(settled_lines(docs, groups, total), "lines-settled")
    texts = settled.where("h is not null")
    edges = near_lines(groups, texts.select("h", "line", "words"), threshold)
    members = connected_components(edges).join(texts.select(F.col("line").alias("node"), F.struct("doc_id", "rid", "pos").alias("at")), "node")
    members = stage(members.select("component", "at"), "lines-members")
    kept = members.groupBy("component").agg(F.min("at").alias("kept"))
    later = members.join(kept, "component").where(F.col("at") != F.col("kept")).select("at.doc_id", "at.rid", "at.pos")
    gone = stage(settled.where("h is null").select("doc_id", "rid", "pos").unionByName(later), "lines-gone")
    for t in (groups, settled, edges, members):
        drop_staged(t)
    return gone


def _cut(names: list[str]):
    def run(batches):
        for batch in batches:
            for some in slices(batch, 500):
                texts, counts, kept = [], [], []
                for text, none, gone in zip(_unpacked(some), some.column("none").to_pylist(), some.column("gone").to_pylist(), strict=True):
                    lines = _split(text)
                    drop = set(gone or ())
                    full = sum(1 for x in lines if x.strip())
                    counts.append(full), kept.append(full - len(drop))
                    texts.append(None if none else "\n".join(x for p, x in enumerate(lines) if p not in drop))
                extra = [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kept, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), *extra], [*names, "text", "n_lines", "n_kept"])

    return run


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with repeated and near-repeated lines taken out of the text, n_lines and n_kept.

    Lines end at line feeds. Of equal and near lines the first stays, by doc_id (null first);
    blank lines stay and aren't counted. A null text stays null, and a text may end up empty.
    Columns of docs named as those added are replaced. An empty table gives no rows.
    """
    plain = docs.drop("n_lines", "n_kept")
    slim = plain.select("doc_id", row_key().alias("rid"), "text")
    gone = repeated_lines(slim, threshold).groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("_gone"))
    gone = stage(gone.withColumnsRenamed({"doc_id": "_doc", "rid": "_row"}), "lines-gone")
    names = [c for c in plain.columns if c != "text"]
    inner = [f"c{k}" for k in range(len(names))]
    base = plain.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)], row_key().alias("_rid"), F.col("text").isNull().alias("none"), "text")
    carried = [*inner, "_rid", "none"]
    packed_schema = base.select(*carried, F.lit(b"").alias("packed")).schema
    packed = base.mapInArrow(_pack(carried), packed_schema)
    id_at = inner[names.index("doc_id")]
    joined = packed.join(gone, (F.col("_rid") == F.col("_row")) & F.col(id_at).eqNullSafe(F.col("_doc")), "left").select(*inner, "none", "packed", F.col("_gone").alias("gone"))
    out_schema = T.StructType([*joined.select(*inner).schema, *(T.StructField(c, k) for c, k in (("text", T.StringType()), ("n_lines", T.LongType()), ("n_kept", T.LongType())))])
    cut = joined.mapInArrow(_cut(inner), out_schema)
    back = cut.withColumnsRenamed(dict(zip(inner, names, strict=True)))
    return back.select(*plain.columns, "n_lines", "n_kept")


def thin_documents(spark, docs: DataFrame) -> DataFrame:
    """Lines of every document, how many stay, and a digest of what is left of it."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
