"""Near-duplicate documents by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints within `radius` differing bits have a common variant within half the radius of
each, and a common variant proves the link. So every distinct fingerprint emits all variants
within half the radius, variants are shuffled, and fingerprints that meet on one are linked. The
shuffle carries a fingerprint once for every variant of its leading bits: all variants that
agree there go to the same bucket, which spells out the remaining bits itself.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lists, free_names, slices, stage, width
from .components import connected_components, local_roots

SHINGLE, SEED, BITS, RADIUS = 4, 42, 64, 4


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of each run of SHINGLE words, repeats included; of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [digest(joined, SEED)]
    sizes = np.fromiter(map(len, words), "int64", len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - SHINGLE].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]


def majority(hashes: list[int], piece: int = 200_000) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, dtype="int64")
    for at in range(0, len(hashes), piece):
        some = np.array(hashes[at : at + piece], dtype="<u8").view("uint8").reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint(carried: list[str]):
    def run(batches):
        for batch in batches:
            for some in slices(batch, 500):
                found = np.array([majority(shingle_hashes(t)) for t in byte_lists(some, "text")], dtype="uint64")
                yield pa.RecordBatch.from_arrays([*map(some.column, carried), pa.array(found.view("int64"))], [*carried, "fp"])

    return run


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, more columns (longs) and fp (64 bits as a signed long) of each row; no words (or null text) give zero."""
    carried = ["doc_id", *more]
    return docs.select(*carried, "text").mapInArrow(_fingerprint(carried), ", ".join(f"{c} long" for c in [*carried, "fp"]))


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << k for k in c) for d in range(most + 1) for c in combinations(range(bits), d)]


def _meet(fps: np.ndarray, spent: np.ndarray, bits: int, half: int, most: int):
    """Pairs of positions that share a variant in their last `bits` bits, `spent` flips being made already.

    Where that is over `most` variants, the next bit is fixed to either value first, so that
    memory stays bounded however full a bucket is.
    """
    if len(fps) < 2:
        return
    sizes = [len(fps[spent == d]) * sum(math.comb(bits, k) for k in range(half - d + 1)) for d in range(half + 1)]
    if sum(sizes) > most and bits > 0:
        bit = (fps >> np.uint64(bits - 1)) & np.uint64(1)
        for value in (0, 1):
            cost = spent + (bit != value)
            at = np.flatnonzero(cost <= half)
            for i, j in _meet(fps[at], cost[at], bits - 1, half, most):
                yield at[i], at[j]
        return
    low = fps & np.uint64((1 << bits) - 1)
    keys, owners = [], []
    for d in range(half + 1):
        at = np.flatnonzero(spent == d)
        masks = np.array(_masks(bits, half - d), dtype="uint64")
        keys.append((low[at, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(at, len(masks)))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    pairs = np.unique(np.stack([owners[same], owners[same + 1]]), axis=1) if len(same) else np.zeros((2, 0), "int64")
    yield pairs[0], pairs[1]


def _linker(lead: int, radius: int, most: int):
    def of_bucket(fps: np.ndarray, spent: np.ndarray):
        links = [np.zeros((2, 0), "int64")]
        for i, j in _meet(fps, spent, BITS - lead, (radius + 1) // 2, most):
            near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
            links.append(np.stack([i[near], j[near]]))
        a, b = np.concatenate(links, axis=1)
        root = local_roots(len(fps), a, b)
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[root[moved]].view("int64")), pa.array(fps[moved].view("int64"))], ["a", "b"])

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        order = np.argsort(buckets := whole["bucket"].to_numpy(), kind="stable")
        buckets, fps = buckets[order], whole["fp"].to_numpy()[order].view("uint64")
        spent = whole["spent"].to_numpy()[order].astype("int64")
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield of_bucket(fps[a:b], spent[a:b])

    return run


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, bucket_variants: int = 1 << 21, partition_rows: int = 1 << 20) -> DataFrame:
    """Edges (a, b) that connect just those fp of `distinct` that links of at most `radius` bits connect.

    A bucket returns a spanning forest of its links, never all pairs of a group. Where the radius is
    odd, variants go one bit beyond its half, as both sides together must cover it; the distance
    decides. A partition takes several buckets, as many as `partition_rows` emitted rows make up.
    """
    spark, half, rows = distinct.sparkSession, (radius + 1) // 2, distinct.count()
    variants = rows * sum(math.comb(BITS, k) for k in range(half + 1))
    lead = max(1, math.ceil(math.log2(max(2, width(spark)))), math.ceil(math.log2(max(1, variants / bucket_variants))))
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("spent")) for m in _masks(lead, half)])
    emitted = distinct.select("fp", F.explode(flips).alias("f"))
    bucket = F.shiftrightunsigned("fp", BITS - lead).bitwiseXOR(F.col("f.mask"))
    keyed = emitted.select(bucket.cast("int").alias("bucket"), "fp", F.col("f.spent").alias("spent"))
    emitted_rows = rows * sum(math.comb(lead, k) for k in range(half + 1))
    parts = min(1 << lead, max(width(spark), math.ceil(emitted_rows / partition_rows)))
    return keyed.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).mapInArrow(_linker(lead, radius, 2 * bucket_variants), "a long, b long")


def _with_component(classes: DataFrame, radius: int) -> DataFrame:
    """classes (distinct fp and what goes with them) with component, the smallest fp that links reach."""
    found = connected_components(link_fingerprints(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return stage(classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-joined")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id that links reach) of every row of docs.

    Rows of equal fingerprint are linked, whatever their number: they are one class throughout
    and meet their component again in the last join. Null and wordless texts have fingerprint
    zero, and are linked like any other. A row without doc_id joins its class and gets the
    class's smallest id, null if there is none. An empty table gives no rows.
    """
    rows = stage(fingerprints(docs), "simhash-rows")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    joined = _with_component(classes, radius)
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(joined.join(least, "component").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component of docs: that of the smallest doc_id and, where rows share it, of the smallest key of all columns; of rows that repeat whole one stays.

    Rows without doc_id can't be named as anyone's copy, and stay.
    """
    whole = lambda: F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = fingerprints(docs.select("doc_id", whole().alias("rid"), "text"), "rid")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rid")))
    classes = stage(rows.groupBy("fp").agg(least.alias("least")), "simhash-classes")
    kept = _with_component(classes, radius).groupBy("component").agg(F.min("least").alias("least"))
    own, doc, row = free_names(docs, "_own", "_doc", "_row")
    kept = stage(kept.select(F.col("least.doc_id").alias(doc), F.col("least.rid").alias(row)), "simhash-kept")
    keyed = docs.withColumn(own, whole())
    named = keyed.join(kept, (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(row)), "left_semi")
    return named.dropDuplicates(["doc_id", own]).drop(own).unionByName(docs.where("doc_id is null"))


def group_documents(spark, docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
