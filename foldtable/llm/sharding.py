"""Uniform shuffle into shards by a two-pass external shuffle.

Pass one scatters rows into buckets that fit in memory, by a seeded hash. Pass two puts each
bucket in a uniformly random order (Fisher-Yates) and writes it. Bucket order followed by the
order within a bucket is a uniform permutation of all rows, which is cut into shards whose row
counts differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, new_path, parts_for, stage, utf8_size


def _permuter(seed: int, starts: np.ndarray, per_task: int, rows: int, n_shards: int, inner: list[str]):
    share, extra = divmod(rows, n_shards)
    edges = np.cumsum([0] + [share + (k < extra) for k in range(n_shards)])
    by_bucket, by_hash, by_rank = inner

    def deal(bucket: int, held: list, start: int):
        whole = pa.Table.from_batches(held).combine_chunks()
        # Rows arrive in any order; a fixed order first makes a rerun of this task write the same.
        order = np.lexsort((whole[by_rank].to_numpy(), whole[by_hash].to_numpy()))
        shuffled = order[np.random.default_rng([seed, bucket]).permutation(len(order))]
        at = start + np.arange(len(order))
        shard = np.searchsorted(edges, at, side="right") - 1
        out = whole.take(pa.array(shuffled)).drop_columns(inner)
        out = out.append_column("shard", pa.array(shard.astype("int32")))
        out = out.append_column("slot", pa.array((at - edges[shard]).astype("int64")))
        yield from out.to_batches(max_chunksize=4096)

    def permute(batches):
        """The buckets of a task come one after the other, and one is held at a time."""
        bucket, held, start = -1, [], 0
        for batch in batches:
            ids = batch.column(by_bucket).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if bucket != ids[a]:
                    if held:
                        yield from deal(bucket, held, start)
                        start += sum(x.num_rows for x in held)
                    else:
                        start = int(starts[ids[a] // per_task])
                    bucket, held = int(ids[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield from deal(bucket, held, start)

    return permute


def _task_sizes(keyed: DataFrame, task: Column, tasks: int) -> np.ndarray:
    """Rows of each task's buckets: a row for each task reaches the driver."""
    counts = np.zeros(tasks, dtype="int64")
    for k, n in keyed.groupBy(task).count().toLocalIterator():
        counts[k] = n
    return counts


def _numbered_copies(rows: DataFrame, out: str, at_once: int = 4096) -> DataFrame:
    """rows with `out`, numbers from 0 for rows that repeat each other whole.

    Such rows can't be told apart, so one of each and its count are all that is needed: counts
    combine before the shuffle, and copies are made again in pieces, in as many tasks as that gives.
    """
    n, piece = free_names(rows, "_n", "_piece")
    counted = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count("*").alias(n))
    pieces = counted.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / at_once))))
    dealt = pieces.repartition(F.xxhash64(piece, *[F.col(f"`{c}`") for c in rows.columns]))
    last = F.least(F.col(n) - 1, F.col(piece) * at_once + at_once - 1)
    return dealt.withColumn(out, F.explode(F.sequence(F.col(piece) * at_once, last))).drop(n, piece)


def write_shards(
    df: DataFrame, path: str, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id",
    text_col: str = "text", bucket_bytes: int = 24 << 20, most_tasks: int = 1 << 15,
) -> DataFrame:
    """Write every row of df, in uniformly random order, to `path`/shard=K and read it back.

    Adds `shard` and `slot` (position in its shard, without gaps); columns of those names in df
    are replaced. Null ids and texts are ordinary values. Rows scatter by id and text, so no
    source and no group of copies makes a bucket large. Only rows equal in both could: those
    whose bytes reach a quarter of a bucket scatter by their other columns and a number among equal rows
    as well. Where a row goes thus follows from the rows alone, never from how they are partitioned.
    An empty table writes no rows. Buckets hold about `bucket_bytes`, and their number follows the
    data. They are scattered over `most_tasks` tasks at most; a task with several of them sorts its rows by
    bucket, outside memory where need be, and shuffles them one by one. The driver keeps a row count for
    each task and the hashes of such repeated rows, of which there are four for each bucket at most.
    """
    spark = df.sparkSession
    kept = df.drop("shard", "slot")
    size = kept.agg(F.count("*").alias("n"), F.sum(utf8_size(F.col(text_col)) + 64).alias("b")).first()
    buckets = parts_for(spark, size.b, bucket_bytes)
    inner = by_bucket, by_hash, by_rank = free_names(kept, "_bucket", "_hash", "_rank")
    hashed = kept.withColumn(by_hash, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    groups = hashed.groupBy(by_hash).agg(F.count("*").alias("rows"), F.sum(utf8_size(F.col(text_col)) + 64).alias("bytes"))
    many = [r[0] for r in groups.where(F.col("rows") > 1).where(F.col("bytes") * 4 >= bucket_bytes).select(by_hash).collect()]
    if many:
        # Kept for all that reads the deal, and a list of values rather than a join, so that rows stay where they are.
        (copy,) = free_names(hashed, "_copy")
        repeated = F.col(by_hash).isin(many)
        salted = _numbered_copies(hashed.where(repeated), copy).withColumn(by_hash, F.xxhash64(by_hash, copy, *[F.col(f"`{c}`") for c in kept.columns])).drop(copy)
        hashed = stage(hashed.where(~repeated).unionByName(salted), "scattered")
    keyed = hashed.withColumn(by_bucket, F.pmod(by_hash, F.lit(buckets)).cast("int"))
    per_task = math.ceil(buckets / most_tasks)
    tasks, task = math.ceil(buckets / per_task), F.floor(F.col(by_bucket) / per_task).cast("int")
    counts = _task_sizes(keyed, task, tasks)
    starts = np.cumsum(counts) - counts

    schema = kept.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).schema
    (
        keyed.withColumn(by_rank, F.coalesce(F.hash(*[F.col(f"`{c}`") for c in kept.columns]), F.lit(0)))
        .repartitionById(tasks, task)
        .sortWithinPartitions(by_bucket)
        .mapInArrow(_permuter(seed, starts, per_task, size.n, n_shards, inner), schema)
        .write.partitionBy("shard").option("compression", "zstd").parquet(path)
    )
    return spark.read.schema(schema).parquet(path)


def shard_documents(spark, docs: DataFrame) -> DataFrame:
    """The shards of `docs` as one row per document: where it went and a digest of its text."""
    out = write_shards(docs.select("doc_id", "text"), new_path(spark, "shards"))
    return out.select(
        "doc_id",
        (utf8_size(F.col("text")) + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
