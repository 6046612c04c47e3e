"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the session names none, a folder is made and set if all runs in one process; on a
    cluster that is an error, as every executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged frame that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        remove_path(df.sparkSession, f)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores before those that df has already, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, total: int | None, per_part: int) -> int:
    """Enough partitions to hold `total` units at `per_part` each, and to keep all cores busy."""
    return max(width(spark), math.ceil((total or 0) / per_part))


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a string column, null counting as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def sha256_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def byte_lists(batch, name: str) -> list[bytes]:
    """A string column of an Arrow batch as bytes objects, null as empty."""
    import pyarrow as pa

    column = batch.column(name)
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(binary).to_pylist()]


def slices(batch, rows: int, name: str = "text", most: int = 8 << 20):
    """An Arrow batch in pieces of so many rows, and of about `most` bytes (or list elements) of column `name`, so that working memory follows the piece."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    step = np.arange(batch.num_rows) // rows
    turn = np.zeros_like(step)
    if name in batch.schema.names:
        column = batch.column(name)
        sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
        sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype("int64")
        turn = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero((np.diff(step) != 0) | (np.diff(turn) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)
