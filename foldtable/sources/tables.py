"""Sources and sinks: result tables as CSV, maps and effects as Parquet, structure lists as text."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.structure import validity


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir.

    Where the session names none, a folder is made and set if all runs in one process; on a
    cluster that is an error, as every executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and an unnamed index column in front, which is dropped."""
    return spark.read.csv(path, header=True, schema=f"_c0 string, {schema}").drop("_c0")


def write_csv_table(df: DataFrame, path: str) -> None:
    index = df.select(F.monotonically_increasing_id().alias("_c0"), *df.columns)
    index.write.csv(path, header=True)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _stored(spark: SparkSession, path: str, by: str) -> list[str]:
    """Values of a partition column that a store has files of, as their folders name them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(p):
        return []
    return [x.getPath().getName().split("=", 1)[1] for x in files.listStatus(p) if x.getPath().getName().startswith(f"{by}=")]


def map_store(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write a map, energies or effects unless they are there already, and read them.

    With a partition column, only rows of values that the store lacks are computed and added: a
    filter on it stands in the plan, and what is stored stays as it is. Null is a value like any other.
    """
    spark = df.sparkSession
    if by is None:
        df.write.mode("ignore").parquet(path)
    else:
        there = _stored(spark, path, by)
        value = F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        absent = df.where(~value.isin(there)) if there else df
        absent.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None) -> DataFrame:
    """df as a table of the session, in buckets by key and sorted in each: joins and groups on the key shuffle neither side of two such tables.

    The name is a new one unless given; the table is external, in the shared folder.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", new_path(spark, name)).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def write_structures(df: DataFrame, path: str) -> None:
    df.select("structure").write.text(path)


def read_structures(spark: SparkSession, path: str, isolated: bool = False) -> DataFrame:
    """One structure a line; a line that is no valid structure is an error, and so is one with a pair that stands alone, unless those are wanted."""
    lines = spark.read.text(path).select(F.trim("value").alias("structure")).where("structure <> ''")
    bad = F.raise_error(F.concat(F.lit("no valid structure: "), "structure")).cast("string")
    good = F.col("valid_with_isolated" if isolated else "valid")
    checked = validity(lines).select(F.when(good, F.col("structure")).otherwise(bad).alias("structure"))
    return lines.join(checked, "structure")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """structure, size: one pair a line, separated by white space; sizes may be very large."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("structure"), parts[1].cast("double").alias("size"))
