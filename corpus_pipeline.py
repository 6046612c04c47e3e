"""From raw documents to token ids, in five stages.

Each stage works on all that the one before it kept, written as Parquet in between:

1. quality classifier: documents that score below its cut go;
2. line dedup: of equal and near-equal lines the first stays; a document of which no line is left
   goes, as all of it stands elsewhere;
3. SimHash near-dedup: of each group the document with the smallest id stays. Within 4 of 64 bits
   lie copies and all but exact copies; documents that share four fifths of their shingles differ in about
   ten bits, which is beyond any radius whose variants can be spelled out. What near copies share
   by lines has gone in stage 2;
4. benchmark decontamination: contaminated documents go, and longer passages are cut from the others;
5. BPE: the ids of every document, checked by decoding them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldtable.llm import bpe, decontaminate, line_dedup, quality, simhash
from foldtable.llm.common import free_names, stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def thin_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clash = [c for c in docs.columns if c.lower() in ("n_lines", "n_kept")]
    held = dict(zip(clash, free_names(docs, *[f"_{c}" for c in clash]), strict=True))
    thinned = line_dedup.dedup_lines(docs.withColumnsRenamed(held)).where((F.col("n_kept") > 0) | (F.col("n_lines") == 0))
    cut = F.col("n_kept") < F.col("n_lines")
    sized = thinned.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return sized.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    old, *_ = free_names(docs, "_old")
    cleaned = decontaminate.remove_spans(docs.withColumn(old, F.length("text")), table(spark, sf_dir, "benchmark"), drop=True)
    cut = F.length("text") < F.col(old)
    return cleaned.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), tokens=True)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", thin_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: Fitted scores, hashes of shingles and merges aren't expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
