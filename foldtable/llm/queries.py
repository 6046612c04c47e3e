"""Queries of the training-data operators, each over the whole of its table."""

from __future__ import annotations

from . import bpe, chat, decontaminate, embedding_dedup, filter_audit, license_scan, line_dedup, quality, sharding, simhash, spelling, token_store, warc
from .common import table
from .sql import ORACLE_SQL  # noqa: F401

QUERIES = {
    "op1_sharding": lambda spark, d: sharding.shard_documents(spark, table(spark, d, "documents")),
    "op2_bpe": lambda spark, d: bpe.round_trip(spark, table(spark, d, "documents")),
    "op3_chat_formatting": lambda spark, d: chat.format_conversations(spark, table(spark, d, "conversations")),
    "op4_quality_classifier": lambda spark, d: quality.score_documents(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_simhash_near_dedup": lambda spark, d: simhash.group_documents(spark, table(spark, d, "documents")),
    "op6_token_output": lambda spark, d: token_store.store_documents(spark, table(spark, d, "documents")),
    "op7_line_dedup": lambda spark, d: line_dedup.thin_documents(spark, table(spark, d, "documents")),
    "op8_decontamination": lambda spark, d: decontaminate.judge_documents(spark, table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_warc": lambda spark, d: warc.archive_pages(spark, table(spark, d, "pages")),
    "op10_embedding_near_dedup": lambda spark, d: embedding_dedup.group_vectors(spark, table(spark, d, "embeddings")),
    "op11_filter_audit": lambda spark, d: filter_audit.audit_documents(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op12_spelling": lambda spark, d: spelling.group_spellings(spark, table(spark, d, "documents")),
    "op13_license_scan": lambda spark, d: license_scan.scan_licenses(spark, table(spark, d, "documents")),
}
