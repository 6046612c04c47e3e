"""Batch jobs over genotype-phenotype tables, written as Spark DataFrame operations."""
