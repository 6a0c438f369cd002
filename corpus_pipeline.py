"""The corpus pipeline: documents in, a clean mix out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. A stage drops or
edits rows and returns the columns of documents; the last returns the mix, in the order of its sorting, with
`copies` (how often the mix takes the row) and `finish` (its virtual finish time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelake.llm import decontaminate, mixing, pii, quality_rules, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.keep_one(docs)


def benchmark_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, at target weights."""
    return mixing.mixed(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", benchmark_clean), ("pii", redact), ("mixing", mix)]

#: No SQL: the classifiers and the retrieval stage have none. tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared checkpoint folder before the next."""
    simhash.ensure_checkpoints(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
