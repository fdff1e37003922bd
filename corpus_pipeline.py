"""A training corpus in five stages over the documents table; each stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import decontaminate, line_dedup, minhash, packing, toxicity
from quillsift.llm.common import prepare, written
from quillsift.llm.tokens import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.5 or more; learns from the labels table and the documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fit(docs, labels))
    return scored.where(F.col("toxicity") < 0.5).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share; n_chars follows the text."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five words, similarity 0.8)."""
    return minhash.drop_near_duplicates(docs).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into sequences of 2048 tokens."""
    return packing.best_fit_packing(docs, vocabulary(), end_id=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("winnowing_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: Stages 1, 3 and 5 can't be put in SQL; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
