"""Corpus preparation: quality, rules, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as
Parquet in the shared folder and hands what it reads back to the next stage. All stages but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areastats.llm import jaccard, mixing, packing, quality, rules
from areastats.llm.common import Scratch, fresh


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = fresh(docs, "_score")
    scored = quality.classify(docs, quality.fit(docs, labels), score=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def keep_regular(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.regular(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domain, language and source ask for."""
    mixed = mixing.mix_sources(docs, mixing.LEVELS).where("_mix_copies > 0")
    copy = fresh(mixed, "_copy")
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("quality_rules", keep_regular),
    ("jaccard_join", keep_one_of_each),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: The classifier and the tokenizer are out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
