"""Corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

Rows with null texts, repeated rows and extra columns pass through the stages by the rules that each
operator states; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ordersight.llm import decontamination, jaccard, mixing, rules, toxicity
from ordersight.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.3  # documents scored at or above it are rejected
# near duplicates: sets of five-word shingles, four fifths in common
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the classifier learns from those that ``labels`` marks."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    return toxicity.keep_clean(docs, model, threshold=TOXIC)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return jaccard.keep_first(docs, width=SHINGLE, percent=PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("mix_sources", mix_sources),
]

# SQL cannot express trained scores and similarity components; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
