"""The corpus pipeline: quality rules, toxicity, exact dedup, near dedup, packing.

Each stage reads all that the one before it kept and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, jaccard_join, packing, quality_rules, toxicity
from palimpsest.llm.queries import table, tokenizer_path
from palimpsest.llm.shared import checkpoint, crc_mod

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from the same folds as the query."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic AS label")
    return toxicity.keep_clean(docs, labels, crc_mod("doc_id", 3) != 1)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 of five-word shingles the smallest doc_id stays; documents without words stay."""
    return jaccard_join.keep_first(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stage_quality),
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact),
    ("ngram_jaccard_join", stage_near),
    ("best_fit_packing", stage_pack),
]

#: Toxicity and tokenisation are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a checkpoint between stages cuts the lineage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
