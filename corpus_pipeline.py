"""A training-corpus pipeline of five stages over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm import decontam, near_dup, packing, quality, toxicity
from wattloom.llm.queries import table, word_bpe


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the divergence rules reject go."""
    return quality.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; the model learns from labelled documents
    that are still there and not held out."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, packed by best-two-fit."""
    return packing.best_fit_packing(docs, word_bpe())


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: Token ids and weighted sampling have no SQL form; tests compare with brute force.
ORACLE_SQL = None
