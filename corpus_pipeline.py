"""A training-text pipeline over the documents table.

Five stages, each over all that its predecessor kept: quality rules, exact
deduplication, near-deduplication, mixing to target weights, BPE encoding.
Each stage's result is written as Parquet below the shared checkpoint folder
and read again as the next one's input.

Defined results: the stages' operators say how they treat nulls, empty and
very long texts, ties and repeated rows; an empty table passes through all
stages as an empty table; extra columns of ``documents`` are dropped at the
start, so clashing names cannot meet a stage's own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from residua.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from residua.llm.frames import table, written
from residua.llm.queries import word_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No document is repeated: one epoch at most, four fifths of all tokens.
MIX = mixing.MixPlan(
    weights={"domain": {"web": 50, "books": 30, "forum": 20}, "lang": {"en": 40, "de": 20, "fr": 20, "es": 20}},
    budget_percent=80, max_epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's certified cutoffs."""
    return quality_rules.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words at similarity 0.8 link."""
    return near_dedup.keep_one_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the token budgets of their domain, language and source."""
    return mixing.mix(docs.select(*COLUMNS), MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document left."""
    return bpe.encode(docs, word_bpe(), digests=True).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: Cutoffs certified by binomial bounds, MinHash groups and BPE are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
