"""The corpus pipeline: documents in, packed training sequences out.

Every stage calls one operator of factloom.llm on all that the stage before it kept; in between the table is written to
the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontamination, language_filter, ngram_join, packing, suffix_array_dedup
from factloom.llm.common import cut
from factloom.llm.queries import table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: no letter, or letters too odd for the language predicted."""
    return language_filter.accepted(docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with Jaccard similarity of 0.75 or more the one with the smallest doc_id stays."""
    return ngram_join.representatives(docs, k=5, percent=75)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out; documents of which nothing is left go."""
    return suffix_array_dedup.deduplicated(docs, match=50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents hit in half of their words or more go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), seq_len=4096)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", tell_language),
    ("ngram_jaccard_join", join_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: Models, components and tokens are beyond SQL; tests/llm compares operators with brute force, not the rows of the whole pipeline.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
