"""A corpus made ready for training: rules, near copies, repeated strings, benchmark leaks, token ids.

Null and empty texts fail the rules; rows without an id are judged like others, and a copy with an id is kept before one without.  Of
repeated rows one is kept.  Empty tables give empty ones; a stage's result has the columns of its documents, but for the last, which
gives ids' digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import decontamination, ngram_join, pieces, rules, suffix_dedup
from siftwell.llm.common import few_files, materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return few_files(rules.kept_documents(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return few_files(ngram_join.one_of_each(docs), docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out."""
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    return few_files(decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark")), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the ids and of the text decoded from them."""
    return few_files(pieces.encode_digests(docs), docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Tokenizers and suffix sorting have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "".join(c if c.isalnum() else "-" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)
