"""A cleaning pipeline over ``documents``: each stage is written as Parquet and read as the next one's input.

Defined results: every stage but the last gives rows of its input with all their columns, whatever their names. A null
text counts as empty. A row with a null doc_id is scored, deduplicated by its text and checked for benchmark passages
like any other, but never leaves for being a near copy. Of exact copies the longest original stays, then the smallest
doc_id (null last); of rows that repeat doc_id and text one stays. Of near copies (five-word shingles, Jaccard
similarity of 0.8 or more, directly or through others) the smallest doc_id stays. A document with any benchmark window
goes. Without labels of both kinds no document is told good from bad: all get the share of good labels (0.5 without
any) and stay from 0.5 on. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelstream.llm import bpe, decontamination, exact_dedup, near_copies, quality
from voxelstream.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", keep_distinct),
    ("simhash_near_dedup", keep_dissimilar),
    ("benchmark_decontamination", keep_uncontaminated),
    ("byte_level_bpe", tokenize),
]

#: Scores, fingerprints and BPE have no SQL form; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
