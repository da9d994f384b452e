"""The corpus pipeline: documents in, tokenised training rows out.

Each stage is (spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality_rules
from sluice.llm.common import table, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the corpus policy rejects go; short ones, which are clean as a rule, stay."""
    return quality_rules.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.drop_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with similarity 0.8 or more, the smallest id stays."""
    return ngram_join.drop_near_copies(spark, docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its leaf's epochs give it."""
    return mixing.mixed_documents(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids, and whether the ids decode to the text."""
    coded = byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip", "token_ids")


STAGES = [
    ("quality rules", rules),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]

#: The joins' components and the coding can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
