"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers

from . import byte_bpe, exact_dedup, language_id, mixing, ngram_join, quality_classifier, quality_rules, sharding, token_counts, url_filter
from .common import table
from .oracle import ORACLE  # noqa: F401

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def op1_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_mixing(spark, sf_dir):
    return mixing.mix_sources(spark, table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_sharding(spark, sf_dir):
    return sharding.shard(spark, table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark, sf_dir):
    return language_id.predict(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op8_quality_rules(spark, sf_dir):
    led = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_classes(spark, table(spark, sf_dir, "documents"), k=4, percent=85)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_mixing, op3_token_counts, op4_sharding, op5_ngram_jaccard_join, op6_quality_classifier,
    op7_language_id, op8_quality_rules, op9_byte_bpe, op10_exact_dedup, pipeline,
)}
