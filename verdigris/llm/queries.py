"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, conversations, decontaminate, negatives, ngram_join, passage_dedup, pii, quality, sharding, simhash, token_files, toxicity, url_filter


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_pii": pii.op2_pii,
    "op3_quality": quality.op3_quality,
    "op4_sharding": sharding.op4_sharding,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_passage_dedup": passage_dedup.op6_passage_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_files": token_files.op8_token_files,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_simhash": simhash.op11_simhash,
    "op12_conversations": conversations.op12_conversations,
    "op13_negatives": negatives.op13_negatives,
    "pipeline": pipeline,
    # the parts of op2 and op3 that SQL can express
    "base_pii_spans": pii.base_pii_spans,
    "base_quality_statistics": quality.base_quality_statistics,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op6_passage_dedup": passage_dedup.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op12_conversations": conversations.ORACLE,
    "op13_negatives": negatives.ORACLE,
    "base_pii_spans": pii.BASE_ORACLE,
    "base_quality_statistics": quality.BASE_ORACLE,
}
