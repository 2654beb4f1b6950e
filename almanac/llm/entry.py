"""Queries and SQL of this subpackage, for the driver's entry."""

from __future__ import annotations

from . import byte_bpe, fingerprints, line_dedup, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, secret_scan, url_filter


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (
    lm_scoring.op1_lm_scoring,
    byte_bpe.op2_byte_bpe,
    ngram_join.op3_ngram_join,
    fingerprints.op4_fingerprints,
    line_dedup.op5_line_dedup,
    secret_scan.op6_secret_scan,
    packing.op7_packing,
    quality_rules.op8_quality_rules,
    quality_classifier.op9_quality_classifier,
    url_filter.op10_url_filter,
    pipeline,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": ngram_join.OP3_SQL, "op8_quality_rules": quality_rules.OP8_SQL, "op5_line_dedup": line_dedup.OP5_SQL, "op6_secret_scan": secret_scan.OP6_SQL, "op10_url_filter": url_filter.OP10_SQL}
