"""From raw documents to packed training sequences: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all
rows that its predecessor kept. run() writes every stage's result as Parquet to the shared folder
and reads it again for the next.

All stages take a null text for an empty one, rows with a null or repeated doc_id, texts of any
length, other columns (they pass through all stages but the last) and an empty table, which
gives an empty result. A column by a name that an operator needs for itself (such as _tie; the
operators list them) is refused with ValueError before anything is read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import line_dedup, ngram_join, packing, quality_rules, secret_scan
from almanac.llm.common import clean, documents, small_batches, stored, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them. Equal rows are judged alike; null languages and sources are a group of their own."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated windows go; every document stays, if need be with an empty text. Rows alike in doc_id and text are cut alike; null texts stay null; n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles (Jaccard of 0.8 or more) one document stays, the least doc_id (null last, then the least hash of the text); texts without words all stay."""
    small_batches(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, character by character; every document stays, and null texts stay null."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into sequences of at most 2048 tokens and 64 documents: a row for each piece. Null and empty texts are a piece of the end alone; equal rows are packed each."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, public_tokenizers.path("byte_bpe_50k.tiktoken"), documents_=64)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: Shingle links and packing have no SQL form here; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables that stages wrote on the way are deleted once the last result is there."""
    docs, mark = documents(spark, sf_dir), written()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    clean(spark, since=mark, but_last=True)
    return docs
