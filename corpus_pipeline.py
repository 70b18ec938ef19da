"""A training corpus from `documents`: classify, remove near duplicates, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept; its result is
written as Parquet and read again. All but the last return the columns of `documents`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freqforge.llm import jaccard, mixing, packing, quality, secrets
from freqforge.llm.common import read, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject. Null and empty texts have a score like any other, equal
    texts the same one; without labels of both kinds the share of good ones decides; an empty table stays empty."""
    model = quality.fit(docs, quality.training_labels(read(spark, sf_dir, "labels")))
    return quality.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least doc_id, null ids last. Equal rows, rows that share
    a doc_id and rows without one are near duplicates like any other; null texts and texts without words all stay."""
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by the name of their kind and n_chars set to match; null and empty texts and ones
    without a secret stay as they are, n_chars included; equal rows stay equal."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, nought to two times; a null source is a source, texts without words have
    size 0; of equal rows all are taken or none, but for whole repetitions; an empty table stays empty."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document, with its place. Null and empty texts are one end token; repeated
    rows are packed one by one; an empty table gives no pieces."""
    return packing.pack_documents(docs, packing.tokenizer_file())


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Dictionaries, redaction and tokens have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
