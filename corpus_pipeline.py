"""Documents to token ids in five stages.

Each stage takes what the one before kept, as a table, and applies its decisions:
1. language: documents whose language can't be told (no letters, null) go; a null lang is filled in;
2. near_duplicates: one document of each class of near duplicates stays, that with the least doc_id;
3. decontamination: documents that contain a benchmark item go;
4. secrets: spans with secrets are replaced in the text, and n_chars follows;
5. byte_bpe: texts become token ids (binary, little-endian unsigned 32-bit), with digests of ids and of the decoded bytes.
All but the last return the columns of documents.

Defined results: empty tables pass through as empty tables; a null text goes in stage 1, so later stages see texts alone; a null doc_id is a
document like others, and of a class all of whose ids are null one row stays; of repeated rows, and of rows that tie for the least doc_id, one stays (that of the
least text digest); columns beyond those of documents are kept whatever their names, until the last stage; texts of any length are
handled whole. Where no language can be learned (no labelled rows) stage 1 keeps each text that has a letter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecengine.llm import byte_bpe, common, decontamination, language, near_duplicates, secrets


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.with_language(docs, language.learn(docs.where(~language.held_out(F.col("doc_id")))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_items(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_items),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]
#: SQL can't express the stages' statistics, alignments and merges; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
