"""Corpus preparation: stages that each take the documents which the one before has kept, and return the kept ones.

Each stage is written as Parquet to the shared folder and read from there, so a lost executor costs one stage's work at most. All
stages but the last return the columns of documents; the last returns the encoded documents. Rows of documents that a stage has no reason to drop stay,
null texts and repeated rows included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import credentials, near, pieces, preference, templates
from trackloom.llm.shared import new_folder, remove, table

#: Bytes of the stretches that a worker of the last stage keeps: less than by default, beside what the stages before have left in memory.
REMEMBER = 16_000_000
#: Rows of an Arrow batch: stages run one after the other in the same workers, which keep what large batches took.
BATCH = 2_000


def _batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; all of them where labels hold no two classes. Null texts are judged as empty ones."""
    _batches(spark)
    return preference.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    Texts without words are alike; rows without doc_id stay, and rows of one doc_id stay or go together.
    """
    _batches(spark)
    return near.one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, re-parameterised ones included; items of one to four words drop nothing."""
    _batches(spark)
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind's name and n_chars made to agree; null texts stay null."""
    _batches(spark)
    return credentials.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (with the end id) and decoded (what the ids give) of each document; a null text has the end id only."""
    _batches(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), remember=REMEMBER)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]
#: No stage but secrets can be said in SQL: learnt weights, XXH64 fingerprints and merges. The stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    records = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for _, stage in STAGES:
            folder = new_folder(spark, "stage")
            stage(spark, docs, sf_dir).write.parquet(folder)
            docs = spark.read.parquet(folder)
            if before:
                remove(spark, before)  # the next stage's documents are written
            before = folder
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)  # other queries of the session keep theirs
    return docs
