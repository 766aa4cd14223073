"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

language ID        documents without a language (null texts, no letters, a low score of the best language) go; where no row has a
                   language to learn from, all texts with a letter stay
SimHash            one document of each class of near-duplicates stays, the smallest doc_id
suffix array       repeated strings of 50 bytes are cut out of all documents but the smallest
decontamination    benchmark passages are cut out; documents that consist of them go
SentencePiece      the texts become tokens

Null, empty and very long texts, null and repeated doc_ids, ties and repeated rows fare as the operators' docstrings say: null and
empty texts go in the first stage; rows without a doc_id are kept by SimHash and count as one last document in the suffix array;
copies of one doc_id are one document there. An empty table gives no rows, and columns beside doc_id and text are carried along
whatever their names. A stage's table is removed as soon as the next one has been written; the last goes with the application.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, langid, pieces, simhash, suffixes
from graphloom.llm.components import checkpoint_dir, remove, remove_at_end
from graphloom.session import ship


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.keep_languages(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return with_sizes(suffixes.remove_repeats(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_sizes(decontaminate.remove_leaks(docs, benchmark))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode_documents(docs)


def with_sizes(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", drop_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", cut_benchmark),
    ("sentencepiece_encoding", tokenize),
]

#: Fingerprints, learned languages and token merges are not SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are a table in the shared folder, so a lost executor costs one stage."""
    folder = f"{checkpoint_dir(ship(spark))}/pipeline-{uuid.uuid4().hex}"
    remove_at_end(spark, folder)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            remove(spark, before)
        before = out
    return docs
