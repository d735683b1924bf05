"""From raw documents to encoded training data: the stages, in order, each over all that the one before kept.

Every stage but the last returns the columns of documents (doc_id, text, lang, source, n_chars), with n_chars brought up to
date where texts change; the last adds token counts and digests. A document that the mix takes twice comes out twice.
Nulls, empty texts, ties and repeated rows have the results that the operators state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom import ship
from hyperloom.llm import bpe, mixing, pii, quality, simhash
from hyperloom.llm.common import for_this_run, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and frequent lines from those that stay."""
    return counted(quality.clean(docs.select(COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    ship(spark)
    return simhash.first_of_each(docs.select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return counted(pii.redact(docs.select(COLUMNS)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    return mixing.taken_rows(docs.select(COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    import public_tokenizers

    ship(spark)
    coded = bpe.round_trip(docs.select(COLUMNS), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("byte-level bpe", encode),
]

#: Trained trees and hashes of fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            for_this_run(spark, path)
            docs = spark.read.parquet(path)
    return docs
