"""A training corpus in five stages, each on all documents that the one before kept.

quality classifier -> exact dedup -> n-gram Jaccard join -> PII -> best-fit packing.  Each
stage takes (spark, docs, sf_dir); all but the last return the columns of documents.  Further
columns of docs are left out, and an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import exact_dedup, ngram_join, packing, pii, quality
from panelmill.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant does not reject; a null or empty text is scored as a text
    without characters, a row without doc_id as any other, repeated rows stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs.select(*COLUMNS), labels)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest doc_id; null counts as the empty text, a null
    doc_id is smaller than any other, and of repeated rows one stays."""
    return exact_dedup.distinct_documents(docs.select(*COLUMNS))


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id; texts without words are
    alone, rows without doc_id stay, repeated rows stay or go together."""
    return ngram_join.representatives(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets masked, and their new lengths; null texts stay null."""
    masked = pii.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; a null or empty text is
    the end token alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_distinct),
    ("n-gram Jaccard join", keep_representatives),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the joins of sets and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
