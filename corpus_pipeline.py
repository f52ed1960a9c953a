"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what a
stage returns as Parquet in the shared folder and reads it back as the next one's
``docs``. The first four stages return the columns of ``documents``; the last returns
the packed pieces.

The n_chars column stays as it came: it tells about the source document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import exact_dedup, language_id, near_dedup, packing, suffix_dedup
from larkspan.llm.staging import staged

#: Repeated strings of more than fifty words go.
PASSAGE_WORDS = 51
#: The bytes of the shortest of them: words of one letter, and a space between any two.
PASSAGE_BYTES = 2 * PASSAGE_WORDS - 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter or a clear language go."""
    return language_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the document with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8) the document with the smallest doc_id."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of over fifty words that occur elsewhere in what is left of the corpus."""
    return suffix_dedup.drop_repeated(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("op2_language_id", language),
    ("op4_exact_dedup", exact),
    ("op5_minhash_near_dedup", near),
    ("op1_suffix_dedup", passages),
    ("op6_packing", pack),
]

#: Learned language scores, similarity joins and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
