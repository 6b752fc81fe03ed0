"""A training-corpus pipeline of five operators, each stage working on all that the one before kept.

``run`` writes every stage's result as Parquet in the shared folder and reads it again,
so a lost executor never sends the work back beyond one stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tamiz.llm import exact_dedup, langid, mixing, near_dups, packing
from tamiz.llm.common import materialise, own_tables, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, in no known language or without a likely one go."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word Jaccard similarities of 0.8 or more connect, the one with the largest doc_id stays."""
    return near_dups.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("mixing", mix),
    ("packing", pack),
]

#: Language models, the entropy dual and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with own_tables():
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            release(spark, keep=1)  # the stage's own tables, and the stage before
        result = STAGES[-1][1](spark, docs, sf_dir)
        release(spark, read_by=result)
    return result
