"""A training-corpus pipeline: five stages over the documents table, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from diffspark.llm.bpe import bpe_encode_decode
from diffspark.llm.common import shared_dir, stored, table
from diffspark.llm.jaccard import one_of_each
from diffspark.llm.kneser_ney import keep_good
from diffspark.llm.mix import mix
from diffspark.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents outside their language's perplexity limits."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked texts."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks found secrets."""
    return redact(docs, shared_dir(spark, "ledger"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes, repeats and shuffles documents by the sources' targets."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document taken."""
    return bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"], more=("ids",), memory=TOKEN_MEMORY)


#: Workers keep this much from stage to stage, beside what later ones need; a quarter of the encoder's own bound.
TOKEN_MEMORY = 20_000_000

STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]

#: SQL can't express the language model, the hash-based mix or the encoder; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
