"""The training-data pipeline: rules, near duplicates, repeated passages,
benchmark leaks, token ids.

Every stage takes the documents its predecessor kept, whole, and its decisions
take effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwalk.llm import bpe, decontaminate, quality, simhash, substrings
from cartwalk.session import scratch_path
from cartwalk.sources.tables import read_table

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (SimHash of three-word shingles, two
    bits) the document of the smallest id stays."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated 35-word windows go; the documents stay, with what
    is left of them."""
    cut = substrings.remove_repeats(docs, min_words=35)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, as they are or re-parameterised, go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"), match_null_ids=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, and a digest of their decoding."""
    return bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER), drop=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", token_ids),
]

# Neither the iterated robust estimates nor the tokenizer's merges can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each keeps is written under the
    shared checkpoint folder and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.option("compression", "none").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
