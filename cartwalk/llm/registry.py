"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cartwalk.llm import (bpe, decontaminate, html, langid, licenses, lm, negatives, quality, runs, shards, simhash, substrings,
                          tokenfiles)
from cartwalk.sources.tables import read_table

TOKENIZER = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every whole text under the add-one unigram base
    and the log-bilinear model, both learnt from six sevenths of the table."""
    return lm.scores_digest(_documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a uniformly random order in 16 shards whose row
    counts differ by at most one."""
    return shards.shards_digest(_documents(spark, sf_dir))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and the text decoded from them."""
    return bpe.codec_digest(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and visible text of every page, laid out."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "html")
    return html.extract_text(pages).select("page_id", "title", "text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and texts in every document."""
    return licenses.licenses_digest(_documents(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word SimHash fingerprints are linked at 2
    or fewer differing bits."""
    return simhash.near_duplicates_digest(_documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text written to rANS-coded files and every
    document read back from them."""
    return tokenfiles.files_digest(_documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, as they are or with other
    numbers and names."""
    return decontaminate.hits(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdicts of the base rules and of the
    robust outlier test by language and source."""
    return quality.quality_digest(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under repeated 35-word windows removed from every document."""
    return substrings.repeats_digest(_documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every whole text, a tenth of the texts made
    periodic first as the query's contract says."""
    return runs.runs_digest(runs.planted(_documents(spark, sf_dir)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every fiftieth embedding and its five best rows of
    the same label."""
    return negatives.hard_negatives(negatives.relabelled(read_table(spark, sf_dir, "embeddings")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learnt from three quarters of the
    labelled documents."""
    return langid.languages_digest(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_lm_scoring, op2_sharding, op3_bpe_codec, op4_html_extraction, op5_license_scan, op6_simhash_near_dedup, op7_token_files, op8_benchmark_decontamination, op9_quality_rules, op10_substring_dedup,
        op11_periodic_runs, op12_hard_negatives, op13_language_id,
    )
}

ORACLE_SQL: dict[str, str] = {"op12_hard_negatives": negatives.NEGATIVES_SQL}
