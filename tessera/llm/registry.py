"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, gnat, hilbert, html_cut, kneser_ney, langid, mixture, near_dup, oracles, pair_index, quality, warc, whitening, winnow
from tessera.llm.common import crc_of_id, table

#: Words of a shingle that the near-duplicate query asks for.
OP1_SHINGLE = 4
#: The vocabulary file; a parameter of the operator.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
WORD_FILE = "word_bpe_49k.json"


def op1_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.linked(table(spark, sf_dir, "documents"), shingle=OP1_SHINGLE)


def op2_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_word_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fitted(docs.where(crc_of_id(F.col("doc_id"), 3) != 1))
    found = langid.predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc_of_id(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.sharded(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprinted(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, with_ids=False)


def op8_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_cut.extracted(pages, html_cut.fitted(pages))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_of_id(F.col("doc_id"), 5) == 1, F.lit(False))
    train = F.coalesce(crc_of_id(F.col("doc_id"), 5) != 1, F.lit(False))
    return kneser_ney.scored(docs.withColumn("held_out", held_out), train, keep=("doc_id", "held_out"))


def op10_golden_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed(table(spark, sf_dir, "documents"))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_gnat_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return gnat.mined(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, label=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op13_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_index.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), with_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_odd_sketch, op2_isolation_forest, op3_word_first, op4_zstd_warc, op5_hilbert, op6_winnowing, op7_byte_bpe, op8_min_cut, op9_kneser_ney, op10_golden_ratio, op11_feast_whitening, op12_gnat_negatives, op13_pair_index)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; the others are compared with brute force in the tests."""
    return {op1_odd_sketch.__name__: oracles.NEAR_DUPLICATES, op4_zstd_warc.__name__: oracles.ARCHIVES, op12_gnat_negatives.__name__: oracles.NEGATIVES}
