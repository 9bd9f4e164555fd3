"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Columns of documents may have any names besides doc_id, text, lang, source and n_chars; they pass through all
stages but the last. Null ids are never copies of others and count as documents of their own; rows that repeat an
id and a text are one document after the near-duplicate stage. Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, mixture, near_dup, quality
from tessera.llm.common import removed, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The vocabulary file of the last stage; a parameter, as the file isn't part of the library.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Documents whose language is less sure than this are rejected, and those with a smaller share of words that were
#: learned: the score of a text of many words is near 1 whatever language it is in.
LEAST_SCORE, LEAST_KNOWN = 0.3, 0.5


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns by position, so that no name can clash with a result's, and where each went."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def with_digest(docs: DataFrame) -> DataFrame:
    """Of each row the id, the text and the text's digest. Verdicts are on texts, so texts stay where they are, and only
    the digests of the rejected ones are sent to them."""
    return docs.select("doc_id", "text", digest_of("text").alias("digest"))


def digest_of(text: str) -> Column:
    return F.unhex(F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose texts aren't among the rejected ones."""
    rows, at = numbered(docs)
    # As a table, whose size Spark knows: it is broadcast if it is small, else Spark can split what many rows share.
    known = stored(rejected.select("digest").distinct(), "rejected")
    own = rows.withColumn("digest", digest_of(at["text"]))
    return own.join(known, "digest", "left_anti").select(*at.values()).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, those whose language stays unsure, and those in languages that no label names."""
    model = langid.fitted(docs)
    found = langid.predicted(with_digest(docs).select("digest", "text"), model, keep=("digest",))
    return without(docs, found.where((F.col("lang_pred") == langid.UNDETERMINED) | (F.col("score") < LEAST_SCORE) | (F.col("known") < LEAST_KNOWN)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rule or that the isolation forest finds anomalous."""
    rows = with_digest(docs).select("doc_id", "digest", "text")
    return without(docs, quality.measured(rows, table(spark, sf_dir, "labels"), ("doc_id", "digest")).where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies, once."""
    rows, at = numbered(docs)
    doc, text = at["doc_id"], at["text"]
    # An id may stand on several texts, and each of these has a verdict of its own.
    marked = rows.withColumn("same", F.xxhash64(text))
    kept = near_dup.linked(marked, id_col=doc, text_col=text, keep=("same",)).where("kept and doc_id is not null").select(F.col("doc_id").alias(doc), "same").distinct()
    once = marked.join(kept, [doc, "same"], "left_semi").dropDuplicates([doc, "same"]).drop("same")
    return once.unionByName(rows.where(F.col(doc).isNull())).select(*at.values()).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, in each file in the order of its slots: each document as often as the mix takes it whole, to the nearest
    number of times (0 drops it), each copy where its words begin."""
    rows, at = numbered(docs)
    doc, text = at["doc_id"], at["text"]
    plan = mixture.copies(rows, id_col=doc, text_col=text, source_col=at["source"])
    # Rows with the same id and text are numbered on both sides; equal ones among them can take each other's place.
    plan = plan.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "text_hash", "source").orderBy("slot")) - 1)
    own = rows.withColumn("hash", F.xxhash64(text)).withColumn("nth", F.row_number().over(Window.partitionBy(doc, "hash", at["source"]).orderBy(F.lit(0))))
    twins = own.groupBy(F.col(doc).alias("_doc"), F.col("hash").alias("_hash"), F.col(at["source"]).alias("_source")).agg(F.count(F.lit(1)).alias("twins"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    plan = plan.join(twins, same("doc_id", "_doc") & same("text_hash", "_hash") & same("source", "_source"))
    place = plan.select("doc_id", "text_hash", F.col("source").alias("_of"), (F.col("i") % F.col("twins") + 1).alias("turn"), "slot")
    met = own.join(place, same(doc, "doc_id") & same("hash", "text_hash") & same(at["source"], "_of") & (F.col("nth") == F.col("turn")))
    # Each file has its share of the slots, in their order; a global order would send all texts once more.
    return met.sortWithinPartitions("slot").select(*at.values()).toDF(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encoded(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]
#: The stages learn models, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = before = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, before, sf_dir), name)
        if i:
            removed(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
