"""Rank fusion and identity of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
#: Weights of the lists: dense, keyword, attachment.
WEIGHTS = (1.0, 0.9, 0.85)


def weight_of(index: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    """A list without a weight counts 1."""
    return F.coalesce(F.get(F.array(*[F.lit(w) for w in weights]), index), F.lit(1.0))


def rrf(lists: DataFrame, k: int = K, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Weighted reciprocal-rank fusion (R24) of (query_id, list_idx, rank, key, relevance).

    A key that repeats in a list adds again. Its payload is the row of greatest relevance, the first of equals;
    relevance becomes the greater of that and the fused score. Ties go to the key seen first.
    """
    seen = F.struct("list_idx", "rank")
    part = weight_of(F.col("list_idx"), weights) / (k + F.col("rank"))
    found = lists.groupBy("query_id", "key").agg(F.sum(part).alias("sum"), F.min(seen).alias("first"), F.max("relevance").alias("most"), F.count_distinct("list_idx").alias("methods"))
    found = found.withColumn("rrf", F.round("sum", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first", "key")
    return found.select("query_id", F.row_number().over(order).cast("long").alias("rank"), "key", "rrf", F.greatest("most", "rrf").alias("relevance"), F.when(F.col("methods") > 1, "hybrid_rrf").otherwise("single").alias("source_reason"))


def rrf_keys(lists: DataFrame, k: int = K) -> DataFrame:
    """Fusion over keys alone (R25): keys off the grammar are dropped first, and ranks close up."""
    valid = lists.where(F.col("key").rlike(r"^[a-z_]+:(chunk|source|entry):[0-9]+$"))
    closed = F.row_number().over(Window.partitionBy("query_id", "list_idx").orderBy("rank", "key"))
    return rrf(valid.withColumn("rank", closed.cast("long")).withColumn("relevance", F.lit(0.0)), k, ()).select("query_id", "rank", "key", "rrf")


def channels_merged(hits: DataFrame) -> DataFrame:
    """Channels one after another, not by score; of each origin the first position stays."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("channel_order", "rank", "key"))
    first = F.row_number().over(Window.partitionBy("query_id", "origin").orderBy("place"))
    kept = hits.withColumn("place", place).withColumn("nth", first).where("nth = 1")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).cast("long")).select("query_id", "rank", "key", "origin", "score")


def mirrors_merged(hits: DataFrame) -> DataFrame:
    """Of the rows of an origin, an attachment chunk takes the first row's place; the others name what they repeat."""
    whole = Window.partitionBy("query_id", "origin")
    best = F.first("key").over(whole.orderBy(F.when(F.col("source_type") == "attachment_chunk", 0).otherwise(1), "rank", "key"))
    first = F.min("rank").over(whole)
    marked = hits.withColumn("kept_key", best).withColumn("position", first)
    return marked.select("query_id", "key", "origin", "position", (F.col("key") == F.col("kept_key")).alias("kept"), F.when(F.col("key") != F.col("kept_key"), F.col("kept_key")).alias("duplicate_of"))


def with_visual(text_hits: DataFrame, visual_hits: DataFrame, most: int = 3, least: float = 0.25) -> DataFrame:
    """Appends a few visual hits of unseen attachments behind the text hits, which keep their places."""
    fresh = visual_hits.where(F.col("score") >= least).join(text_hits.select("query_id", "attachment_id"), ["query_id", "attachment_id"], "left_anti")
    chosen = fresh.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "attachment_id"))).where(F.col("n") <= most)
    ends = text_hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    added = chosen.join(ends, "query_id", "left").select("query_id", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long").alias("rank"), "attachment_id", "score", F.lit("visual").alias("channel"))
    return text_hits.select("query_id", "rank", "attachment_id", "score", F.lit("text").alias("channel")).unionByName(added)
