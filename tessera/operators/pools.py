"""Pools of candidates from many channels: hybrid search and lookup.

A pool is rows, not lists: every hit has its channel and its rank there, a query's channels stand one after another by a
number, and what follows are windows by query. All queries go through at once. Hits are a bounded number for each query
and are used several times, so they are written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import answers, fusion
from tessera.sources.storage import stored

#: Channels that find by vectors; each that found something has a seat in a pool that is cut.
DENSE = ("entry_dense", "knowledge_dense", "attachment_dense")


def of_query(*order: str | Column) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")


def joined(channels: DataFrame) -> DataFrame:
    """Channels one after another, of each origin one row: an attachment's chunk if there is one, at the place of the
    origin's first row.

    channels: (query_id, part, rank, key, origin, source_type, ...); ``place`` is where the row stands.
    """
    placed = channels.withColumn("place", of_query("part", "rank", "key"))
    # A key that stands in several channels is the row of the first of them.
    first = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("place"))
    once = placed.withColumn("nth", first).where("nth = 1").drop("nth")
    kept = fusion.mirrors_merged(once.select("query_id", F.col("place").alias("rank"), "key", "origin", "source_type")).where("kept")
    return once.drop("place").join(kept.select("query_id", "key", F.col("position").alias("place")), ["query_id", "key"])


def continued(lists: DataFrame) -> DataFrame:
    """Lists one after another as one list whose ranks go on (R30); a key may repeat in it."""
    return lists.withColumn("rank", of_query("part", "rank", "key"))


def hybrid(dense: DataFrame, keyword: DataFrame, attachments: DataFrame, visual: DataFrame | None = None, k: int = 15) -> DataFrame:
    """The context of an answer (R30): vector hits, word hits and attachments fused by rank (R24), the best k, mirrors
    merged (R27), and a visual tail of attachments that are not there yet (R29).

    dense, attachments: hits by (part, rank) that are joined by origin first; keyword: lists that follow one another.
    All have (query_id, part, rank, key, origin, source_type, score). visual: (query_id, key, origin, score).
    """
    own, keyword, files = (stored(rows, "hybrid-hits") for rows in (dense, keyword, attachments))
    own, files = joined(own), joined(files)
    lists = [own.withColumn("rank", of_query("place")), continued(keyword), files.withColumn("rank", of_query("place"))]
    columns = ["query_id", "list_idx", "rank", "key", "origin", "source_type", "score"]
    hits = [rows.withColumn("list_idx", F.lit(i)).select(*columns) for i, rows in enumerate(lists)]
    every = stored(hits[0].unionByName(hits[1]).unionByName(hits[2]), "hybrid-lists")
    fused = fusion.rrf(every.withColumn("relevance", F.col("score"))).where(F.col("rank") <= k)
    facts = every.groupBy("query_id", "key").agg(F.min_by("origin", F.struct("list_idx", "rank")).alias("origin"), F.min_by("source_type", F.struct("list_idx", "rank")).alias("source_type"))
    kept = fusion.mirrors_merged(fused.join(facts, ["query_id", "key"])).where("kept")
    rows = kept.join(fused.select("query_id", "key", "rrf", "source_reason"), ["query_id", "key"])
    rows = rows.withColumn("position", of_query("position")).select("query_id", "position", "key", "origin", "rrf", "source_reason")
    if visual is None:
        return rows
    rows, visual = stored(rows, "hybrid-rows"), stored(visual, "hybrid-visual")
    tail = fusion.with_visual(rows.select("query_id", F.col("position").alias("rank"), F.col("origin").alias("attachment_id"), F.lit(0.0).alias("score")), visual.groupBy("query_id", F.col("origin").alias("attachment_id")).agg(F.max("score").alias("score")))
    named = visual.groupBy("query_id", "origin").agg(F.max_by("key", F.struct("score", F.col("key"))).alias("key"))
    added = tail.where("channel = 'visual'").select("query_id", F.col("rank").alias("position"), F.col("attachment_id").alias("origin")).join(named, ["query_id", "origin"])
    return rows.unionByName(added.select("query_id", "position", "key", "origin", F.lit(0.0).alias("rrf"), F.lit("visual").alias("source_reason")))


def quality(*more: str | Column) -> list[Column]:
    """Title hits first, then more of them, then more body hits."""
    return [F.when(F.col("title_hits") > 0, 0).otherwise(1), F.desc("title_hits"), F.desc("body_hits"), *more]


def within_budget(candidates: DataFrame, cap: int = 120) -> DataFrame:
    """Candidates within an internal budget (R32): all of a query's if they fit, else a seat for the best of each dense
    channel and the best of all the others. ``scope`` tells which; ``reserved`` whether a row has a seat.

    candidates: (query_id, key, channel, title_hits, body_hits, given, score), where ``given`` is the rank that its
    channel gave it, or null: then it has the place of its score among its channel's.
    """
    whole = Window.partitionBy("query_id")
    of_channel = Window.partitionBy("query_id", "channel")
    rows = candidates.withColumn("all", F.count(F.lit(1)).over(whole))
    cut = F.col("all") > cap
    nth = F.row_number().over(of_channel.orderBy(F.asc_nulls_last("given"), F.desc("score"), "key"))
    rows = rows.withColumn("channel_rank", F.when(cut, F.coalesce("given", nth)))
    best = F.row_number().over(of_channel.orderBy(*quality("channel_rank", "key")))
    rows = rows.withColumn("reserved", cut & F.col("channel").isin(*DENSE) & (best == 1))
    chosen = F.row_number().over(whole.orderBy(F.desc("reserved"), *quality("channel_rank", "key")))
    rows = rows.withColumn("n", chosen).where(F.col("n") <= cap)
    scope = F.when(cut, "budget_filtered").otherwise("exhaustive").alias("scope")
    return rows.select(*candidates.columns, scope, "reserved", of_query(*quality("channel_rank", "key")).alias("position"))


def lookup(channels: DataFrame, texts: DataFrame, terms: DataFrame, parents: DataFrame, cap: int = 120) -> DataFrame:
    """The pool of a lookup (R33): all channels joined, each candidate with its evidence (R14), the selection under the
    budget (R32), and the parents of those that are left (J12).

    channels: as for joined(), with channel and given; texts: (key, title, text); terms: (query_id, terms);
    parents: (key, parent).
    """
    kept = joined(stored(channels, "lookup-hits")).select("query_id", "key", "channel", "given", "score")
    shown = kept.join(texts, "key", "left").join(terms, "query_id", "left").withColumn("dense", F.col("channel").isin(*DENSE))
    facts = ("query_id", "key", "channel", "given", "score")
    seen = answers.judge_evidence(shown, None, keep=facts)
    lexical = F.col("channel") == "lexical"
    named = F.when(lexical & (F.col("title_hits") > 0), "lexical_title").when(lexical, "lexical_body").otherwise(F.col("channel"))
    chosen = within_budget(seen.withColumn("channel", named), cap)
    return chosen.join(parents, "key", "left").select("query_id", "position", "key", "channel", "scope", "reserved", "title_hits", "body_hits", "term_hits", "mode", "coverage", "evidence", "parent")
