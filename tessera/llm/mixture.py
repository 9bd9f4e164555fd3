"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Targets come from weights, capped at a multiple of each source's size, the excess reshared by weight. Each
source's documents, in a shuffled order, form a stream that is cut into blocks of equal words. Time runs through
a golden-ratio lattice: slot i is the point i * g modulo the number of slots, with g next to the golden share and
coprime to it; cumulative numbers of slots map the point to a source. Slots are ranked in each source, rank r
takes the stream's block r, over and over, and the last slot of a source is cut at the target.

A null text has size 0 and is never taken. Null sources form one source, the last. Targets are met to the word.
Ties in the shuffled order go by id and size, so only equal rows can take each other's place. No rows, or no
words at all, give no slots. Surplus columns are ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import n_words_of, running, settled

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
#: Words of a block.
BLOCK_WORDS = 2048
SEED = 11
#: Sources that are broadcast to the points of the schedule, a hundred bytes each; more meet them by a shuffle.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, sid, weight, target) of (source, source_size): water-filling in closed form.

    Sources are sorted by cap over weight; if the first j are full, the others' level is what remains over their
    weights. The true level is the highest that leaves its own source below its cap.
    """
    listed = running(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], {}).withColumnRenamed("rank", "sid")
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("long"))
    listed = settled(listed.withColumn("most", cap * F.col("source_size")).withColumn("_ratio", F.col("most") / F.col("weight")))
    whole = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    filled = running(listed, ["_ratio", "sid"], {"full": "most", "spent": "weight"})
    level = (F.lit(share * whole["size"]) - F.col("full")) / (F.lit(whole["weight"]) - F.col("spent"))
    found = filled.select(level.alias("level"), "_ratio").where(F.col("level") <= F.col("_ratio")).agg(F.max("level")).first()[0]
    return listed.select("source", "source_size", "sid", "weight", F.least(F.lit(found or 0.0) * F.col("weight"), F.col("most").cast("double")).alias("target"))


def golden_step(slots: int) -> int:
    """The number next to slots over the golden ratio that shares no factor with slots."""
    near = max(1, round(slots * (math.sqrt(5) - 1) / 2))
    return next(g for k in range(slots + 2) for g in (near + k, near - k) if g > 0 and math.gcd(g, slots) == 1) if slots else 1


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, sid, block, turn, limit): in each slot the first ``limit`` words of a source's block are taken; turn says how
    often the block was taken before."""
    whole, rest = F.expr("case when source_size > 0 then words div source_size else 0 end"), F.expr("case when source_size > 0 then words % source_size else 0 end")
    plan = sources.withColumn("words", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("whole", whole).withColumn("rest", rest)
    plan = plan.withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / block))
    plan = settled(running(plan, ["sid"], {"first": "slots"}).drop("rank"))
    count, rows = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    step = golden_step(count)
    points = sources.sparkSession.range(count).select(F.col("id").alias("slot"), F.expr(f"cast((cast(id as decimal(19,0)) * cast({Decimal(step)} as decimal(19,0))) % cast({max(1, count)} as decimal(19,0)) as long)").alias("point"))
    # Sources and points meet in cells of the point range. Intervals are disjoint, so there are no more rows than sources and cells.
    width = max(1, count // max(1, rows))
    held = plan.where("slots > 0").withColumn("cell", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + slots - 1) div {width}"))))
    # Few sources are broadcast; many have as many cells, with as many points each.
    held = F.broadcast(held) if rows <= BROADCAST_SOURCES else held
    met = points.withColumn("cell", F.expr(f"point div {width}")).join(held, "cell").where("point >= first and point < first + slots")
    ranked = running(met.select("slot", "sid", "source_size", "blocks", "whole", "rest"), ["slot"], {}, by=["sid"])
    at, turn = F.expr("rank % blocks"), F.expr("rank div blocks")
    length = F.least(F.lit(block), F.col("source_size") - at * block)
    limit = F.when(turn < F.col("whole"), length).otherwise(F.least(length, F.col("rest") - at * block))
    return ranked.select("slot", "sid", at.alias("block"), turn.alias("turn"), limit.alias("limit"))


def spans(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: (slot, turn, source, doc_id, begin, words), and what is known of the document. In each slot, in
    order, ``words`` words of a document are taken from its word ``begin``, counted from 0. A document that is never
    taken has one row without a slot. sid and rank tell rows of docs apart, text_hash their texts."""
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words_of(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash")))
    sources = settled(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    slots = schedule(sources, block)
    of_source = sources.withColumnRenamed("source", "_source")
    known = rows.join(of_source, F.col("source").eqNullSafe(F.col("_source"))).select("sid", "doc_id", "source", "size", "text_hash", "source_size", "target", F.xxhash64("doc_id", F.lit(SEED)).alias("_order"))
    stream = running(known, ["_order", "doc_id", "size", "text_hash"], {"start": "size"}, by=["sid"])
    pieces = stream.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))))
    met = pieces.join(slots, ["sid", "block"], "left")
    begin, end = F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * block, F.col("limit"))
    part = F.when(F.col("limit").isNull(), F.lit(0)).otherwise(F.greatest(end - begin, F.lit(0)))
    taken = part > 0
    return met.select("sid", "rank", "doc_id", "source", "text_hash", "size", "source_size", "target", F.when(taken, F.col("slot")).alias("slot"), F.when(taken, F.col("turn")).alias("turn"), F.when(taken, F.col("block") * block + begin - F.col("start")).alias("begin"), part.cast("long").alias("words"))


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row; ``taken`` counts repeats. ``how`` is as of spans()."""
    # A row is known by its source and rank: ids may repeat.
    found = spans(docs, **how).groupBy("sid", "rank", "doc_id", "size", "source_size", "target").agg(F.sum("words").cast("long").alias("taken"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def copies(docs: DataFrame, **how: object) -> DataFrame:
    """(doc_id, text_hash, source, slot): a row for each whole copy of a document that the mix takes, to the nearest
    number, at the slot in which the copy begins."""
    keys = ["sid", "rank", "doc_id", "text_hash", "source", "size"]
    turns = spans(docs, **how).groupBy(*keys, "turn").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
    whole = Window.partitionBy(*keys)
    times = F.floor(F.sum("words").over(whole) / F.greatest(F.col("size"), F.lit(1)) + 0.5)
    nth = F.row_number().over(whole.orderBy(F.asc_nulls_last("slot")))
    return turns.withColumn("_times", times).withColumn("_nth", nth).where("_nth <= _times and slot is not null").select("doc_id", "text_hash", "source", "slot")
