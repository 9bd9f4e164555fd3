"""Which candidates go on: quotas, budgets, gates, judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pool quotas by bucket, in the order in which buckets choose.
QUOTAS = {"dense": 16, "fused": 12, "keyword": 6, "attachment": 6}
FLOORS = {"knowledge": 6, "entry": 3, "attachment": 3}


def pool(hits: DataFrame, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """Buckets choose in turn, skipping keys that earlier buckets have; what is left fills up.

    A bucket's rows are ranked after the rows of earlier buckets' choices are gone, so each bucket is one
    anti-join and one window.
    """
    taken = None
    for order, (bucket, quota) in enumerate(quotas.items()):
        rows = hits.where(F.col("bucket") == bucket)
        if taken is not None:
            rows = rows.join(taken.select("query_id", "key"), ["query_id", "key"], "left_anti")
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key"))).where(F.col("n") <= quota)
        rows = rows.select("query_id", "key", F.lit(order).alias("order"), "n")
        taken = rows if taken is None else taken.unionByName(rows)
    left = hits.join(taken.select("query_id", "key"), ["query_id", "key"], "left_anti").groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    left = left.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key"))).select("query_id", "key", F.lit(len(quotas)).alias("order"), "n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("order", "n"))
    return taken.unionByName(left).withColumn("position", place.cast("long")).where(F.col("position") <= sum(quotas.values())).select("query_id", "position", "key", "order")


def within_budget(candidates: DataFrame, cap: int = 120) -> DataFrame:
    """All in order if they fit; else a seat for the best of each dense channel, then by quality."""
    whole = Window.partitionBy("query_id")
    quality = [F.when(F.col("title_hits") > 0, 0).otherwise(1), F.desc("title_hits"), F.desc("body_hits"), F.asc_nulls_last("dense_rank"), F.asc("key")]
    rows = candidates.withColumn("all", F.count(F.lit(1)).over(whole))
    of_channel = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.asc_nulls_last("dense_rank"), "key"))
    rows = rows.withColumn("seat", F.when((F.col("channel") != "lexical") & (of_channel == 1), 0).otherwise(1))
    rows = rows.withColumn("n", F.row_number().over(whole.orderBy("seat", *quality)))
    return rows.where((F.col("all") <= cap) | (F.col("n") <= cap)).select("query_id", "key", "channel", (F.col("seat") == 0).alias("reserved"))


def admitted(candidates: DataFrame, floors: dict[str, int] = FLOORS, least: float = 0.35, keep: float = 0.985, keep_attachment: float = 0.98, floor: int = 8, use_floors: bool = True) -> DataFrame:
    """The admission gate (R34) over (query_id, idx, channel, score).

    Lexical rows always enter. A dense row enters from its channel's threshold, near the channel's best score, or
    by the channel's seats; with too few admitted, rows in input order fill up, the only way in for others.
    """
    of_channel = Window.partitionBy("query_id", "channel")
    share = F.when(F.col("channel") == "attachment", keep_attachment).otherwise(keep)
    threshold = F.greatest(F.lit(least), F.max("score").over(of_channel) * share)
    seat = F.row_number().over(of_channel.orderBy(F.desc("score"), "idx"))
    seats = F.coalesce(*[F.when(F.col("channel") == c, F.lit(n)) for c, n in floors.items()], F.lit(0)) if use_floors else F.lit(0)
    dense = F.col("channel").isin(*floors)
    first = candidates.withColumn("in", (F.col("channel") == "lexical") | (dense & ((F.col("score") >= threshold) | (seat <= seats))))
    by_query = Window.partitionBy("query_id")
    have = F.count_if("in").over(by_query)
    waiting = F.sum(F.when(F.col("in"), 0).otherwise(1)).over(by_query.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    missing = F.greatest(F.lit(floor if use_floors else 0) - have, F.lit(0))
    found = first.withColumn("filled", ~F.col("in") & (waiting <= missing))
    return found.where("in or filled").select("query_id", "idx", "channel", "score", F.col("filled").alias("by_floor"))


def prompt_prefix(rows: DataFrame, most: int = 48, chars: int = 14_000) -> DataFrame:
    """The longest prefix of summaries whose compact JSON array fits."""
    so_far = F.sum("size").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    # An array of n items has n - 1 commas and two brackets.
    return rows.withColumn("used", (so_far + F.col("rank") + 1).cast("long")).where((F.col("rank") <= most) & (F.col("used") <= chars)).select("query_id", "rank", "id", "used")


def families(admitted_rows: DataFrame, least: int = 3) -> DataFrame:
    """The first hit of each family, and whether the family is one of the few that always show."""
    first = F.row_number().over(Window.partitionBy("query_id", "family").orderBy("idx"))
    heads = admitted_rows.withColumn("n", first).where("n = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("idx"))
    return heads.withColumn("position", place.cast("long")).select("query_id", "position", "family", "idx", (F.col("position") <= least).alias("by_floor"))


def judged(scores: DataFrame, known: DataFrame, most: int = 10, least: int = 2) -> DataFrame:
    """Selection by a judge's scores (R48): unknown keys go, repeats count their best, each rejection has a reason."""
    merged = scores.groupBy("query_id", "key").agg(F.max("relevance").alias("relevance"), F.min("seq").alias("seq"))
    marked = merged.join(known.select("query_id", "key", F.lit(True).alias("known")), ["query_id", "key"], "left")
    good = F.coalesce("known", F.lit(False)) & (F.col("relevance") >= least)
    marked = marked.withColumn("good", good)
    place = F.sum(F.col("good").cast("int")).over(Window.partitionBy("query_id").orderBy("seq", "key").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("place", place)
    reason = F.when(F.col("known").isNull(), "unknown_key").when(F.col("relevance") < least, "low_relevance").when(F.col("place") > most, "over_limit").otherwise("selected")
    return marked.select("query_id", "key", "relevance", reason.alias("reason"))


def judgments_merged(a: DataFrame, b: DataFrame, third: DataFrame, list_all: bool) -> DataFrame:
    """Two passes and a third where they differ (R49). Listing all, any pass suffices; else the third decides, and
    a key that it never saw keeps the first pass's verdict."""
    rows = a.select("query_id", "key", F.col("relevant").alias("ra")).join(b.select("query_id", "key", F.col("relevant").alias("rb")), ["query_id", "key"], "full").join(third.select("query_id", "key", F.col("relevant").alias("rc")), ["query_id", "key"], "left")
    no = F.lit(False)
    agree = F.col("ra").eqNullSafe(F.col("rb"))
    any_of = F.coalesce("ra", no) | F.coalesce("rb", no) | (~agree & F.coalesce("rc", no))
    decided = F.when(F.col("rb").isNull(), F.coalesce("ra", no)).when(agree, F.col("ra")).otherwise(F.coalesce("rc", "ra", no))
    return rows.select("query_id", "key", (any_of if list_all else decided).alias("relevant"), (~agree).alias("disputed"))


def claims_checked(claims: DataFrame, known: DataFrame, used: DataFrame) -> DataFrame:
    """Each claim's valid keys and the ordered codes of what is wrong with it (R50). claims: (query_id, claim, keys, abstains)."""
    sets = known.groupBy("query_id").agg(F.collect_set("key").alias("known")).join(used.groupBy("query_id").agg(F.collect_set("key").alias("used")), "query_id", "full")
    none = F.array().cast("array<string>")
    rows = claims.join(sets, "query_id", "left").withColumns({"known": F.coalesce("known", none), "used": F.coalesce("used", none)})
    valid = F.array_intersect(F.array_intersect("keys", "known"), "used")
    codes = F.array_compact(F.array(F.when(F.size("keys") == 0, "no_keys"), F.when(F.size("used") == 0, "no_used_keys"), F.when(F.size(F.array_except("keys", "known")) > 0, "unknown_key"), F.when(F.size(F.array_except(F.array_intersect("keys", "known"), "used")) > 0, "unused_key")))
    return rows.select("query_id", "claim", F.array_join(F.array_sort(valid), ",").alias("valid_keys"), F.when(F.col("abstains"), "").otherwise(F.array_join(codes, ",")).alias("codes"))
