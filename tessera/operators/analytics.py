"""Counts, histograms and lists over entries, labels and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(clock: str, days: int) -> Column:
    return F.expr(f"timestamp_ntz'{clock}' - interval {days} days")


def label_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("user_id", "label_code").agg(F.count(F.lit(1)).alias("n"))


def label_list(labels: DataFrame, entries: DataFrame, users: list[int]) -> DataFrame:
    """Every label for each of the stated users, in order of code, with the user's own entries, 0 allowed (A2)."""
    order = Window.partitionBy("user_id").orderBy("code")
    every = labels.withColumn("user_id", F.explode(F.array(*[F.lit(u).cast("long") for u in users])))
    counts = label_counts(entries).withColumnRenamed("label_code", "code")
    return every.join(counts, ["user_id", "code"], "left").select("user_id", "code", "name", (F.row_number().over(order) - 1).cast("long").alias("sort_order"), F.coalesce("n", F.lit(0)).alias("n"))


def window_stats(entries: DataFrame, clock: str, days: int) -> DataFrame:
    """Entries of the last days by label, with each user's total (A4)."""
    counts = entries.where(F.col("created_at") >= since(clock, days)).groupBy("user_id", "label_code").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("user_id")))


def timeline(entries: DataFrame, clock: str, days: int = 30) -> DataFrame:
    """Entries a day; days without any are absent (A5)."""
    return entries.where(F.col("created_at") >= since(clock, days)).groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def clusters(entries: DataFrame, labels: int = 12, examples_of: int = 4, examples: int = 2) -> DataFrame:
    """Each user's most frequent labels, with the newest entries of the first few."""
    counts = label_counts(entries)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "label_code"))
    top = counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= labels)
    newest = F.row_number().over(Window.partitionBy("user_id", "label_code").orderBy(F.desc("created_at"), F.desc("id")))
    shown = entries.select("user_id", "label_code", "id", "created_at").withColumn("_n", newest).where(F.col("_n") <= examples).groupBy("user_id", "label_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"].cast("string")), ",").alias("newest"))
    return top.join(shown, ["user_id", "label_code"], "left").select("user_id", "label_code", "n", "rank", F.when(F.col("rank") <= examples_of, F.col("newest")).alias("newest"))


def searched(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with what terms are looked up in, as ``hay``: content, label code and label name."""
    named = entries.join(labels.select(F.col("code").alias("label_code"), F.col("name").alias("_name")), "label_code", "left")
    return named.withColumn("hay", F.lower(F.concat_ws("\n", "content", "label_code", "_name"))).drop("_name")


def lexicon_hits(entries: DataFrame, labels: DataFrame, terms: list[str], clock: str, days: int = 30, k: int = 10) -> DataFrame:
    """Each user's newest entries that hold a term of a lexicon, with the terms that they hold."""
    known = F.array(*[F.lit(t) for t in terms])
    found = F.filter(known, lambda t: F.contains("hay", t))
    rows = searched(entries.where(F.col("created_at") >= since(clock, days)), labels).select("user_id", "id", "created_at", F.array_join(found, ",").alias("terms")).where("terms <> ''")
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(newest).cast("long")).where(F.col("rank") <= k).select("user_id", "rank", "id", "terms")


def listed(entries: DataFrame, labels: DataFrame, label: str = "", terms: list[str] | None = None) -> DataFrame:
    """Top-level entries with a label, if one is named, that hold one of the terms, if any are."""
    rows = entries.where("parent_id is null")
    if label:
        rows = rows.where(F.col("label_code") == label)
    if terms:
        rows = searched(rows, labels).where(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains("hay", t))).drop("hay")
    return rows


def entry_page(entries: DataFrame, top: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of each user's listed entries, newest first, with the total and the ids of children."""
    top = top.select("user_id", "id", "label_code", "created_at")
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    totals = top.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    page = top.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= offset + limit).where(F.col("position") > offset).join(totals, "user_id")
    children = entries.where("parent_id is not null").select(F.col("parent_id").alias("id"), F.struct("created_at", F.col("id").alias("child")).alias("c"))
    below = children.join(page.select("id"), "id", "left_semi").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["child"].cast("string")), ",").alias("children"))
    return page.join(below, "id", "left").select("user_id", "position", "id", "label_code", "total", F.coalesce("children", F.lit("")).alias("children"))


def parents(entries: DataFrame) -> DataFrame:
    """Parent, grandparent and root of each entry: two hops, no more."""
    up = entries.select(F.col("id").alias("_id"), F.col("parent_id").alias("_up"))
    one = entries.select("id", "parent_id").join(up, F.col("parent_id") == F.col("_id"), "left").select("id", F.col("_id").alias("parent"), F.col("_up").alias("wanted"))
    two = one.join(up.select("_id"), F.col("wanted") == F.col("_id"), "left")
    return two.select("id", "parent", F.col("_id").alias("grandparent"), F.coalesce("_id", "parent", "id").alias("root"))


def without_vectors(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    return entries.join(vectors.select("id"), "id", "left_anti").select("id", "user_id")


def latest_messages(messages: DataFrame) -> DataFrame:
    """The last message of each session, all of them where several tie."""
    last = messages.groupBy("session_id").agg(F.max("turn").alias("turn"))
    return messages.join(last, ["session_id", "turn"]).select("session_id", "turn", "role", F.length("content").cast("long").alias("chars"))


def sessions(messages: DataFrame, limit: int = 100) -> DataFrame:
    """Message counts of sessions, and whether a session takes no more."""
    return messages.groupBy("user_id", "session_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("from_user"), F.max("turn").alias("last_turn")).withColumn("full", F.col("n") >= limit)


def like_relevance(messages: DataFrame, terms: list[str], k: int = 8) -> DataFrame:
    """Each user's newest messages that hold a term, then scored by the share of terms they hold."""
    known = F.array(*[F.lit(t) for t in terms])
    hits = F.size(F.filter(known, lambda t: F.contains(F.lower("content"), t)))
    rows = messages.select("user_id", "session_id", "turn", hits.alias("hits")).where("hits > 0")
    newest = Window.partitionBy("user_id").orderBy(F.desc("session_id"), F.desc("turn"))
    return rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= k).select("user_id", "session_id", "turn", F.round(F.col("hits") / len(terms), 6).alias("relevance"))


def first_sentences(messages: DataFrame, last: int = 30, shown: int = 6, chars: int = 200) -> DataFrame:
    """A session's summary from the first sentences of its last user messages: of more than six, the first three
    and the last two around an ellipsis (F11, F12)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    recent = messages.select("session_id", "turn", "role", "content").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last).where("role = 'user'")
    sentence = F.substring(F.trim(F.regexp_extract("content", r"^[^.!?\n]*[.!?]?", 0)), 1, chars)
    lists = recent.select("session_id", F.struct("turn", sentence.alias("s")).alias("x")).where("x.s <> ''").groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    s = F.transform("xs", lambda x: x["s"])
    short = F.concat(F.slice(s, 1, 3), F.array(F.lit("...")), F.slice(s, -2, 2))
    return lists.select("session_id", F.size("xs").cast("long").alias("n"), F.array_join(F.when(F.size("xs") > shown, short).otherwise(s), " | ").alias("summary"))
