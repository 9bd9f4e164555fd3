"""Mirrors, versions, frames, files and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.folds import folded

#: What is taken out of page text: addresses, links, ids.
PRIVATE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://[^\s<]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def page_texts(pages: DataFrame, most: int = 2 << 20) -> DataFrame:
    """Plain text of pages without private parts, cut at a number of characters, with its hash."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    clean = F.trim(F.regexp_replace(F.regexp_replace(plain, PRIVATE, ""), r"\s+", " "))
    return pages.select("id", F.length(clean).cast("long").alias("chars"), F.sha2(F.substring(clean, 1, most), 256).alias("content_hash"), (F.length(clean) > most).alias("partial"))


def upserts(mirrors: DataFrame, sources: DataFrame) -> DataFrame:
    """What a sync does to each mirror (S16): only changed texts are written anew."""
    rows = mirrors.select("id", F.col("content_hash").alias("old")).join(sources.select("id", F.col("content_hash").alias("new")), "id", "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("skip")
    return rows.select("id", action.alias("action"))


def merged_discovery(found: DataFrame) -> DataFrame:
    """The last finding of each page, by sequence."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    return found.withColumn("n", last).where("n = 1").drop("n")


def frames(texts: DataFrame) -> DataFrame:
    """Server-sent frames: events and data of a stream of text, comments skipped (S13). texts: (session_id, text)."""
    parts = texts.select("session_id", F.posexplode(F.split("text", "\n\n")).alias("seq", "frame")).where("frame <> '' and not startswith(frame, ':')")
    return parts.select("session_id", F.col("seq").cast("long").alias("seq"), F.regexp_extract("frame", r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract("frame", r"(?m)^data: (.*)$", 1).alias("data"))


def turns_checked(events: DataFrame) -> DataFrame:
    """Whether a request's events form a turn (Q4): a meta event first, one end at the end, nothing after it.

    events: (request, at, id, event) with events meta, status, text_delta, done, error.
    """
    order = Window.partitionBy("request").orderBy("at", "id")
    back = Window.partitionBy("request").orderBy(F.desc("at"), F.desc("id"))
    ends = F.col("event").isin("done", "error")
    rows = events.withColumn("first", F.row_number().over(order) == 1).withColumn("last", F.row_number().over(back) == 1)
    bad = F.when(F.col("first") != (F.col("event") == "meta"), 1).when(F.col("last") != ends, 1).otherwise(0)
    return rows.groupBy("request").agg(F.count(F.lit(1)).alias("events"), (F.sum(bad) == 0).alias("valid"))


def versions(confirms: DataFrame) -> DataFrame:
    """Append-only versions of source sets (Q13). A confirmation counts if it is based on the current version.

    confirms: (session_id, at, id, base).
    """

    def step(now: int, row: dict) -> tuple[int, dict]:
        ok = row["base"] == now
        outcome = "confirmed" if ok else "conflict"
        return now + ok, {"session_id": row["session_id"], "id": row["id"], "outcome": outcome, "version": now + ok}

    rows = confirms.select(F.col("session_id").cast("long").alias("session_id"), "at", "id", F.col("base").cast("long").alias("base"))
    return folded(rows, ["session_id"], ["at", "id"], lambda: 0, step, "session_id long, id long, outcome string, version long")


def keyed_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two lists by key: the later payload at the earlier position (U2). Rows: (query_id, key, position, payload)."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    return both.groupBy("query_id", "key").agg(F.min(F.struct("list", "position")).alias("at"), F.max_by("payload", F.struct("list", "position")).alias("payload")).select("query_id", "key", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "key")).cast("long").alias("position"), "payload")


def member_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two member lists: the first of each key stays, numbered anew from 0."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    kept = both.groupBy("query_id", F.lower("key").alias("key")).agg(F.min(F.struct("list", "position")).alias("at"))
    return kept.select("query_id", "key", (F.row_number().over(Window.partitionBy("query_id").orderBy("at", "key")) - 1).cast("long").alias("display_order"))


def same_members(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Whether an order lists just what is there."""
    a = wanted.select("query_id", "key").distinct().withColumn("w", F.lit(1))
    b = present.select("query_id", "key").distinct().withColumn("p", F.lit(1))
    return a.join(b, ["query_id", "key"], "full").groupBy("query_id").agg((F.count_if(F.col("w").isNull() | F.col("p").isNull()) == 0).alias("permutation"))


def alias_matches(found: DataFrame, known: DataFrame) -> DataFrame:
    """Keys of which any alias is an alias of a known key (J15). Rows: (query_id, key, aliases)."""
    a = found.select("query_id", "key", F.explode("aliases").alias("alias"))
    b = known.select("query_id", F.col("key").alias("known"), F.explode("aliases").alias("alias"))
    return a.join(b, ["query_id", "alias"]).select("query_id", "key", "known").distinct()


def neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks next to a hit, as an equi-join on three indexes."""
    near = hits.select("source_id", F.col("chunk_index").alias("hit"), F.explode(F.sequence(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    return near.join(chunks, ["source_id", "chunk_index"]).select("source_id", "chunk_index").distinct()


def next_positions(nodes: DataFrame) -> DataFrame:
    """The next sibling position of each parent; missing orders are ignored, none gives 0."""
    return nodes.where("parent_id is not null").groupBy("parent_id").agg(F.coalesce(F.max("sort_order") + 1, F.lit(0)).cast("long").alias("next"))


def index_statistics(rows: DataFrame, most: float = 0.2) -> DataFrame:
    """Live and deleted vectors of a user's index, and whether it is due to be rebuilt."""
    counts = rows.groupBy("user_id").agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("deleted"))
    return counts.withColumn("rebuild", F.col("deleted") / (F.col("live") + F.col("deleted")) > most)


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "md", "pdf", "png", "jpg"), most: int = 50 << 20) -> DataFrame:
    """Uploaded files with their hash, and why one is refused (S4). Spark's reader passes over empty files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(~suffix.isin(*suffixes), "type").when(F.col("length") > most, "size").otherwise("")
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("content_hash"), reason.alias("refused"))


def snapshot(vectors: DataFrame, path: str, signature: str) -> None:
    """Writes vectors with the signature of the model that made them."""
    vectors.withColumn("signature", F.lit(signature)).write.mode("overwrite").partitionBy("user_id").parquet(path)


def restored(spark: SparkSession, path: str, signature: str) -> DataFrame:
    """The snapshot's rows of this signature; others are as if absent."""
    return spark.read.parquet(path).where(F.col("signature") == signature).drop("signature")


# Types of attachments whose text is extracted, and by what.
EXTRACTORS = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "slides"}


def extractors(attachments: DataFrame) -> DataFrame:
    """Which extractor an attachment goes to (S8): by its type, any image to the image reader; null if there is none."""
    kind = F.lower(F.trim("mime_type"))
    known = F.coalesce(*[F.when(kind == name, extractor) for name, extractor in EXTRACTORS.items()], F.when(F.startswith(kind, F.lit("image/")), "image"))
    return attachments.select("id", known.alias("extractor"))
