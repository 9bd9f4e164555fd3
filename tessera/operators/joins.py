"""Rows put together with their vectors, records and labels, and the orders of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_rows(chunks: DataFrame, vectors: DataFrame, entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunks that have a vector, with their entries and labels where there are any.

    chunks: (chunk_id, entry_id, text); vectors: (chunk_id, vector); entries: (id, user_id, label_code); labels: (code, name).
    """
    rows = chunks.join(vectors, "chunk_id").join(entries.select(F.col("id").alias("entry_id"), "user_id", "label_code"), "entry_id", "left")
    return rows.join(labels.withColumnRenamed("code", "label_code"), "label_code", "left").select("chunk_id", "entry_id", "user_id", "label_code", F.col("name").alias("label_name"), "text", "vector")


def attachment_rows(chunks: DataFrame, vectors: DataFrame, attachments: DataFrame, entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Attachment chunks that have a vector, an attachment and an entry, with the entry's label if it has one."""
    rows = chunks.join(vectors, "chunk_id").join(attachments, "attachment_id")
    rows = rows.join(entries.select(F.col("id").alias("entry_id"), "user_id", "label_code"), "entry_id")
    return rows.join(labels.withColumnRenamed("code", "label_code"), "label_code", "left").select("chunk_id", "attachment_id", "entry_id", "user_id", "label_code", F.col("name").alias("label_name"), "vector")


def with_vectors(rows: DataFrame, vectors: DataFrame, on: str = "id", model: str | None = None) -> DataFrame:
    """Rows that have a vector (J4), of one model if it is named."""
    own = vectors if model is None else vectors.where(F.col("model") == model).drop("model")
    return rows.join(own, on)


def hydrated(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits with the columns of what they name, in their own order (J8); hits on nothing are left out."""
    found = hits.join(rows, "id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    return found.withColumn("position", place.cast("long"))


def in_scope(candidates: DataFrame, scope: DataFrame) -> DataFrame:
    """Candidates whose keys a query's scope has."""
    return candidates.join(scope.select("query_id", "key"), ["query_id", "key"], "left_semi")


def attachments_ordered(attachments: DataFrame) -> DataFrame:
    """An entry's attachments by their order, time and id (O4); those without an order come last."""
    place = F.row_number().over(Window.partitionBy("entry_id").orderBy(F.asc_nulls_last("sort_order"), "created_at", "id"))
    return attachments.select("entry_id", place.cast("long").alias("position"), "id")


def sessions_ordered(sessions: DataFrame) -> DataFrame:
    """A user's sessions, the one that was changed last first, as their times' text sorts."""
    at = F.coalesce("updated_at", "created_at").cast("string")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(at), F.desc("session_id")))
    return sessions.select("user_id", place.cast("long").alias("position"), "session_id")


def members_ordered(members: DataFrame) -> DataFrame:
    """The members of a manifest by their order, type and id."""
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("display_order", "type", "id")) - 1
    return members.select("set_id", place.cast("long").alias("position"), "type", "id")
