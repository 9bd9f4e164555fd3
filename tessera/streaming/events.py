"""Event-time streaming over events: windows, repeats, and claims with state.

The windows are extensions: the data model's own streams are queues and claims. Every function takes a streaming
or a batch DataFrame alike, except where it says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.storage import fresh_path

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "1 hour"
#: Buckets that claims are dealt to. A query that starts again from a checkpoint needs the same number.
BUCKETS = 4096


def stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = LATE) -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first event of each key; a stream forgets keys behind the watermark (Q10)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def claimed(events: DataFrame, lease_seconds: int = 120, buckets: int = BUCKETS) -> DataFrame:
    """Claims with state on a stream (Q1): acquired, in_progress or taken over; state ends with its lease.

    A call of the fold costs far more than a row, so users and types are dealt to buckets by their hash, and a bucket's
    leases are one state.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(user, kind): until for user, kind, until in zip(*state.get, strict=True)} if state.exists else {}
        told = []
        if not state.hasTimedOut:
            rows = pd.concat(batches).sort_values(["ts", "event_id"])
            outcomes = []
            for user, kind, now in zip(rows["user_id"].tolist(), rows["event_type"].tolist(), rows["sec"].tolist(), strict=True):
                until = held.get((user, kind))
                outcomes.append("acquired" if until is None else "in_progress" if now < until else "take_over")
                if outcomes[-1] != "in_progress":
                    held[user, kind] = now + lease_seconds
            told = [pd.DataFrame({"event_id": rows["event_id"], "outcome": outcomes})]
        mark = state.getCurrentWatermarkMs()
        held = {k: until for k, until in held.items() if until * 1000 >= mark}
        if held:
            state.update(([user for user, _ in held], [kind for _, kind in held], list(held.values())))
            state.setTimeoutTimestamp(max(min(held.values()) * 1000, mark + 1))
        elif state.exists:
            state.remove()
        yield from told

    rows = events.withWatermark("ts", LATE).withColumn("sec", F.unix_seconds("ts")).withColumn("bucket", F.pmod(F.xxhash64("user_id", "event_type"), F.lit(buckets)))
    return rows.select("bucket", "ts", "sec", "event_id", "user_id", "event_type").groupBy("bucket").applyInPandasWithState(fold, "event_id long, outcome string", "users array<long>, types array<string>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def finished(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its last result, written as Parquet by each batch."""
    spark = rows.sparkSession
    out, marks = fresh_path(spark, "stream"), fresh_path(spark, "marks")

    def save(batch: DataFrame, epoch: int) -> None:
        # A batch that runs again after a failure overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}" if mode == "append" else f"{out}/epoch=0")

    query = rows.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


