"""Claims on a stream beside the batch fold, with heartbeats, several files and a restart from the checkpoint."""

import random

from pyspark.sql import functions as F

from tessera.operators import queues
from tessera.streaming import claims, events

KINDS = "key string, at long, id long, hash string, fails boolean, seconds int, owner long"


def rows_of(n=160):
    rng = random.Random(5)
    rows, last = [], {}
    for i in range(n):
        key = rng.choice("abc")
        beat = rng.random() < 0.3 and key in last
        rows.append((key, i * 17, i, None if beat else rng.choice("xxxy"), None if beat else rng.random() < 0.4, None if beat else rng.choice([20, 90, 900]), last[key] if beat else None))
        if not beat:
            last[key] = i
    return rows


def timed(df):
    return df.withColumn("at", F.timestamp_seconds(F.col("at") + 1_700_000_000))


def test_stream_of_claims_equals_the_fold_across_a_restart(spark, tmp_path):
    rows = rows_of()
    batch = timed(spark.createDataFrame(rows, KINDS)).withColumn("at", F.col("at").cast("timestamp_ntz"))
    want = {r["id"]: r["outcome"] for r in queues.claims(batch).collect()}
    assert set(want.values()) == {"acquired", "in_progress", "replay", "conflict", "take_over", "renewed", "lost"}
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    schema = timed(spark.createDataFrame(rows, KINDS)).schema
    for part in range(4):  # a query of its own for each: it starts again where the one before stopped, in mid-lease
        timed(spark.createDataFrame(rows[40 * part : 40 * part + 40], KINDS)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = claims.claimed(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = [(r["id"], r["outcome"]) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(rows) and dict(got) == want


def run_of(stream, out, marks):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)


def test_state_of_claims_has_rows_of_buckets_and_not_of_keys(spark, tmp_path):
    """Each key had three rows of state and a timer, each with calls of its own."""
    rng = random.Random(6)
    rows = [(f"k{rng.randrange(900)}", i * 3, i, rng.choice("xxxy"), rng.random() < 0.4, rng.choice([20, 90, 900]), None) for i in range(3000)]
    want = {r["id"]: r["outcome"] for r in queues.claims(timed(spark.createDataFrame(rows, KINDS)).withColumn("at", F.col("at").cast("timestamp_ntz"))).collect()}
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for part in range(3):
        timed(spark.createDataFrame(rows[1000 * part : 1000 * part + 1000], KINDS)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(timed(spark.createDataFrame(rows, KINDS)).schema).parquet(source)
        assert run_of(claims.claimed(stream, buckets=8), out, marks) <= 8 * 5
    got = [(r["id"], r["outcome"]) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(rows) and dict(got) == want


def test_leases_of_users_are_kept_by_buckets_and_end(spark, tmp_path):
    """Each user and type had a state of its own. A lease that ends behind the watermark is forgotten: two days later all
    is acquired anew."""
    rng = random.Random(7)
    rows = [(i, 1_700_000_000 + i * 2, rng.randrange(300), rng.choice(["view", "click"]), 1.0, "{}") for i in range(2000)]
    later = [(i + 9000, sec + 2 * 86_400 + 9000, user, kind, v, p) for i, sec, user, kind, v, p in rows[:400]]
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    columns = "event_id long, sec long, user_id long, event_type string, value double, props string"
    for part in (rows[:1000], rows[1000:], [(99_999, 1_700_000_000 + 86_400 + 9000, 999, "view", 1.0, "{}")], later):
        made = spark.createDataFrame(part, columns).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
        made.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        assert run_of(events.claimed(stream, lease_seconds=600, buckets=8), out, marks) <= 8
    got = {r["event_id"]: r["outcome"] for r in spark.read.parquet(out).collect()}
    held, want = {}, {}
    for i, now, user, kind, *_ in rows + [(99_999, 0, 999, "view")]:
        until = held.get((user, kind))
        want[i] = "acquired" if until is None else "in_progress" if now < until else "take_over"
        if want[i] != "in_progress":
            held[user, kind] = now + 600
    held = {}
    for i, now, user, kind, *_ in later:
        until = held.get((user, kind))
        want[i] = "acquired" if until is None else "in_progress" if now < until else "take_over"
        if want[i] != "in_progress":
            held[user, kind] = now + 600
    assert got == want and set(want.values()) == {"acquired", "in_progress", "take_over"}
