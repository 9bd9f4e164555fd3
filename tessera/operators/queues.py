"""Job queues, outbox, claims: batch transitions."""

from __future__ import annotations

from collections import namedtuple
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import folded


def clock(value: str) -> Column:
    return F.expr(f"timestamp_ntz'{value}'")


def claimable(jobs: DataFrame, now: str, n: int, attempts: int = 3, stuck_minutes: int = 30) -> DataFrame:
    """The next n jobs to claim (Q5): pending ones that are due, then failed ones with attempts left, then stuck ones."""
    tier = F.when((F.col("status") == "pending") & (F.col("created_at") <= clock(now)), 0).when((F.col("status") == "failed") & (F.col("attempts") < attempts), 1).when((F.col("status") == "processing") & (F.col("created_at") < F.expr(f"timestamp_ntz'{now}' - interval {stuck_minutes} minutes")), 2)
    rows = jobs.withColumn("tier", tier).where("tier is not null")
    return rows.orderBy("tier", F.desc("priority"), "created_at", "id").limit(n).select("id", "tier", "priority", "status")


def backoff(jobs: DataFrame) -> DataFrame:
    """Seconds to wait after n attempts under the four rules."""
    n = F.col("attempts")
    wait = lambda most, expression: F.least(F.lit(most), expression).cast("long")
    return jobs.select("id", wait(3600, 30 * F.pow(F.lit(2), n - 1)).alias("notification"), wait(1800, 60 * F.pow(F.lit(2), n)).alias("attachment"), wait(60, F.pow(F.lit(2), n)).alias("transient"), wait(300, 15 * F.pow(F.lit(2), n - 1)).alias("connector"))


def quiet(minute: Column, start: Column, end: Column) -> Column:
    """Whether a minute of the day lies in half-open quiet hours, which may pass midnight; equal ends mean never."""
    return F.when(start == end, F.lit(False)).when(start < end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))


def fan_out(counts: DataFrame, subscriptions: DataFrame, day: str) -> DataFrame:
    """One message for each user, type with a count, and active subscription (Q8, F25), once for each key."""
    kinds = F.array(F.struct(F.lit("plan").alias("type"), F.col("plan_unfinished").alias("n")), F.struct(F.lit("urgent").alias("type"), F.col("urgent_overdue").alias("n")))
    due = counts.select("user_id", F.explode(kinds).alias("k")).select("user_id", "k.type", "k.n").where("n > 0")
    rows = due.join(subscriptions.where("active"), "user_id")
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.lit(day), "type", F.lit("wp"), F.col("subscription_id").cast("string"))
    return rows.select(key.alias("dedupe_key"), "user_id", "type", "n").dropDuplicates(["dedupe_key"])


def outbox_step(jobs: DataFrame, now: str, stale_minutes: int = 10, attempts: int = 3) -> DataFrame:
    """What becomes of each message (Q9): stale processing goes back, attempts are capped, the rest waits or stays."""
    stale = (F.col("status") == "processing") & (F.col("created_at") < F.expr(f"timestamp_ntz'{now}' - interval {stale_minutes} minutes"))
    spent = F.col("attempts") >= attempts
    nxt = F.when(F.col("status").isin("succeeded"), "sent").when(spent & F.col("status").isin("failed", "processing"), "dead").when(stale | (F.col("status") == "failed"), "retry").when((F.col("status") == "pending") & (F.col("created_at") <= clock(now)), "claim").otherwise("wait")
    return jobs.select("id", "status", nxt.alias("next"))


def first_deliveries(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key; repeats are dropped (Q10)."""
    return events.groupBy(*keys).agg(F.min(F.struct("created_at", "id")).alias("f"), F.count(F.lit(1)).alias("deliveries")).select(*keys, F.col("f.id").alias("id"), "deliveries")


#: A claim: what it was asked with, who holds it and until when, when its work is ready and whether that fails.
Claim = namedtuple("Claim", "hash owner until ready failed")


def claim_step(held: Claim | None, row: dict, lease: timedelta) -> tuple[Claim | None, str]:
    """The claim after a request or a heartbeat, and what it is told (Q1, Q2). A heartbeat names the request that holds
    the claim: while its lease runs and its work isn't done it is renewed, else it is lost."""
    at = row["at"]
    if row.get("owner") is not None:
        if held is not None and held.owner == row["owner"] and at < held.until and at < held.ready:
            return held._replace(until=at + lease), "renewed"
        return held, "lost"
    if held is None:
        outcome = "acquired"
    elif held.hash != row["hash"]:
        outcome = "conflict"
    elif held.ready <= at:
        outcome = "take_over" if held.failed else "replay"
    else:
        outcome = "in_progress" if at < held.until else "take_over"
    if outcome in ("acquired", "take_over"):
        held = Claim(row["hash"], row["id"], at + lease, at + timedelta(seconds=row["seconds"]), row["fails"])
    return held, outcome


def claims(requests: DataFrame, lease_seconds: int = 120) -> DataFrame:
    """The outcome of each request for a claim, in order of time (Q1).

    requests: (key, at, id, hash, fails, seconds) and, if there are heartbeats, owner: the id of the request whose
    claim a row renews, null for requests. A new key is acquired. While its lease runs and it isn't done,
    a repeat is in progress; another hash conflicts; a repeat of a finished claim replays it; a failed or expired
    one is taken over.
    """
    lease = timedelta(seconds=lease_seconds)

    def step(held: Claim | None, row: dict) -> tuple[Claim | None, dict]:
        held, outcome = claim_step(held, row, lease)
        return held, {"key": row["key"], "id": row["id"], "outcome": outcome}

    beats = ["owner"] if "owner" in requests.columns else []
    return folded(requests.select("key", "at", "id", "hash", "fails", "seconds", *beats), ["key"], ["at", "id"], lambda: None, step, "key string, id long, outcome string")


def renewals(beats: DataFrame, claimed: DataFrame, lease_seconds: int = 120) -> DataFrame:
    """Whether each heartbeat keeps its claim (Q2): just one claimed row of its owner, whose lease it extends; all else
    is lost. beats: (key, id, owner, at); claimed: (key, owner, status, lease_until)."""
    own = claimed.where("status = 'claimed'").groupBy("key", "owner").agg(F.count(F.lit(1)).alias("rows"))
    found = beats.join(own, ["key", "owner"], "left").withColumn("renewed", F.coalesce(F.col("rows") == 1, F.lit(False)))
    until = F.when(F.col("renewed"), F.timestamp_add("SECOND", F.lit(lease_seconds), F.col("at")))
    return found.select("key", "id", "renewed", until.alias("lease_until"))


def completed(jobs: DataFrame, now: str, attempts: int = 3) -> DataFrame:
    """What becomes of jobs after processing (Q6): done ones stay; a job without its attachment is cancelled, one whose
    attachment is indexed succeeds, a failed attachment ends it, and all others wait for a retry while attempts last.

    jobs: (id, status, attempts, attachment_status); a null attachment_status means that there is none.
    """
    wait = F.least(F.lit(30), F.pow(F.lit(2), F.greatest("attempts", F.lit(1)))).cast("int")
    left = F.coalesce("attempts", F.lit(0)) < attempts
    state = F.col("attachment_status")
    outcome = (
        F.when(F.col("status").isin("succeeded", "cancelled"), "noop")
        .when(state.isNull(), "cancelled")
        .when(state == "indexed", "succeeded")
        .when((state == "failed") | ~left, "failed")
        .otherwise("pending")
    )
    at = F.when(F.col("outcome") == "pending", F.timestamp_add("MINUTE", wait, clock(now)))
    return jobs.withColumn("outcome", outcome).select("id", "outcome", at.alias("available_at"))


def enqueued(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Which requests become jobs (Q7): not those whose event has a job, nor those like a job that is still open; of
    equal requests the first. requests: (id, event_id, connection_id, job_type, page_id); jobs: the same and status."""
    same = lambda *columns: [F.col(f"r.{c}").eqNullSafe(F.col(f"j.{c}")) for c in columns]
    kind = ("connection_id", "job_type", "page_id")
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    known = jobs.where("event_id is not null").select("event_id").distinct().alias("j")
    fresh = requests.alias("r").join(known, F.col("r.event_id") == F.col("j.event_id"), "left_anti")
    fresh = fresh.withColumn("n", F.when(F.col("event_id").isNotNull(), first("event_id")).otherwise(1)).where("n = 1").drop("n")
    open_jobs = jobs.where(F.col("status").isin("pending", "processing", "retry")).select(*kind).distinct().alias("j")
    alone = fresh.alias("r").join(open_jobs, same(*kind), "left_anti")
    return alone.withColumn("n", first(*kind)).where("n = 1").select("id", "event_id", *kind)


def finalised(results: DataFrame, jobs: DataFrame, now: str, attempts: int = 6) -> DataFrame:
    """A worker's result counts only while it owns the job's lease (Q7): then the job succeeds, is retried after a wait
    that doubles, or fails for good. results: (id, owner, ok); jobs: (id, owner, status, lease_until, attempts)."""
    own = jobs.select("id", F.col("owner").alias("_owner"), "status", "lease_until", "attempts")
    rows = results.join(own, "id", "left")
    held = F.coalesce((F.col("_owner") == F.col("owner")) & (F.col("status") == "processing") & (F.col("lease_until") > clock(now)), F.lit(False))
    wait = F.least(F.lit(300.0), 15 * F.pow(F.lit(2), F.greatest(F.col("attempts") - 1, F.lit(0)))).cast("int")
    outcome = F.when(~held, "lost").when(F.col("ok"), "succeeded").when(F.col("attempts") < attempts, "retry").otherwise("failed")
    at = F.when(F.col("outcome") == "retry", F.timestamp_add("SECOND", wait, clock(now)))
    return rows.withColumn("outcome", outcome).select("id", "owner", "outcome", at.alias("available_at"))


def manual_syncs(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Whether a manual sync repeats one that started less than a minute before and is still running (Q11)."""
    last = Window.partitionBy("user_id").orderBy("created_at", "id")
    before = F.lag("created_at").over(last)
    running = F.lag("status").over(last).isin("pending", "processing")
    gap = F.timestamp_diff("SECOND", before, F.col("created_at"))
    return requests.select("id", "user_id", F.coalesce((gap < seconds) & running, F.lit(False)).alias("no_op"))
