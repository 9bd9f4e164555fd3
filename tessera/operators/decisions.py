"""Decisions on daily plans, applied (T13, T14): whole trees join or leave a day, what was open before is carried or
returned, and a request that comes again changes nothing.

A request is judged as a whole against the state before the batch and applied or refused as a whole. Of a user's
requests in one batch only the first is looked at; the others are deferred to the next batch, as requests of a user
follow one another. Requests known from before are replayed. Each operator is a few equi-joins on tasks and requests; what several of them
use is a checkpoint, so that plans stay small.

items: (id, todo_id, plan_date, status, source, carried_from_id); todos: (id, user_id, parent_id, is_done, ...). Tasks that
have their chains (``tree.chains``) aren't joined with themselves again by each step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.planning import active_today, day, latest_past_active, rollover_candidates, urgent_candidates
from tessera.operators.tree import chains
from tessera.sources.storage import settled

#: States of a plan's items.
ACTIVE, COMPLETED, CARRIED, RETURNED = "active", "completed", "carried", "returned"
#: Gives a new item its id, from the columns todo_id and plan_date.
NewId = Callable[[], Column]


def moved(todos: DataFrame, items: DataFrame, effects: DataFrame, as_of: str, new_id: NewId, source: str = "rollover") -> DataFrame:
    """All items after tasks were put on a day.

    effects: one row for each task, (todo_id, add, continues, past): whether it joins the day, whether its item there
    continues the latest past active one, and what its past active items become (null: they stay). A task that joins has
    an active item on that day, or a completed one if it is done; what was returned or carried takes the new source
    and lineage, everything else keeps the lineage it has. Tasks that aren't known take no part.
    """
    on = F.col("plan_date") == day(as_of)
    before = (F.col("plan_date") < day(as_of)) & (F.col("status") == ACTIVE)
    known = effects.join(todos.select(F.col("id").alias("todo_id"), F.coalesce("is_done", F.lit(False)).alias("done")), "todo_id")
    last = latest_past_active(items, as_of).select("todo_id", F.col("item_id").alias("last"))
    known = settled(known.join(last, "todo_id", "left").withColumn("last", F.when(F.col("continues"), F.col("last"))))
    state = F.when(F.col("done"), COMPLETED).otherwise(ACTIVE)
    back, open_ = F.col("status").isin(RETURNED, CARRIED), (F.col("status") == ACTIVE) | ((F.col("status") == COMPLETED) & ~F.col("done"))
    joins = on & F.coalesce("add", F.lit(False)) & F.col("status").isin(ACTIVE, COMPLETED, CARRIED, RETURNED)
    old = items.join(known, "todo_id", "left").select(
        "id",
        "todo_id",
        "plan_date",
        F.when(joins, state).when(before & F.col("past").isNotNull(), F.col("past")).otherwise(F.col("status")).alias("status"),
        F.when(joins & back, F.lit(source)).otherwise(F.col("source")).alias("source"),
        F.when(joins & back, F.coalesce("last", "carried_from_id")).when(joins & open_, F.coalesce("carried_from_id", "last")).otherwise(F.col("carried_from_id")).alias("carried_from_id"),
    )
    fresh = known.where("add").join(items.where(on).select("todo_id"), "todo_id", "left_anti").withColumn("plan_date", day(as_of))
    return old.unionByName(fresh.select(new_id().alias("id"), "todo_id", "plan_date", state.alias("status"), F.lit(source).alias("source"), F.col("last").alias("carried_from_id")))


def added(todos: DataFrame, items: DataFrame, requested: DataFrame, as_of: str, new_id: NewId, source: str = "manual") -> DataFrame:
    """All items after tasks and their unfinished descendants were put on a day (T13). requested: (todo_id)."""
    targets = with_descendants(todos, requested).where("todo_id = root or not done").select("todo_id").distinct()
    effects = targets.select("todo_id", F.lit(True).alias("add"), F.lit(True).alias("continues"), F.lit(CARRIED).alias("past"))
    return moved(todos, items, effects, as_of, new_id, source)


def with_descendants(todos: DataFrame, of: DataFrame) -> DataFrame:
    """(root, todo_id, done) of the trees below tasks, these included. of: (todo_id)."""
    wanted = of.select(F.col("todo_id").alias("ancestor")).distinct()
    rows = todos if "above" in todos.columns else chains(todos.select("id", "parent_id", "is_done"))
    below = rows.select(F.explode("above").alias("ancestor"), F.col("id").alias("todo_id"), F.coalesce("is_done", F.lit(False)).alias("done"))
    return below.join(wanted, "ancestor", "left_semi").withColumnRenamed("ancestor", "root")


def looked_at(requests: DataFrame, applied: DataFrame | None) -> DataFrame:
    """(request_id, user_id, turn): 'replayed', 'deferred', or null for the request of a user that is judged now."""
    rows = requests.select("request_id", "user_id").distinct()
    rows = rows.withColumn("seen", F.lit(None).cast("boolean")) if applied is None else rows.join(applied.select("request_id", F.lit(True).alias("seen")).distinct(), "request_id", "left")
    nth = F.row_number().over(Window.partitionBy("user_id", F.col("seen").isNull()).orderBy("request_id"))
    return rows.select("request_id", "user_id", F.when(F.col("seen").isNotNull(), "replayed").when(nth > 1, "deferred").alias("turn"))


def outcomes(judged: DataFrame, requests: DataFrame, applied: DataFrame | None) -> DataFrame:
    """(request_id, user_id, outcome): the first refusal, by stage and position, else 'applied'."""
    worst = judged.where("code is not null").groupBy("request_id").agg(F.min(F.struct("stage", "position", "code"))["code"].alias("code"))
    rows = looked_at(requests, applied).join(worst, "request_id", "left")
    return settled(rows.select("request_id", "user_id", F.coalesce("turn", "code", F.lit("applied")).alias("outcome")))


def with_state(todos: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions with their task's owner and number of descendants, both null for tasks that aren't there."""
    size = with_descendants(todos, rows).groupBy(F.col("root").alias("todo_id")).agg((F.count(F.lit(1)) - 1).alias("actual"))
    owner = todos.select(F.col("id").alias("todo_id"), F.col("user_id").alias("owner"))
    return settled(rows.join(owner, "todo_id", "left").join(size, "todo_id", "left"))


def urgent_judged(todos: DataFrame, items: DataFrame, decisions: DataFrame, as_of: str, applied: DataFrame | None = None) -> DataFrame:
    """What becomes of each request to keep or delete urgent candidates (T14): (request_id, user_id, outcome).

    decisions: (request_id, user_id, position, todo_id, decision, expected); expected is the number of descendants that
    the user saw, or null. Refused: another action than keep and delete, a task decided twice ('conflict' or
    'duplicate'), a task that isn't the user's ('unknown'; deleting what is gone already is none), a changed tree
    ('stale'), and what is neither a candidate nor, if kept, on the day already ('not_a_candidate').
    """
    own = Window.partitionBy("request_id", "todo_id").orderBy("position")
    decisions = settled(decisions)
    rows = decisions.withColumn("nth", F.row_number().over(own)).withColumn("first", F.first("decision").over(own))
    rows = with_state(todos, rows)
    rows = rows.join(urgent_candidates(todos, items, as_of).select(F.col("id").alias("todo_id"), F.lit(True).alias("candidate")), "todo_id", "left")
    rows = rows.join(active_today(items, as_of).select(F.col("id").alias("todo_id"), F.lit(True).alias("planned")).distinct(), "todo_id", "left")
    keep = F.col("decision") == "keep"
    form = F.when(~F.coalesce(F.col("decision").isin("keep", "delete"), F.lit(False)), "action").when((F.col("nth") > 1) & (F.col("decision") != F.col("first")), "conflict").when(F.col("nth") > 1, "duplicate")
    gone = F.col("owner").isNull() & F.col("todo_id").isNotNull() & ~keep
    state = F.when(gone, None).when(~F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False)), "unknown").when(F.col("expected") != F.col("actual"), "stale").when(F.col("candidate").isNull() & ~(keep & F.col("planned").isNotNull()), "not_a_candidate")
    judged = rows.select("request_id", F.when(form.isNotNull(), 1).otherwise(2).alias("stage"), "position", F.coalesce(form, state).alias("code"))
    return outcomes(judged, decisions, applied)


def urgent_applied(todos: DataFrame, items: DataFrame, decisions: DataFrame, judged: DataFrame, as_of: str, new_id: NewId) -> tuple[DataFrame, DataFrame]:
    """Tasks and items after the accepted requests (T14): kept trees are on the day, deleted ones are gone with their items.

    Deleting wins where a kept task lies in a deleted tree.
    """
    taken = settled(decisions.join(judged.where("outcome = 'applied'").select("request_id"), "request_id", "left_semi"))
    gone = settled(with_descendants(todos, taken.where("decision = 'delete'")).select(F.col("todo_id").alias("id")).distinct())
    left = todos.join(gone, "id", "left_anti")
    rest = items.join(gone.withColumnRenamed("id", "todo_id"), "todo_id", "left_anti")
    kept = taken.where("decision = 'keep'").join(gone.withColumnRenamed("id", "todo_id"), "todo_id", "left_anti")
    return left, added(left, rest, kept.select("todo_id"), as_of, new_id, "rollover")


def rollover_judged(todos: DataFrame, reviewed: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """What becomes of each review of past plans (T14): refused as 'stale' if a reviewed tree has changed.

    reviewed: (request_id, user_id, todo_id, selected, expected). Tasks that aren't the user's are passed over.
    """
    rows = with_state(todos, reviewed).where("owner = user_id")
    judged = rows.select("request_id", F.lit(1).alias("stage"), F.col("todo_id").alias("position"), F.when(F.col("expected") != F.col("actual"), "stale").alias("code"))
    return outcomes(judged, reviewed, applied)


def rollover_steps(todos: DataFrame, items: DataFrame, reviewed: DataFrame, judged: DataFrame, as_of: str) -> DataFrame:
    """(root, todo_id, done, request_id, selected, live) of the trees that accepted reviews touch: a selected tree counts
    if its root is still a candidate or on the day already, or joins it with a tree above that is decided first. Trees
    of urgent candidates are left to their own review."""
    taken = reviewed.join(judged.where("outcome = 'applied'").select("request_id"), "request_id", "left_semi")
    taken = taken.groupBy("request_id", "user_id", "todo_id").agg(F.max(F.coalesce("selected", F.lit(False))).alias("selected"))
    owned = todos.select(F.col("id").alias("todo_id"), F.col("user_id").alias("owner"))
    urgent = with_descendants(todos, urgent_candidates(todos, items, as_of).select(F.col("id").alias("todo_id"))).select("todo_id")
    taken = taken.join(owned, "todo_id").where("owner = user_id").join(urgent, "todo_id", "left_anti")
    live = rollover_candidates(todos, items, as_of).select(F.col("id").alias("todo_id"), F.lit(True).alias("live"))
    planned = active_today(items, as_of).select(F.col("id").alias("todo_id"), F.lit(True).alias("planned")).distinct()
    taken = settled(taken.join(live, "todo_id", "left").join(planned, "todo_id", "left"))
    trees = settled(with_descendants(todos, taken))
    sure = taken.where("selected and (live or planned)").select(F.col("todo_id").alias("root"))
    # Whom a surely selected tree decided before puts on the day, too: members that are open.
    lifted = trees.where("not done").join(sure, "root", "left_semi").where("root < todo_id").select("todo_id", F.lit(True).alias("lifted")).distinct()
    taken = taken.join(lifted, "todo_id", "left").where("not selected or live or planned or lifted")
    return settled(trees.join(taken.select(F.col("todo_id").alias("root"), "request_id", "selected", F.coalesce("live", F.lit(False)).alias("live")), "root"))


def rollover_applied(todos: DataFrame, items: DataFrame, steps: DataFrame, as_of: str, new_id: NewId) -> DataFrame:
    """All items after the accepted reviews (T14). A task's past active items go by the first tree, in the order of ids, that
    touches it: they are carried by a selected one and returned by one that was left out."""
    touched = steps.where("not selected or todo_id = root or not done")
    first = touched.groupBy("todo_id").agg(F.min_by("selected", "root").alias("takes"), F.max("selected").alias("add"))
    effects = first.select("todo_id", "add", F.col("takes").alias("continues"), F.when(F.col("takes"), CARRIED).otherwise(RETURNED).alias("past"))
    return moved(todos, items, effects, as_of, new_id)


def rollover_report(items: DataFrame, steps: DataFrame, as_of: str) -> DataFrame:
    """(request_id, todo_id, action) of the reviewed trees: 'added', 'returned', or 'unchanged' where nothing was left to return."""
    touched = steps.where("not selected or todo_id = root or not done")
    first = touched.groupBy("todo_id").agg(F.min("root").alias("root"))
    open_ = items.where((F.col("plan_date") < day(as_of)) & (F.col("status") == ACTIVE)).select("todo_id").distinct()
    changed = first.join(open_, "todo_id", "left_semi").select("root", F.lit(True).alias("changed")).distinct()
    roots = steps.where("todo_id = root").join(changed, "root", "left")
    action = F.when(F.col("selected"), "added").when(F.col("changed") | F.col("live"), "returned").otherwise("unchanged")
    return roots.select("request_id", "todo_id", action.alias("action"))
