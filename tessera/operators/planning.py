"""Daily plans: completion, candidates for today, roll-over, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tree import listed, roots, topmost


def day(value: str) -> Column:
    return F.lit(value).cast("date")


def share(part: Column, whole: Column) -> Column:
    """A percentage with one digit, halves to even, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole * 100, 1))


def today(todos: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Tasks on today's plan in list order, with their depth and their user's completion.

    Items that are active or completed today count; of them only root tasks enter the completion.
    """
    on = items.where((F.col("plan_date") == day(as_of)) & F.col("status").isin("active", "completed")).select(F.col("todo_id").alias("id"), "status")
    rows = listed(todos.join(on, "id")).join(roots(todos, on).select("id", "depth"), "id")
    done = F.col("is_done") | (F.col("status") == "completed")
    mine = Window.partitionBy("user_id")
    is_root = F.col("parent_id").isNull()
    whole, part = F.count_if(is_root).over(mine), F.count_if(is_root & done).over(mine)
    return rows.select("user_id", "position", F.col("id").alias("todo_id"), "priority", "is_urgent", "due_date", "depth", "status", done.alias("completed"), whole.alias("roots"), part.alias("roots_completed"), share(part, whole).alias("rate"))


def weekly(todos: DataFrame, as_of: str) -> DataFrame:
    """Root tasks created in the ISO week of a day, for each user (A10)."""
    monday = F.date_trunc("week", day(as_of)).cast("date")
    rows = todos.where(F.col("parent_id").isNull() & (F.col("created_on") >= monday) & (F.col("created_on") < F.date_add(monday, 7)))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_done").alias("done")).select("user_id", "total", "done", (F.col("total") - F.col("done")).alias("pending"), share(F.col("done"), F.col("total")).alias("rate"))


def latest_past_active(items: DataFrame, as_of: str) -> DataFrame:
    """The newest active item before a day of each task: an as-of lookup (J19). Ties go to the larger id."""
    return items.where((F.col("plan_date") < day(as_of)) & (F.col("status") == "active")).groupBy("todo_id").agg(F.max(F.struct("plan_date", "id")).alias("last")).select("todo_id", F.col("last.plan_date").alias("plan_date"), F.col("last.id").alias("item_id"))


def flags(todos: DataFrame, as_of: str) -> DataFrame:
    """Expiring within three days, overdue, and a valid priority."""
    left = F.datediff("due_date", day(as_of))
    known = F.upper(F.coalesce("priority", F.lit("P4")))
    return todos.select("id", "user_id", F.coalesce(left.between(0, 3), F.lit(False)).alias("expiring"), F.coalesce(~F.col("is_done") & (left < 0), F.lit(False)).alias("overdue"), F.when(known.isin("P0", "P1", "P2", "P3", "P4"), known).otherwise("P4").alias("priority"))


def active_today(items: DataFrame, as_of: str) -> DataFrame:
    return items.where((F.col("plan_date") == day(as_of)) & (F.col("status") == "active")).select(F.col("todo_id").alias("id"))


def urgent_candidates(todos: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Open urgent roots that aren't active today and have a reason to be: overdue, or planned before."""
    rows = todos.where("not is_done and is_urgent and parent_id is null").join(active_today(items, as_of), "id", "left_anti")
    past = latest_past_active(items, as_of).select(F.col("todo_id").alias("id"), F.col("item_id").alias("past_item"))
    rows = topmost(todos, rows.join(past, "id", "left"))
    reasons = F.array_compact(F.array(F.when(F.col("due_date") < day(as_of), F.lit("overdue")), F.when(F.col("past_item").isNotNull(), F.lit("past_active_plan"))))
    return rows.select("id", "user_id", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def rollover_candidates(todos: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Open roots without urgency whose newest earlier plan is still active."""
    rows = todos.where("not is_done and not is_urgent and parent_id is null").join(active_today(items, as_of), "id", "left_anti")
    return rows.join(latest_past_active(items, as_of).withColumnRenamed("todo_id", "id"), "id").select("id", "user_id", "plan_date", "item_id")


def transitions(items: DataFrame, requested: DataFrame, as_of: str) -> DataFrame:
    """What a request to plan tasks for a day does: the new status and the item it continues.

    An item of that day that was returned, completed or carried becomes active again; a task without one gets a
    new item that continues its latest past active item, which is then carried.
    """
    now = items.where(F.col("plan_date") == day(as_of)).select("todo_id", F.col("id").alias("item_id"), "status")
    past = latest_past_active(items, as_of).select("todo_id", F.col("item_id").alias("carried_from_id"))
    rows = now.join(requested.select("todo_id", F.lit(True).alias("asked")), "todo_id", "full").join(past, "todo_id", "left")
    asked = F.coalesce("asked", F.lit(False))
    action = F.when(asked & F.col("item_id").isNull(), "created").when(asked & (F.col("status") != "active"), "reactivated").when(asked, "unchanged").otherwise("not_requested")
    return rows.select("todo_id", "item_id", action.alias("action"), F.when(asked, "active").otherwise(F.col("status")).alias("new_status"), F.when(action == "created", F.col("carried_from_id")).alias("carried_from_id"))


def notification_counts(todos: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Unfinished root tasks on today's plan, whatever their item's status, and urgent overdue ones."""
    mine = todos.where("parent_id is null and not is_done")
    planned = items.where(F.col("plan_date") == day(as_of)).select(F.col("todo_id").alias("id")).distinct().withColumn("planned", F.lit(True))
    rows = mine.join(planned, "id", "left")
    return rows.groupBy("user_id").agg(F.count_if(F.coalesce("planned", F.lit(False))).alias("plan_unfinished"), F.count_if(F.col("is_urgent") & F.coalesce(F.col("due_date") < day(as_of), F.lit(False))).alias("urgent_overdue"))
