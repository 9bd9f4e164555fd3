"""Reviews of a period, progress on goals, layers of a ranking report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx


def review(entries: DataFrame, todos: DataFrame, clock: str, days: int, day: str) -> DataFrame:
    """Of each user the entries and labels of the last days, and the root tasks: all, open, finished in that time."""
    since = F.expr(f"timestamp_ntz'{clock}' - interval {days} days")
    written = entries.where(F.col("created_at") >= since).groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("label_code").alias("labels"))
    late = F.col("completed_on") >= F.date_sub(F.lit(day).cast("date"), days)
    tasks = todos.where("parent_id is null").groupBy("user_id").agg(F.count(F.lit(1)).alias("todos"), F.count_if(~F.col("is_done")).alias("open"), F.count_if(F.col("is_done") & late).alias("completed"))
    rows = written.join(tasks, "user_id", "full")
    return rows.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entries", "labels", "todos", "open", "completed")])


def goal_progress(goals: DataFrame, todos: DataFrame, entries: DataFrame, n_goals: int = 5, n_todos: int = 8, n_context: int = 6, n_related: int = 4, most: int = 8) -> DataFrame:
    """What shows progress on a user's goals (A7): the newest goals, the newest open root tasks, and entries: the newest
    ones, then the newest that hold one of the first goal's three terms, each once, up to a number.

    goals: (user_id, id, updated_at, content).
    """
    newest = lambda rows, n, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("long")).where(F.col("rank") <= n)
    late = [F.desc("created_at"), F.desc("id")]
    top = newest(goals, n_goals, F.desc("updated_at"), F.desc("id"))
    tasks = newest(todos.where("parent_id is null and not is_done"), n_todos, F.desc("created_on"), F.desc("id"))
    # One row for each user: its first goal's terms go to the entries, which are cut to few before they are sorted.
    terms = top.where("rank = 1").select("user_id", tx.keyword_terms(F.col("content"), 3).alias("terms"))
    context = newest(entries.select("user_id", "id", "created_at"), n_context, *late).withColumn("part", F.lit(0))
    hit = F.exists("terms", lambda t: F.contains(F.lower("content"), t))
    related = newest(entries.join(terms, "user_id").where(hit).select("user_id", "id", "created_at"), n_related, *late).withColumn("part", F.lit(1))
    both = context.unionByName(related).groupBy("user_id", "id").agg(F.min(F.struct("part", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("at", "id"))
    shown = both.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)
    part = lambda rows, kind: rows.select("user_id", F.lit(kind).alias("kind"), "rank", "id")
    return part(top, "goal").union(part(tasks, "todo")).union(part(shown, "entry"))


def report_layers(per_case: DataFrame, cases: DataFrame) -> DataFrame:
    """Each retriever's means over cases that can be judged (A22): eligible ones with an answer; the others are counted.

    per_case: (case_id, retriever, recall, mrr, ndcg); cases: (case_id, eligible, answerable).
    """
    rows = per_case.join(cases, "case_id").withColumn("good", F.col("eligible") & F.col("answerable"))
    means = [F.round(F.avg(F.when(F.col("good"), F.col(m))), 6).alias(m) for m in ("recall", "mrr", "ndcg")]
    return rows.groupBy("retriever").agg(F.count(F.lit(1)).alias("cases"), F.count_if("good").alias("denominator"), *means)
