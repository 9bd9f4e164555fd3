"""One catalogue over all sources, its filters and its discovery page."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.sources.storage import settled


def sources(entries: DataFrame, todos: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries, tasks and live pages as one list of references (S2, P7): key, kind, title, status, answerable."""
    e = entries.select(F.concat(F.lit("entry:entry:"), F.col("id").cast("string")).alias("key"), "user_id", F.lit("record").alias("provider"), F.lit("entry").alias("kind"), tx.title(F.col("content")).alias("title"), F.col("label_code").alias("tag"), F.lit("ready").alias("status"), F.lit(True).alias("answerable"))
    t = todos.select(F.concat(F.lit("todo:source:"), F.col("id").cast("string")).alias("key"), "user_id", F.lit("task").alias("provider"), F.lit("todo").alias("kind"), F.col("content").alias("title"), F.col("priority").alias("tag"), F.when(F.col("is_done"), "done").otherwise("open").alias("status"), F.lit(True).alias("answerable"))
    p = pages.where(~F.col("sync_status").isin("deleted", "permission_lost")).select(F.concat(F.lit("page:source:"), F.col("id").cast("string")).alias("key"), "user_id", F.lit("page").alias("provider"), F.when(F.col("parent_id").isNull(), "page").otherwise("child_page").alias("kind"), "title", F.col("lang").alias("tag"), F.col("sync_status").alias("status"), F.col("sync_status").isin("indexed", "partial").alias("answerable"))
    return e.unionByName(t).unionByName(p)


@dataclass(frozen=True)
class Plan:
    """The filters of a retrieval plan; an empty one passes everything."""

    providers: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    breadcrumb: str = ""
    todo_status: str = ""
    named_source: str = ""
    start: str = ""
    end: str = ""
    answer_context: bool = False


def in_dates(at: Column, start: str, end: str) -> Column:
    """Whether a day, as text, lies between two, both included (P6). Without bounds all pass, with bounds no day fails."""
    if not start and not end:
        return F.lit(True)
    day = F.substring(F.coalesce(at, F.lit("")), 1, 10)
    ok = day != ""
    if start:
        ok &= day >= start[:10]
    return ok & (day <= end[:10]) if end else ok


def filtered(refs: DataFrame, plan: Plan) -> DataFrame:
    """References that meet all filters of a plan, case-folded (P5), the first of each user's key; blank keys all stay.

    refs: (user_id, n, key, provider, kind, title, tags, breadcrumb, todo_status, at, answerable); n orders them.
    A reference needs all tags that the plan names.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = refs.where(in_dates(F.col("at"), plan.start, plan.end))
    if plan.providers:
        rows = rows.where(F.col("provider").isin(*plan.providers))
    if plan.kinds:
        rows = rows.where(F.col("kind").isin(*plan.kinds))
    if plan.tags:
        wanted = F.array(*[F.lit(x.lower()) for x in plan.tags])
        rows = rows.where(F.size(F.array_except(wanted, F.transform("tags", F.lower))) == 0)
    if plan.breadcrumb:
        rows = rows.where(F.contains(low("breadcrumb"), F.lit(plan.breadcrumb.lower())))
    if plan.todo_status:
        rows = rows.where((F.col("kind") == "todo") & (F.col("todo_status") == plan.todo_status))
    if plan.named_source:
        needle = F.lit(plan.named_source.lower())
        rows = rows.where(F.contains(F.concat(low("title"), F.lit("\n"), low("breadcrumb")), needle))
    if plan.answer_context:
        rows = rows.where("answerable")
    nth = F.row_number().over(Window.partitionBy("user_id", "key").orderBy("n"))
    return rows.withColumn("_nth", nth).where("_nth = 1 or coalesce(key, '') = ''").drop("_nth")


def discovered(catalog: DataFrame, topic: str, terms: list[str], offset: int, limit: int) -> DataFrame:
    """Each user's page of matches (R41): 100 for the exact title, 40 for one that holds the topic, 3 for each term."""
    low = F.lower("title")
    score = F.when(low == topic, 100).when(F.contains(low, F.lit(topic)), 40).otherwise(0)
    for term in terms:
        score = score + F.when(F.contains(low, F.lit(term)), 3).otherwise(0)
    rows = catalog.withColumn("score", score.cast("long")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "title", "key"))
    return rows.withColumn("position", place.cast("long")).where((F.col("position") > offset) & (F.col("position") <= offset + limit)).select("user_id", "position", "key", "score")


def group_counts(catalog: DataFrame) -> DataFrame:
    """Three independent histograms of a user's sources in one pass."""
    parts = F.array(*[F.struct(F.lit(g).alias("facet"), F.col(g).alias("value")) for g in ("provider", "kind", "status")])
    return catalog.select("user_id", F.explode(parts).alias("p")).groupBy("user_id", "p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def sync_rollup(connections: DataFrame, pages: DataFrame) -> DataFrame:
    """The sync status of each connection from its pages that aren't deleted (A15): failed without any success, then
    syncing, then partial, else ready. A connection that must sign in again keeps the status that it has.

    connections: (host, status, sync_status); pages: (host, sync_status).
    """
    has = lambda *s: F.bool_or(F.col("sync_status").isin(*s))
    flags = pages.where("sync_status <> 'deleted'").groupBy("host").agg(
        has("failed").alias("failed"),
        has("indexed", "partial").alias("usable"),
        has("pending", "processing").alias("open"),
        has("partial", "failed", "permission_lost").alias("flawed"),
        F.count(F.lit(1)).alias("pages"),
    )
    rows = connections.join(flags, "host", "left")
    status = F.when(F.col("failed") & ~F.col("usable"), "failed").when(F.col("open"), "syncing").when(F.col("flawed"), "partial").otherwise("ready")
    kept = F.when(F.col("status") == "reauth_required", F.col("sync_status")).otherwise(status)
    return rows.select("host", kept.alias("sync_status"), F.coalesce("pages", F.lit(0)).alias("pages"))


def breadcrumbs(pages: DataFrame, chars: int = 1024) -> DataFrame:
    """Titles from the root to a page (T16), whatever the depth: levels go on until none is left. A page met before,
    or one that isn't there, ends the chain."""
    up = pages.select(F.col("id").alias("_id"), F.col("parent_id").alias("_next"), F.col("title").alias("_title"))
    rows = pages.select("id", F.col("parent_id").alias("next"), F.array("title").alias("titles"), F.array("id").alias("seen"))
    done = []
    while True:
        done.append(rows.where("next is null").select("id", "titles"))
        rows = rows.where("next is not null")
        if rows.isEmpty():
            whole = reduce(DataFrame.union, done)
            return whole.select("id", F.substring(F.array_join("titles", " / "), 1, chars).alias("breadcrumb"))
        met = rows.join(up, F.col("next") == F.col("_id"), "left")
        stop = F.col("_id").isNull() | F.array_contains("seen", F.col("_id"))
        on = lambda here, there: F.when(stop, here).otherwise(there)  # noqa: E731, B023
        titles = on(F.col("titles"), F.concat(F.array("_title"), "titles"))
        seen = on(F.col("seen"), F.array_append("seen", F.col("_id")))
        rows = settled(met.select("id", F.when(~stop, F.col("_next")).alias("next"), titles.alias("titles"), seen.alias("seen")))


def owned_subtree(entries: DataFrame, starts: DataFrame) -> DataFrame:
    """Entries under the starts that belong to the start's user (T15), level by level until none is new."""
    level = starts.select("id", F.col("id").alias("start"), "user_id", F.lit(0).cast("long").alias("distance"))
    below = entries.select(F.col("id").alias("_id"), F.col("parent_id").alias("_up"), F.col("user_id").alias("_user"))
    found, d = [level], 0
    while True:
        d += 1
        near = (F.col("id") == F.col("_up")) & (F.col("user_id") == F.col("_user"))
        met = level.join(below, near).select(F.col("_id").alias("id"), "start", "user_id", F.lit(d).cast("long").alias("distance"))
        known = reduce(DataFrame.union, found).select("start", "id")
        level = settled(met.join(known, ["start", "id"], "left_anti").select(*level.columns))
        if level.isEmpty():
            return reduce(DataFrame.union, found).select("start", "id", "distance")
        found.append(level)


def fallback_plans(queries: DataFrame) -> DataFrame:
    """The plan of a query that no planner has seen (F23): an answer from content about its topic, or else about itself,
    without filters. queries: (query_id, text, topic)."""
    strip = lambda c: F.nullif(tx.stripped(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    columns = {"operation": F.lit("answer_content"), "topic": F.coalesce(strip("topic"), strip("text")), "named_source": F.lit(None).cast("string"), "presentation": F.lit("answer")}
    return queries.select("query_id", *[c.alias(k) for k, c in columns.items()])


# What readers may see of a reference.
PUBLIC = ("reference_key", "source_type", "title", "snippet", "label_name", "created_at")


def public_view(refs: DataFrame, shown: tuple[str, ...] = PUBLIC) -> DataFrame:
    """References without their internal columns (F29): only those that are named are shown."""
    return refs.select(*[c for c in refs.columns if c in shown])
