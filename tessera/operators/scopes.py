"""Scopes, histories, validations and small renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.tree import closure
from tessera.sources.storage import settled


def page_kinds(pages: DataFrame) -> DataFrame:
    """A page whose parent is no known page is a row of a database, if its path has two parts (P9); a page is
    searchable if it is indexed and both its hashes are there and equal (P8)."""
    known = pages.select(F.col("id").alias("_p"))
    rows = pages.join(known, F.col("parent_id") == F.col("_p"), "left")
    kind = F.when(F.col("parent_id").isNotNull() & F.col("_p").isNull() & (F.col("depth") >= 2), "database_row").otherwise("page")
    good = F.col("sync_status").isin("indexed", "partial") & (F.coalesce("observed_hash", F.lit("")) != "") & F.col("observed_hash").eqNullSafe(F.col("indexed_hash"))
    return rows.select("id", kind.alias("kind"), good.alias("searchable"))


def reviewed(entries: DataFrame, clock: str, scopes: dict[str, int | None]) -> DataFrame:
    """Entries of each user in each scope of so many days; a scope without days is all."""
    now = F.expr(f"timestamp_ntz'{clock}'")
    age = F.timestamp_diff("SECOND", F.col("created_at"), now)
    hits = [F.when(F.lit(True) if days is None else age <= days * 86400, F.lit(name)) for name, days in scopes.items()]
    return entries.select("user_id", F.explode(F.array_compact(F.array(*hits))).alias("scope")).groupBy("user_id", "scope").agg(F.count(F.lit(1)).alias("n"))


def organised(entries: DataFrame, clock: str, days: int = 30, most: int = 40) -> DataFrame:
    """The newest entries of a scope with their direct children, and whether more were left out."""
    recent = entries.where(F.col("created_at") >= F.expr(f"timestamp_ntz'{clock}' - interval {days} days")).select("user_id", "id", "created_at")
    children = entries.select("user_id", F.col("id").alias("child"), F.col("created_at").alias("at"), "parent_id").join(recent.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("user_id", F.col("child").alias("id"), F.col("at").alias("created_at"))
    rows = recent.union(children).distinct()
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))
    return rows.withColumn("rank", n.cast("long")).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy("user_id")) > most).where(F.col("rank") <= most).select("user_id", "rank", "id", "truncated")


def intent(text: Column, list_all: list[str], find_one: list[str]) -> Column:
    """Markers decide in order."""
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))
    return F.when(has(list_all), "list_all").when(has(find_one), "find_one").otherwise("answer")


def due(text: Column) -> Column:
    """An ISO date at the start, else null."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def histories(messages: DataFrame, raw: int = 8, chars: int = 6000, compact_at: int = 20) -> DataFrame:
    """A session's last messages within a budget of characters, newest first, and whether it is due to be compacted."""
    back = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    rows = messages.select("session_id", "turn", F.length("content").cast("long").alias("size"))
    rows = rows.withColumn("n", F.row_number().over(back)).withColumn("used", F.sum("size").over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("session_id")))
    return rows.where((F.col("n") <= raw) & (F.col("used") <= chars)).select("session_id", "turn", "used", (F.col("all") >= compact_at).alias("compact"))


def merged_lists(old: Column, new: Column, most: int = 12) -> Column:
    """Old items, then new ones, unique without regard to case, no more than so many."""
    items = F.transform(F.concat(old, new), lambda x: F.struct(x.alias("x"), tx.lower(x).alias("low")))
    # An array of one element binds the items: their lower case is made once for each pair of lists.
    kept = F.transform(F.array(items), lambda at: F.filter(at, lambda s, i: F.array_position(at["low"], s["low"]) == i + 1))
    return F.slice(F.element_at(kept, 1)["x"], 1, most)


def with_recent(hits: DataFrame, recent: DataFrame, n: int) -> DataFrame:
    """Vector hits, then recent items not among them, up to n."""
    fresh = recent.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = hits.select("query_id", F.lit(0).alias("part"), "rank", "id").union(fresh.select("query_id", F.lit(1).alias("part"), "rank", "id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank", "id"))
    return both.withColumn("position", place.cast("long")).where(F.col("position") <= n).select("query_id", "position", "id")


def artifacts_checked(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """What is missing, changed or extra against a manifest of hashes."""
    rows = manifest.select("name", F.col("hash").alias("want")).join(present.select("name", F.col("hash").alias("have")), "name", "full")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "changed").otherwise("ok")
    return rows.select("name", state.alias("state"))


def claim_coverage(checked: DataFrame) -> DataFrame:
    """Share of a query's claims with a valid key."""
    return checked.groupBy("query_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("valid_keys") != "").alias("covered")).withColumn("coverage", F.round(F.col("covered") / F.col("claims"), 6))


def finished_turns(messages: DataFrame) -> DataFrame:
    """Requests with just one question and one answer (Q3). messages: (request, role)."""
    return messages.groupBy("request").agg(F.count_if(F.col("role") == "user").alias("questions"), F.count_if(F.col("role") == "assistant").alias("answers")).withColumn("complete", (F.col("questions") == 1) & (F.col("answers") == 1))


def promoted(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept nodes under their nearest kept ancestor."""
    up = closure(nodes).join(kept.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    near = up.where("distance > 0").groupBy("id").agg(F.min_by("ancestor", "distance").alias("shown_under"))
    return kept.select("id").join(near, "id", "left")


def positions_filled(rows: DataFrame) -> DataFrame:
    """Positions from 0 in a group where none is set (W2). rows: (group, id, created_on, sort_order)."""
    n = F.row_number().over(Window.partitionBy("group").orderBy("created_on", "id")) - 1
    return rows.select("group", "id", F.coalesce("sort_order", n).cast("long").alias("sort_order"))


def snapshot_lists(todos: DataFrame, open_n: int = 12, done_n: int = 5) -> DataFrame:
    """Each user's first open tasks and newest finished ones, tasks without a parent only (O2).

    Open ones go by priority, whose name must be exact (others count as the last), then by due day, none last, then
    the newest first; finished ones by when they were finished, unknown last.
    """
    names = F.array(*[F.lit(f"P{i}") for i in range(5)])
    priority = F.coalesce(F.nullif(F.array_position(names, F.col("priority")), F.lit(0)), F.lit(5))
    to_do = [priority, F.asc_nulls_last("due_date"), F.desc_nulls_last("created_on"), "id"]
    finished = [F.desc_nulls_last("completed_on"), "id"]
    roots = todos.where("parent_id is null")

    def first(rows: DataFrame, order: list, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
        return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select("user_id", "is_done", "rank", "id")

    return first(roots.where("not is_done"), to_do, open_n).union(first(roots.where("is_done"), finished, done_n))


def plans_validated(plans: DataFrame, operations: list[str], providers: list[str]) -> DataFrame:
    """Codes of what is wrong with a plan (F22). plans: (id, operation, provider, start, end, presentation)."""
    iso = r"^\d{4}-\d{2}-\d{2}$"
    codes = F.array_compact(
        F.array(
            F.when(~F.col("operation").isin(*operations), "operation"),
            F.when(F.col("provider").isNotNull() & ~F.col("provider").isin(*providers), "provider"),
            F.when(~F.col("start").rlike(iso) | ~F.col("end").rlike(iso), "date_format"),
            F.when(F.col("start").rlike(iso) & F.col("end").rlike(iso) & (F.col("start") > F.col("end")), "date_order"),
            F.when((F.col("operation") == "list") & (F.col("presentation") == "answer"), "presentation"),
        )
    )
    return plans.select("id", F.array_join(codes, ",").alias("codes"))


def decisions_checked(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """What is wrong with decisions on candidates (T14, U7): unknown tasks, and tasks decided more than once."""
    n = decisions.groupBy("todo_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("decision").alias("kinds"))
    rows = n.join(candidates.select(F.col("id").alias("todo_id"), F.lit(True).alias("known")), "todo_id", "left")
    code = F.when(F.col("known").isNull(), "not_a_candidate").when(F.col("kinds") > 1, "conflict").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return rows.select("todo_id", code.alias("code"))


def context(candidates: DataFrame, caps: dict[str, int], total: int = 18, seats: tuple[str, ...] = ("dense", "keyword", "attachment")) -> DataFrame:
    """A context by sources (R36): a seat for the first of each bucket of ``seats``, then buckets in order, each up to
    its cap, up to a total. No bucket ever exceeds its cap; a key counts where it is taken first."""
    nth = F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("rank", "key"))
    rows = settled(candidates.where(F.col("bucket").isin(*caps)).withColumn("n", nth))
    taken = None

    def next_of(bucket: str, n: int, part: int) -> None:
        """Takes a bucket's first n rows whose keys aren't taken yet; its seat counts for its cap."""
        nonlocal taken
        own = rows.where(F.col("bucket") == bucket)
        if taken is not None:
            own = own.join(taken.select("query_id", "key"), ["query_id", "key"], "left_anti")
            seated = taken.where((F.col("bucket") == bucket)).groupBy("query_id").agg(F.count(F.lit(1)).alias("seated"))
            own = own.join(seated, "query_id", "left")
        else:
            own = own.withColumn("seated", F.lit(0))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("n"))
        own = own.withColumn("n", place).where(F.col("n") <= n - F.coalesce("seated", F.lit(0)))
        own = own.select("query_id", "key", "bucket", F.lit(part).alias("part"), "n")
        taken = settled(own if taken is None else taken.union(own))  # or each step would repeat all before it

    for i, bucket in enumerate(seats):
        next_of(bucket, min(1, caps.get(bucket, 0)), i)
    for i, (bucket, cap) in enumerate(caps.items()):
        next_of(bucket, cap, len(seats) + i)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "n"))
    return taken.withColumn("position", place.cast("long")).where(F.col("position") <= total).select("query_id", "position", "bucket", "key")
