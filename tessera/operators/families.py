"""Families of records and tasks around hits: pre-order, expansion, identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import tree
from tessera.operators.folds import folded
from tessera.sources.storage import settled

#: Levels of a record family.
MAX_DEPTH = 32


def numbered(order: Column, node: Column) -> Column:
    """A sort key that strings order like numbers: when, then the id."""
    return F.concat(F.lpad(order.cast("string"), 14, "0"), F.lit("."), F.lpad(node.cast("string"), 19, "0"))


def record_families(entries: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(user_id, id, root, depth, path) of each entry (T17): its family is what hangs on the topmost entry of its own
    user; paths sort a family in pre-order, children by time and id. Levels go on until one is empty or too deep; an
    entry of a cycle belongs to no family.
    """
    key = numbered(F.unix_seconds(F.col("created_at").cast("timestamp")), F.col("id"))
    rows = entries.select("user_id", "id", "parent_id", key.alias("key"))
    above = rows.select(F.col("user_id").alias("_u"), F.col("id").alias("_p"))
    owned = (F.col("user_id") == F.col("_u")) & (F.col("parent_id") == F.col("_p"))
    rows = settled(rows.join(above, owned, "left").withColumn("parent_id", F.col("_p")).drop("_u", "_p"))
    level = rows.where("parent_id is null").select("user_id", "id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.col("key").alias("path"))
    found = [level]
    for depth in range(1, max_depth + 1):
        up = level.select(F.col("id").alias("parent_id"), "root", F.col("path").alias("_path"))
        below = rows.join(up, "parent_id").select("user_id", "id", "root", F.lit(depth).alias("depth"), F.concat_ws("/", "_path", "key").alias("path"))
        level = settled(below)
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.union, found)


def expanded(hits: DataFrame, families: DataFrame, sizes: DataFrame, most_families: int = 24, most_refs: int = 64, chars: int = 48_000) -> DataFrame:
    """Hits with their whole families (R37): families in the order of their first hits, members in pre-order, each once,
    as long as a number of families, of members and of characters allow. A member that is too long is skipped, and
    later ones still get their chance.

    hits: (query_id, rank, id); families as from record_families; sizes: (id, size).
    """
    of_hit = hits.join(families.select("id", "root"), "id")
    first = of_hit.groupBy("query_id", "root").agg(F.min("rank").alias("first"), F.collect_set("id").alias("hits"))  # a query's own
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "root"))
    chosen = first.withColumn("family", place).where(F.col("family") <= most_families)
    members = families.select("id", "root", "depth", "path").join(sizes, "id")
    rows = chosen.join(members, "root").select("query_id", "family", "path", "root", "id", "depth", "size", F.array_contains("hits", F.col("id")).alias("is_hit"))

    def step(held: tuple[int, int], row: dict) -> tuple[tuple[int, int], dict | None]:
        n, used = held
        if n >= most_refs or used + row["size"] > chars:
            return held, None
        told = {k: row[k] for k in ("query_id", "family", "root", "id", "depth", "is_hit")}
        return (n + 1, used + row["size"]), told | {"position": n + 1}

    return folded(rows, ["query_id"], ["family", "path"], lambda: (0, 0), step, "query_id long, position long, family int, root long, id long, depth int, is_hit boolean")


def todo_trees(hits: DataFrame, todos: DataFrame) -> DataFrame:
    """Every member of the trees that hits lie in (R40), trees in the order of their first hits, in pre-order, once; a
    member that is a hit itself is precise. hits: (query_id, rank, id); hits on unknown tasks are left out."""
    order = tree.preorder(todos).select("id", "root", "depth", F.col("position").alias("place"))
    first = hits.join(order.select("id", "root"), "id").groupBy("query_id", "root").agg(F.min("rank").alias("first"))
    rows = first.join(order, "root").join(hits.select("query_id", "id", F.lit(True).alias("hit")).distinct(), ["query_id", "id"], "left")
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "root", "place"))
    return rows.select("query_id", position.cast("long").alias("position"), "root", "id", "depth", F.coalesce("hit", F.lit(False)).alias("precise"))


def identities(hits: DataFrame, families: DataFrame, todos: DataFrame, pages: DataFrame) -> DataFrame:
    """The keys of all members of what was hit (R51): an entry's family, a task's tree, a page itself. Of repeated keys
    the first counts; what is missing, or a page that isn't indexed, is left out; the order is numbered from 0.

    hits: (query_id, rank, type, id) with types entry, todo and page; pages: (id, sync_status).
    """
    of = lambda kind: hits.where(F.col("type") == kind).select("query_id", "rank", "id")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:source:"), c.cast("string")).alias("key")
    home = families.select("id", "root")
    own = families.select(F.col("id").alias("member"), "root", F.col("path").alias("place"))
    entries = of("entry").join(home, "id").join(own, "root").select("query_id", "rank", "place", key("entry", F.col("member")))
    order = tree.preorder(todos).select("id", "root", F.col("position").alias("place"))
    members = order.select(F.col("id").alias("member"), "root", F.lpad(F.col("place").cast("string"), 10, "0").alias("place"))
    tasks = of("todo").join(order.select("id", "root"), "id").join(members, "root").select("query_id", "rank", "place", key("todo", F.col("member")))
    live = pages.where(F.col("sync_status").isin("indexed", "partial")).select("id")
    alone = of("page").join(live, "id").select("query_id", "rank", F.lit("").alias("place"), key("page", F.col("id")))
    first = entries.union(tasks).union(alone).groupBy("query_id", "key").agg(F.min(F.struct("rank", "place")).alias("at"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "key")) - 1
    return first.select("query_id", number.cast("long").alias("display_order"), "key")


def stale_counts(expected: DataFrame, todos: DataFrame) -> DataFrame:
    """Whether a task still has as many descendants as the asker believes (T9). expected: (id, descendants)."""
    now = tree.metadata(todos).select("id", F.col("descendants").alias("actual"))
    rows = expected.join(now, "id", "left")
    return rows.select("id", "actual", (~F.col("descendants").eqNullSafe(F.col("actual"))).alias("stale"))


def tree_rows(todos: DataFrame) -> DataFrame:
    """Each user's trees as flat rows (T10): roots in the order of lists, below each its members in pre-order."""
    roots = tree.listed(todos.where("parent_id is null")).select(F.col("id").alias("root"), F.col("position").alias("first"))
    rows = tree.preorder(todos).select("id", "root", "depth", F.col("position").alias("place"))
    rows = rows.join(roots, "root").join(todos.select("id", "user_id", "parent_id"), "id")
    position = F.row_number().over(Window.partitionBy("user_id").orderBy("first", "place"))
    return rows.select("user_id", position.cast("long").alias("position"), "id", "parent_id", F.col("depth").cast("long").alias("depth"))
