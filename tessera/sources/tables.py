"""The data model over Parquet tables: each entity of a personal knowledge base, bound to the tables given.

All entities carry a user, a query or a session, so that one plan answers for all of them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clocks are parameters with fixed values, so that results don't depend on the day of the run.
TASK_DAY = "1998-06-17"
ENTRY_CLOCK = "2024-02-01 12:00:00"
EVENT_CLOCK = "2024-01-15 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as id",
        "doc_id % 8 as user_id",
        "case when doc_id % 5 in (1, 2) then doc_id - doc_id % 5 end as parent_id",
        "source as label_code",
        "lang",
        "text as content",
        "timestampadd(HOUR, cast(doc_id as int), timestamp_ntz'2024-01-01 00:00:00') as created_at",
    )


def entry_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("code")).distinct().withColumn("name", F.upper("code"))


def todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id",
        "case when o_orderkey % 4 <> 0 then o_orderkey - 1 end as wanted",
        "(o_orderkey div 4) % 50 as user_id",
        "case when o_orderkey % 7 = 0 then null else o_orderkey % 5 end as sort_order",
        "o_orderpriority as content",
        "concat('P', cast(cast(substring(o_orderpriority, 1, 1) as int) - 1 as string)) as priority",
        "substring(o_orderpriority, 1, 1) = '1' as is_urgent",
        "o_orderstatus = 'F' as is_done",
        "case when o_orderkey % 11 = 0 then null else date_add(cast(o_orderdate as date), cast(o_orderkey % 30 as int)) end as due_date",
        "cast(o_orderdate as date) as created_on",
        "case when o_orderstatus = 'F' and o_orderkey % 13 <> 0 then date_add(cast(o_orderdate as date), cast(o_orderkey % 9 as int)) end as completed_on",
    )
    known = rows.select(F.col("id").alias("known"))
    # Orders that want no parent are dealt by a key of their own, as all of them would meet in one task.
    found = rows.join(known, F.coalesce("wanted", F.bitwise_not("id")) == F.col("known"), "left")
    return found.withColumn("parent_id", F.when(F.col("wanted").isNotNull(), F.col("known"))).drop("wanted", "known")


def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each task and day; the lines of an order are not unique, so they are aggregated first."""
    status = "case l_returnflag when 'N' then 'active' when 'A' then 'completed' else case l_linestatus when 'O' then 'carried' else 'returned' end end"
    days = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as todo_id", "cast(l_shipdate as date) as plan_date", f"{status} as status")
    return days.groupBy("todo_id", "plan_date").agg(F.min("status").alias("status")).withColumn("id", F.expr("todo_id * 100000 + datediff(plan_date, date'1990-01-01')"))


def content_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("content_vector"), "label")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry vectors: each has a content vector, and the vector of the next id for its title."""
    rows = content_vectors(spark, sf_dir)
    titles = rows.select((F.col("id") - 1).alias("id"), F.col("content_vector").alias("title_vector"))
    return rows.join(titles, "id", "left").withColumn("title_vector", F.coalesce("title_vector", "content_vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vector"), F.col("label").alias("query_label"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id as session_id", "turn", "role", "text as content", "conv_id % 8 as user_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id as id",
        "case when page_id % 4 <> 0 then page_id - 1 end as parent_id",
        "page_id % 8 as user_id",
        "url",
        "split_part(split_part(url, '://', 2), '/', 1) as host",
        "split_part(split_part(url, '://', 2), '/', 2) as lang",
        "regexp_extract(html, '<title>([^<]*)</title>', 1) as title",
        "html",
        "case page_id % 6 when 0 then 'indexed' when 1 then 'partial' when 2 then 'failed' when 3 then 'syncing' when 4 then 'deleted' else 'pending' end as sync_status",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "user_id",
        "cast(ts as timestamp_ntz) as created_at",
        "event_type",
        "case event_type when 'click' then 'pending' when 'view' then 'pending' when 'purchase' then 'processing' when 'error' then 'failed' else 'succeeded' end as status",
        "cast(event_id % 4 as int) as attempts",
        "cast(event_id % 3 as int) as priority",
        "cast(value as double) as value",
        "cast(get_json_object(props, '$.k') as bigint) as k",
    )


def term_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set for lexical search: the first words of each passage whose id is divisible by 100."""
    words = "filter(split(lower(text), '[^a-z0-9äöüßéèêçàáíóúñ]+'), w -> length(w) >= 4)"
    return table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").selectExpr("item_id as query_id", f"array_distinct(slice({words}, 1, 3)) as terms")


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits of many queries: a block of a hundred documents is a query, dealt out to four lists."""
    hits = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "doc_id div 100 as query_id",
        "cast(doc_id % 4 as int) as list_idx",
        "(doc_id * 37) % 1009 as draw",
        "concat('note:', element_at(array('chunk', 'source', 'entry', 'page'), cast((doc_id * 3) % 4 + 1 as int)), ':', cast((doc_id * 31) % 13 as string)) as key",
        "concat('o', cast((doc_id * 31) % 23 as string)) as origin",
        "(doc_id * 53) % 1000 / 1000.0D as score",
        "element_at(array('lexical', 'knowledge', 'entry', 'attachment', 'other'), cast((doc_id * 7) % 5 + 1 as int)) as channel",
        "case when (doc_id * 11) % 3 = 0 then 'attachment_chunk' else 'mirror' end as source_type",
    )
    return hits.withColumn("rank", F.expr("cast(row_number() over (partition by query_id, list_idx order by draw, doc_id) as bigint)")).withColumn("idx", F.expr("cast(row_number() over (partition by query_id order by draw, doc_id) as bigint)"))
