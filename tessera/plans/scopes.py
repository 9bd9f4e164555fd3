"""Queries over scopes, histories and validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import planning, retrieval
from tessera.operators import scopes as sc
from tessera.plans import search, tasks  # noqa: F401  (its SQL is part of ours)
from tessera.plans.records import CATALOG, catalog_of
from tessera.plans.registry import ORACLES, query
from tessera.sources import tables as t

CLOCK = t.ENTRY_CLOCK


@query("SELECT p.id, CASE WHEN p.parent IS NOT NULL AND k.id IS NULL AND depth >= 2 THEN 'database_row' ELSE 'page' END AS kind, p.sync_status IN ('indexed', 'partial') AND p.id % 5 <> 0 AND p.id % 7 <> 0 AS searchable FROM (SELECT id, CASE WHEN id % 9 = 4 THEN id + 100000000 ELSE parent_id END AS parent, id % 3 + 1 AS depth, sync_status FROM site_pages) p LEFT JOIN site_pages k ON k.id = p.parent")
def page_kinds(spark, d):
    rows = t.pages(spark, d).selectExpr("id", "case when id % 9 = 4 then id + 100000000 else parent_id end as parent_id", "id % 3 + 1 as depth", "sync_status", "case when id % 5 = 0 then '' else 'h' end as observed_hash", "case when id % 7 = 0 then null else 'h' end as indexed_hash")
    return sc.page_kinds(rows)


@query(f"SELECT user_id, scope, count(*) AS n FROM entries, (VALUES ('7d', 7), ('30d', 30), ('all', NULL)) s(scope, days) WHERE days IS NULL OR TIMESTAMP '{CLOCK}' - created_at <= days * INTERVAL 1 DAY GROUP BY ALL")
def review_scope(spark, d):
    return sc.reviewed(t.entries(spark, d), CLOCK, {"7d": 7, "30d": 30, "all": None})


@query(
    f"SELECT user_id, rank, id, truncated FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank, count(*) OVER (PARTITION BY user_id) > 40 AS truncated FROM (SELECT user_id, id, created_at FROM r UNION SELECT e.user_id, e.id, e.created_at FROM entries e WHERE e.parent_id IN (SELECT id FROM r))) WHERE rank <= 40",
    f"r AS (SELECT user_id, id, created_at FROM entries WHERE created_at >= TIMESTAMP '{CLOCK}' - INTERVAL 30 DAY)",
)
def organise_scope(spark, d):
    return sc.organised(t.entries(spark, d), CLOCK)


@query("SELECT session_id, turn, CASE WHEN contains(lower(content), 'list') OR contains(lower(content), 'all') THEN 'list_all' WHEN contains(lower(content), 'find') OR contains(lower(content), 'where') THEN 'find_one' ELSE 'answer' END AS intent FROM messages")
def message_intents(spark, d):
    return t.messages(spark, d).select("session_id", "turn", sc.intent(F.col("content"), ["list", "all"], ["find", "where"]).alias("intent"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN DATE '2024-05-01' END AS due FROM entries")
def due_dates(spark, d):
    said = F.expr("case id % 4 when 0 then '2024-05-01 at noon' when 1 then 'tomorrow' when 2 then '2024-13-01' end")
    return t.entries(spark, d).select("id", sc.due(said).alias("due"))


@query("SELECT session_id, turn, used, \"all\" >= 20 AS compact FROM (SELECT session_id, turn, row_number() OVER w AS n, CAST(sum(length(content)) OVER w AS BIGINT) AS used, count(*) OVER (PARTITION BY session_id) AS \"all\" FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY turn DESC)) WHERE n <= 8 AND used <= 6000")
def session_history(spark, d):
    return sc.histories(t.messages(spark, d))


@query("SELECT id, (SELECT string_agg(x, '|' ORDER BY p) FROM (SELECT arg_min(x, p) AS x, min(p) AS p FROM (SELECT unnest(xs) AS x, generate_subscripts(xs, 1) AS p) GROUP BY lower(x) ORDER BY p LIMIT 12)) AS items FROM (SELECT id, list_filter(string_split(substr(content, 1, 80), ' '), lambda x: x <> '') || list_filter(string_split(substr(content, 41, 120), ' '), lambda x: x <> '') AS xs FROM entries)")
def summary_merge(spark, d):
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    items = F.array_join(sc.merged_lists(words(F.substring("content", 1, 80)), words(F.substring("content", 41, 120))), "|")
    return t.entries(spark, d).select("id", F.nullif(items, F.lit("")).alias("items"))


@query(
    f"SELECT query_id, position, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, id) AS position FROM (SELECT query_id, 0 AS part, rank, id FROM hit UNION ALL SELECT query_id, 1, rank, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) AS rank FROM dense QUALIFY rank <= 12) f WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.query_id = f.query_id AND h.id = f.id))) WHERE position <= 12",
    search.DENSE,
    f"hit AS (SELECT query_id, {search.RANKED} AS rank, id FROM dense WHERE score >= 0.35 QUALIFY rank <= 30)",
)
def vector_recent_merge(spark, d):
    queries, vectors = t.query_vectors(spark, d), t.content_vectors(spark, d)
    # The newest rows are the same for every query.
    newest = vectors.select("id").orderBy(F.desc("id")).limit(12)
    recent = retrieval.best(queries.select("query_id").join(F.broadcast(newest), F.lit(True)), 12, F.desc("id"))
    return sc.with_recent(retrieval.dense(queries, vectors), recent, 12)


@query("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN title_hits > 0 THEN 0 ELSE 1 END, title_hits DESC, body_hits DESC, id) AS rank, id, title_hits, body_hits FROM (SELECT query_id, id, len(list_filter(terms, lambda x: contains(lower(content), x))) AS title_hits, len(list_filter(terms, lambda x: contains(lower(content), x))) AS body_hits FROM todos, (VALUES (0, ['urgent', 'low']), (1, ['medium', 'high', 'specified'])) q(query_id, terms)) WHERE body_hits > 0 QUALIFY rank <= 40")
def todo_lexical(spark, d):
    asked = spark.createDataFrame([(0, ["urgent", "low"]), (1, ["medium", "high", "specified"])], "query_id int, terms array<string>")
    return retrieval.lexical(asked, t.todos(spark, d))


@query(f"SELECT query_id, count(*) AS claims, count(*) FILTER (valid_keys <> '') AS covered, round(count(*) FILTER (valid_keys <> '') / count(*)::DOUBLE, 6) AS coverage FROM ({ORACLES['claim_contract']}) GROUP BY query_id")
def claim_coverage(spark, d):
    return sc.claim_coverage(search.claim_contract(spark, d))


@query("SELECT 'd' || CAST(id AS VARCHAR) AS name, CASE WHEN id % 10 = 1 THEN 'missing' WHEN id % 10 = 0 THEN 'extra' WHEN id % 10 = 2 THEN 'changed' ELSE 'ok' END AS state FROM entries")
def artifact_check(spark, d):
    rows = t.entries(spark, d).select("id", F.concat(F.lit("d"), F.col("id").cast("string")).alias("name"), F.sha2("content", 256).alias("hash"))
    return sc.artifacts_checked(rows.where("id % 10 <> 0"), rows.where("id % 10 <> 1").withColumn("hash", F.when(F.col("id") % 10 == 2, "other").otherwise(F.col("hash"))))


@query("SELECT request, questions, answers, questions = 1 AND answers = 1 AS complete FROM (SELECT session_id * 1000 + turn // 2 AS request, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'assistant') AS answers FROM messages GROUP BY ALL)")
def finished_turns(spark, d):
    return sc.finished_turns(t.messages(spark, d).select(F.expr("session_id * 1000 + turn div 2").alias("request"), "role"))


@query("SELECT k.id, (SELECT arg_min(c.ancestor, c.distance) FROM closure c JOIN todos a ON a.id = c.ancestor WHERE c.id = k.id AND c.distance > 0 AND NOT a.is_done) AS shown_under FROM todos k WHERE NOT is_done")
def filtered_tree(spark, d):
    todos = t.todos(spark, d)
    return sc.promoted(todos, todos.where("not is_done"))


@query("SELECT user_id AS \"group\", id, coalesce(sort_order, row_number() OVER (PARTITION BY user_id ORDER BY created_on, id) - 1) AS sort_order FROM todos")
def position_backfill(spark, d):
    return sc.positions_filled(t.todos(spark, d).withColumnRenamed("user_id", "group"))


@query(
    """SELECT user_id, false AS is_done, rank, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN priority IN ('P0', 'P1', 'P2', 'P3') THEN priority ELSE 'P4' END, coalesce(due_date, DATE '9999-12-31'), created_on DESC, id) AS rank FROM todos WHERE parent_id IS NULL AND NOT is_done) WHERE rank <= 12
UNION ALL SELECT user_id, true, rank, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(completed_on, DATE '0001-01-01') DESC, id) AS rank FROM todos WHERE parent_id IS NULL AND is_done) WHERE rank <= 5"""
)
def todo_snapshot(spark, d):
    return sc.snapshot_lists(t.todos(spark, d))


@query("SELECT id, concat_ws(',', CASE WHEN id % 5 = 4 THEN 'operation' END, CASE WHEN id % 6 = 5 THEN 'provider' END, CASE WHEN id % 7 = 6 THEN 'date_format' END, CASE WHEN id % 7 <> 6 AND id % 4 = 3 THEN 'date_order' END, CASE WHEN id % 5 = 0 AND id % 3 = 0 THEN 'presentation' END) AS codes FROM entries")
def plan_validation(spark, d):
    rows = t.entries(spark, d).selectExpr("id", "element_at(array('list', 'answer', 'find', 'count', 'fly'), cast(id % 5 + 1 as int)) as operation", "element_at(array('record', 'task', 'page', null, 'record', 'moon'), cast(id % 6 + 1 as int)) as provider", "case when id % 7 = 6 then 'May' else '2024-02-01' end as start", "case when id % 4 = 3 then '2024-01-01' else '2024-03-01' end as end", "case when id % 3 = 0 then 'answer' else 'table' end as presentation")
    return sc.plans_validated(rows, ["list", "answer", "find", "count"], ["record", "task", "page"])


DECIDED = "dec AS (SELECT id AS todo_id, 'keep' AS decision FROM todos WHERE id % 3 = 0 UNION ALL SELECT id, 'keep' FROM todos WHERE id % 12 = 0 UNION ALL SELECT id, 'drop' FROM todos WHERE id % 24 = 0)"


@query(f"SELECT todo_id, CASE WHEN c.id IS NULL THEN 'not_a_candidate' WHEN kinds > 1 THEN 'conflict' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS code FROM (SELECT todo_id, count(*) AS n, count(DISTINCT decision) AS kinds FROM dec GROUP BY todo_id) LEFT JOIN ({ORACLES['urgent_candidates']}) c ON c.id = todo_id", DECIDED)
def plan_decisions(spark, d):
    todos = t.todos(spark, d)
    pick = lambda m, what: todos.where(f"id % {m} = 0").select(F.col("id").alias("todo_id"), F.lit(what).alias("decision"))
    return sc.decisions_checked(pick(3, "keep").union(pick(12, "keep")).union(pick(24, "drop")), planning.urgent_candidates(todos, t.plan_items(spark, d), t.TASK_DAY))


CAPS = {"dense": 14, "keyword": 4, "attachment": 8, "other": 18}
CONTEXT = (
    "offer AS (SELECT query_id, (['dense', 'keyword', 'attachment', 'other'])[list_idx + 1] AS bucket, key, min(rank) AS rank FROM rankings GROUP BY ALL)",
    "d1 AS (SELECT *, 1 AS place FROM (SELECT query_id, bucket, key, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS n FROM offer WHERE bucket = 'dense') WHERE n <= 1)",
    "k1 AS (SELECT *, 2 AS place FROM (SELECT query_id, bucket, key, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS n FROM offer o WHERE bucket = 'keyword' AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.query_id = o.query_id AND x.key = o.key)) WHERE n <= 1)",
    "s2 AS (SELECT * FROM d1 UNION ALL SELECT * FROM k1)",
    "a1 AS (SELECT *, 3 AS place FROM (SELECT query_id, bucket, key, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS n FROM offer o WHERE bucket = 'attachment' AND NOT EXISTS (SELECT 1 FROM s2 x WHERE x.query_id = o.query_id AND x.key = o.key)) WHERE n <= 1)",
    "s3 AS (SELECT * FROM s2 UNION ALL SELECT * FROM a1)",
    *[
        f"s{4 + i} AS (SELECT * FROM s{3 + i} UNION ALL SELECT *, {4 + i} FROM (SELECT query_id, bucket, key, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS n FROM offer o WHERE bucket = '{b}' AND NOT EXISTS (SELECT 1 FROM s{3 + i} x WHERE x.query_id = o.query_id AND x.key = o.key)) f WHERE n <= {cap} - (SELECT count(*) FROM s3 x WHERE x.query_id = f.query_id AND x.bucket = '{b}'))"
        for i, (b, cap) in enumerate(CAPS.items())
    ],
)


@query("SELECT query_id, position, bucket, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, n) AS position FROM s7) WHERE position <= 18", *CONTEXT)
def source_context(spark, d):
    bucket = F.element_at(F.array(*[F.lit(b) for b in CAPS]), F.col("list_idx") + 1)
    return sc.context(t.rankings(spark, d).groupBy("query_id", bucket.alias("bucket"), "key").agg(F.min("rank").alias("rank")), CAPS)


@query("SELECT event_type, status, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM jobs GROUP BY ALL")
def worker_stats(spark, d):
    return t.jobs(spark, d).groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


@query("SELECT label_code, count(*) AS n, count(*) FILTER (regexp_matches(content, '(?i)(token|secret|password)\\s*[=:]')) AS leaks FROM entries GROUP BY label_code")
def leak_check(spark, d):
    return t.entries(spark, d).groupBy("label_code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content").rlike(r"(?i)(token|secret|password)\s*[=:]")).alias("leaks"))


@query("SELECT user_id, string_agg(CAST(n AS VARCHAR) || ' ' || provider, ', ' ORDER BY provider) AS answer FROM (SELECT user_id, provider, count(*) AS n FROM catalog GROUP BY ALL) GROUP BY user_id", CATALOG)
def inventory_answer(spark, d):
    """How many sources of each provider a user has, as a sentence (R42, P17): counts only, no content."""
    counts = catalog_of(spark, d).groupBy("user_id", "provider").agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("provider", "n"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), x["provider"]))
    return counts.groupBy("user_id").agg(F.array_join(parts, ", ").alias("answer"))
