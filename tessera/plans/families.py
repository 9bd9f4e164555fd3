"""Queries over families, joined rows, reviews, job queues and small text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import answers, catalog, families, joins, queues, reviews, sync
from tessera.operators import evaluation as ev
from tessera.plans.records import CASES, cases, metric_tables
from tessera.plans.registry import ORACLES, query
from tessera.plans.tasks import META, ROOTS
from tessera.sources import tables as t

CLOCK, NOW, DAY = t.ENTRY_CLOCK, t.EVENT_CLOCK, t.TASK_DAY

FAMILIES = """families AS (WITH RECURSIVE f(user_id, id, root, depth, path) AS (
  SELECT user_id, id, id, 0, lpad(CAST(CAST(epoch(created_at) AS BIGINT) AS VARCHAR), 14, '0') || '.' || lpad(CAST(id AS VARCHAR), 19, '0') FROM entries e
   WHERE NOT EXISTS (SELECT 1 FROM entries p WHERE p.id = e.parent_id AND p.user_id = e.user_id)
  UNION ALL SELECT e.user_id, e.id, f.root, depth + 1, path || '/' || lpad(CAST(CAST(epoch(e.created_at) AS BIGINT) AS VARCHAR), 14, '0') || '.' || lpad(CAST(e.id AS VARCHAR), 19, '0')
   FROM f JOIN entries e ON e.parent_id = f.id AND e.user_id = f.user_id WHERE depth < 32) SELECT * FROM f)"""


@query("SELECT user_id, id, root, depth, row_number() OVER (PARTITION BY root ORDER BY path) AS position FROM families", FAMILIES)
def record_families(spark, d):
    rows = families.record_families(t.entries(spark, d))
    return rows.selectExpr("user_id", "id", "root", "depth", "row_number() over (partition by root order by path) as position")


def entry_hits(spark, d):
    """Each block of a hundred documents is a query; it hits the entries of some of its documents."""
    return t.rankings(spark, d).where("list_idx = 0").selectExpr("query_id", "rank", "doc_id as id")


@query(
    """SELECT query_id, position, family, root, id, depth, is_hit FROM (SELECT *, n_before + 1 AS position FROM kept) WHERE taken""",
    FAMILIES,
    "hits AS (SELECT query_id, rank, doc_id AS id FROM rankings WHERE list_idx = 0)",
    "chosen AS (SELECT * FROM (SELECT query_id, root, list(id) AS ids, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), root) AS family FROM hits JOIN families USING (id) GROUP BY query_id, root) WHERE family <= 24)",
    "lined AS (SELECT query_id, family, c.root, f.id, depth, length(content) AS size, list_contains(ids, f.id) AS is_hit, row_number() OVER (PARTITION BY query_id ORDER BY family, path) AS n FROM chosen c JOIN families f USING (root) JOIN entries e ON e.id = f.id)",
    """kept AS (WITH RECURSIVE k(query_id, n, family, root, id, depth, is_hit, n_before, used, taken, size) AS (
      SELECT query_id, n, family, root, id, depth, is_hit, 0, 0, size <= 48000, size FROM lined WHERE n = 1
      UNION ALL SELECT l.query_id, l.n, l.family, l.root, l.id, l.depth, l.is_hit, k.n_before + CAST(k.taken AS INTEGER), k.used + CASE WHEN k.taken THEN k.size ELSE 0 END,
       k.n_before + CAST(k.taken AS INTEGER) < 64 AND k.used + CASE WHEN k.taken THEN k.size ELSE 0 END + l.size <= 48000, l.size FROM k JOIN lined l ON l.query_id = k.query_id AND l.n = k.n + 1) SELECT * FROM k)""",
)
def family_expansion(spark, d):
    entries = t.entries(spark, d)
    sizes = entries.select("id", F.length("content").cast("long").alias("size"))
    return families.expanded(entry_hits(spark, d), families.record_families(entries), sizes)


TODO_HITS = "todo_hits AS (SELECT id // 400 AS query_id, id AS id, row_number() OVER (PARTITION BY id // 400 ORDER BY (id * 37) % 101, id) AS rank FROM todos WHERE id % 20 = 1)"


def todo_hits(spark, d):
    return t.todos(spark, d).where("id % 20 = 1").selectExpr("id div 400 as query_id", "id", "row_number() over (partition by id div 400 order by (id * 37) % 101, id) as rank")


@query(
    f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first, root, place) AS position, root, o.id, depth, EXISTS (SELECT 1 FROM todo_hits h WHERE h.query_id = x.query_id AND h.id = o.id) AS precise FROM (SELECT query_id, root, min(rank) AS first FROM todo_hits JOIN rooted USING (id) GROUP BY ALL) x JOIN (SELECT id, root, depth, position AS place FROM ({ORACLES['todo_preorder']})) o USING (root)",
    TODO_HITS,
    ROOTS,
)
def todo_tree_expansion(spark, d):
    return families.todo_trees(todo_hits(spark, d), t.todos(spark, d))


@query(
    f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, place, key) - 1 AS display_order, key FROM (
 SELECT query_id, key, arg_min(rank, (rank, place)) AS rank, arg_min(place, (rank, place)) AS place FROM (
  SELECT h.query_id, h.rank, f.path AS place, 'entry:source:' || CAST(f.id AS VARCHAR) AS key FROM rankings h JOIN families g ON g.id = h.doc_id JOIN families f ON f.root = g.root WHERE list_idx = 0 AND idx <= 40 AND doc_id % 3 = 0
  UNION ALL SELECT h.query_id, h.rank, lpad(CAST(o.position AS VARCHAR), 10, '0'), 'todo:source:' || CAST(o.id AS VARCHAR) FROM rankings h JOIN rooted r ON r.id = h.doc_id JOIN ({ORACLES['todo_preorder']}) o ON o.root = r.root WHERE list_idx = 0 AND idx <= 40 AND doc_id % 3 = 1
  UNION ALL SELECT h.query_id, h.rank, '', 'page:source:' || CAST(p.id AS VARCHAR) FROM rankings h JOIN site_pages p ON p.id = h.doc_id WHERE list_idx = 0 AND idx <= 40 AND doc_id % 3 = 2 AND sync_status IN ('indexed', 'partial'))
 GROUP BY query_id, key)""",
    FAMILIES,
    ROOTS,
)
def candidate_identities(spark, d):
    hits = t.rankings(spark, d).where("list_idx = 0 and idx <= 40").selectExpr("query_id", "rank", "element_at(array('entry', 'todo', 'page'), cast(doc_id % 3 + 1 as int)) as type", "doc_id as id")
    return families.identities(hits, families.record_families(t.entries(spark, d)), t.todos(spark, d), t.pages(spark, d))


@query("SELECT e.id, m.descendants AS actual, (e.id % 3) IS DISTINCT FROM m.descendants AS stale FROM (SELECT id FROM todos WHERE id % 2 = 0 UNION ALL SELECT -1) e LEFT JOIN meta m USING (id)", META)
def stale_tree_counts(spark, d):
    todos = t.todos(spark, d)
    asked = todos.where("id % 2 = 0").select("id").union(spark.range(1).selectExpr("cast(-1 as bigint) as id"))
    return families.stale_counts(asked.selectExpr("id", "cast(id % 3 as bigint) as descendants"), todos)


@query(
    f"SELECT t.user_id, row_number() OVER (PARTITION BY t.user_id ORDER BY l.position, o.position) AS position, t.id, t.parent_id, o.depth FROM ({ORACLES['todo_preorder']}) o JOIN ({ORACLES['todo_list_sorted']}) l ON l.id = o.root JOIN todos t ON t.id = o.id",
    ROOTS,
)
def todo_tree_rows(spark, d):
    return families.tree_rows(t.todos(spark, d))


def chunk_tables(spark, d):
    """Entry windows as chunks; those of every second embedding have a vector. Each hundred windows of a text have numbers
    of their own, so that those of a long text aren't those of the next."""
    chunks = t.entries(spark, d).select("id", F.posexplode(tx.windows(F.col("content"))).alias("n", "text")).selectExpr("id * 100 + n % 100 + shiftleft(cast(n div 100 as bigint), 48) as chunk_id", "id as entry_id", "text")
    vectors = t.table(spark, d, "embeddings").where("vec_id % 2 = 0").selectExpr("vec_id * 100 as chunk_id", "cast(embedding as array<double>) as vector")
    return chunks, vectors


@query(
    "SELECT c.chunk_id, c.entry_id, e.user_id, e.label_code, l.name AS label_name, round(list_sum(list_transform(v.vector, lambda x: x * x)), 4) AS norm FROM (SELECT id * 100 AS chunk_id, id AS entry_id FROM entries WHERE trim(regexp_replace(content, '[ \\n]', '', 'g')) <> '') c JOIN (SELECT vec_id * 100 AS chunk_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id % 2 = 0) v USING (chunk_id) LEFT JOIN entries e ON e.id = c.entry_id AND e.id % 7 <> 0 LEFT JOIN entry_labels l ON l.code = e.label_code"
)
def chunk_vector_rows(spark, d):
    chunks, vectors = chunk_tables(spark, d)
    rows = joins.chunk_rows(chunks, vectors, t.entries(spark, d).where("id % 7 <> 0"), t.entry_labels(spark, d))
    return rows.selectExpr("chunk_id", "entry_id", "user_id", "label_code", "label_name", "round(aggregate(vector, 0D, (s, x) -> s + x * x), 4) as norm")


@query(
    "SELECT v.vec_id AS chunk_id, v.vec_id // 3 AS attachment_id, (v.vec_id // 3) * 2 AS entry_id, e.user_id, e.label_code, l.name AS label_name FROM embeddings v JOIN entries e ON e.id = (v.vec_id // 3) * 2 LEFT JOIN entry_labels l ON l.code = e.label_code AND l.code <> 'src3' WHERE (v.vec_id // 3) % 5 <> 0"
)
def attachment_vector_rows(spark, d):
    ids = t.table(spark, d, "embeddings").select("vec_id")
    chunks = ids.selectExpr("vec_id as chunk_id", "vec_id div 3 as attachment_id")
    attachments = chunks.where("attachment_id % 5 <> 0").selectExpr("attachment_id", "attachment_id * 2 as entry_id").distinct()
    vectors = t.table(spark, d, "embeddings").selectExpr("vec_id as chunk_id", "embedding as vector")
    return joins.attachment_rows(chunks, vectors, attachments, t.entries(spark, d), t.entry_labels(spark, d).where("code <> 'src3'")).drop("vector")


@query("SELECT e.id, e.user_id, v.label FROM entries e JOIN embeddings v ON v.vec_id = e.id")
def entry_vector_rows(spark, d):
    return joins.with_vectors(t.entries(spark, d).select("id", "user_id"), t.table(spark, d, "embeddings").selectExpr("vec_id as id", "label"))


@query("SELECT s.id, s.turns FROM (SELECT conv_id AS id, count(*) AS turns FROM conversations GROUP BY conv_id) s JOIN embeddings v ON v.vec_id = s.id WHERE v.label % 3 = 1")
def session_vector_rows(spark, d):
    sessions = t.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("turns"))
    vectors = t.table(spark, d, "embeddings").selectExpr("vec_id as id", "concat('m', cast(label % 3 as string)) as model")
    return joins.with_vectors(sessions, vectors, model="m1")


@query("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS position, id, user_id, label_code FROM (SELECT query_id, rank, doc_id + 500 AS id FROM rankings WHERE list_idx = 1) JOIN entries USING (id)")
def hydrated_hits(spark, d):
    hits = t.rankings(spark, d).where("list_idx = 1").selectExpr("query_id", "rank", "doc_id + 500 as id")
    return joins.hydrated(hits, t.entries(spark, d).select("id", "user_id", "label_code")).select("query_id", "position", "id", "user_id", "label_code")


@query("SELECT query_id, doc_id, key FROM rankings r WHERE list_idx = 0 AND EXISTS (SELECT 1 FROM rankings s WHERE s.list_idx = 1 AND s.query_id = r.query_id AND s.key = r.key)")
def scope_candidates(spark, d):
    rows = t.rankings(spark, d)
    return joins.in_scope(rows.where("list_idx = 0").select("query_id", "doc_id", "key"), rows.where("list_idx = 1"))


@query("SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END, vec_id % 3, vec_id % 5, vec_id) AS position, vec_id AS id FROM (SELECT vec_id, vec_id // 8 AS entry_id FROM embeddings)")
def attachment_order(spark, d):
    rows = t.table(spark, d, "embeddings").selectExpr("vec_id div 8 as entry_id", "case when vec_id % 4 <> 0 then vec_id % 3 end as sort_order", "case when vec_id % 4 = 0 then vec_id % 3 * 10 + vec_id % 5 else vec_id % 5 end as created_at", "vec_id as id")
    return joins.attachments_ordered(rows)


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN id % 3 <> 0 THEN CAST(DATE '2024-01-01' + CAST(id * 7 % 90 AS INTEGER) AS VARCHAR) END, CAST(DATE '2024-01-01' + CAST(id % 50 AS INTEGER) AS VARCHAR)) DESC, id DESC) AS position, id AS session_id FROM (SELECT DISTINCT conv_id AS id, conv_id % 8 AS user_id FROM conversations)")
def session_order(spark, d):
    day = lambda n: f"date_add(date'2024-01-01', cast({n} as int))"
    rows = t.table(spark, d, "conversations").select("conv_id").distinct()
    return joins.sessions_ordered(rows.selectExpr("conv_id as session_id", "conv_id % 8 as user_id", f"case when conv_id % 3 <> 0 then {day('conv_id * 7 % 90')} end as updated_at", f"{day('conv_id % 50')} as created_at"))


@query("SELECT query_id AS set_id, row_number() OVER (PARTITION BY query_id ORDER BY idx % 7, channel, doc_id) - 1 AS position, channel AS type, doc_id AS id FROM rankings")
def manifest_order(spark, d):
    return joins.members_ordered(t.rankings(spark, d).selectExpr("query_id as set_id", "idx % 7 as display_order", "channel as type", "doc_id as id"))


REVIEW = lambda days: f"""SELECT user_id, coalesce(entries, 0) AS entries, coalesce(labels, 0) AS labels, coalesce(todos, 0) AS todos, coalesce("open", 0) AS "open", coalesce(completed, 0) AS completed
FROM (SELECT user_id, count(*) AS entries, count(DISTINCT label_code) AS labels FROM entries WHERE created_at >= TIMESTAMP '{CLOCK}' - INTERVAL {days} DAY GROUP BY user_id)
FULL JOIN (SELECT user_id, count(*) AS todos, count(*) FILTER (NOT is_done) AS "open", count(*) FILTER (is_done AND completed_on >= DATE '{DAY}' - {days}) AS completed FROM todos WHERE parent_id IS NULL GROUP BY user_id) USING (user_id)"""  # noqa: E731


@query(REVIEW(7))
def weekly_review(spark, d):
    return reviews.review(t.entries(spark, d), t.todos(spark, d), CLOCK, 7, DAY)


@query(REVIEW(30))
def monthly_review(spark, d):
    return reviews.review(t.entries(spark, d), t.todos(spark, d), CLOCK, 30, DAY)


GOALS = "goals AS (SELECT conv_id * 1000 + turn AS id, conv_id % 8 AS user_id, text AS content, turn * 10 + conv_id % 7 AS updated_at FROM conversations WHERE role = 'user')"


@query(
    """SELECT user_id, 'goal' AS kind, rank, id FROM g WHERE rank <= 5
UNION ALL SELECT user_id, 'todo', rank, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_on DESC, id DESC) AS rank FROM todos WHERE parent_id IS NULL AND NOT is_done) WHERE rank <= 8
UNION ALL SELECT user_id, 'entry', rank, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY least(coalesce(c, 1000), 100 + coalesce(r, 1000)), id) AS rank FROM (
  SELECT user_id, id, min(n) FILTER (part = 0) AS c, min(n) FILTER (part = 1) AS r FROM (
   SELECT 0 AS part, user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM entries QUALIFY n <= 6
   UNION ALL SELECT 1, e.user_id, e.id, row_number() OVER (PARTITION BY e.user_id ORDER BY created_at DESC, e.id DESC) AS n FROM entries e JOIN g ON g.user_id = e.user_id AND g.rank = 1 WHERE len(list_filter(terms, lambda x: contains(lower(e.content), x))) > 0 QUALIFY n <= 4) GROUP BY user_id, id)) WHERE rank <= 8""",
    GOALS,
    """g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) AS rank,
   (SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p) GROUP BY w ORDER BY p LIMIT 3)) AS terms
  FROM (SELECT *, list_filter(string_split(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) BETWEEN 2 AND 40) AS ws FROM goals))""",
)
def goal_progress(spark, d):
    goals = t.table(spark, d, "conversations").where("role = 'user'").selectExpr("conv_id * 1000 + turn as id", "conv_id % 8 as user_id", "text as content", "turn * 10 + conv_id % 7 as updated_at")
    return reviews.goal_progress(goals, t.todos(spark, d), t.entries(spark, d))


@query(
    "SELECT retriever, count(*) AS cases, count(*) FILTER (case_id % 4 <> 0 AND case_id % 3 <> 0) AS denominator, round(avg(recall) FILTER (case_id % 4 <> 0 AND case_id % 3 <> 0), 6) AS recall, round(avg(mrr) FILTER (case_id % 4 <> 0 AND case_id % 3 <> 0), 6) AS mrr, round(avg(ndcg) FILTER (case_id % 4 <> 0 AND case_id % 3 <> 0), 6) AS ndcg FROM metrics GROUP BY retriever",
    CASES,
    *metric_tables(10),
)
def ranking_report(spark, d):
    ranked, qrels = cases(spark, d)
    known = ranked.select("case_id").distinct().selectExpr("case_id", "case_id % 4 <> 0 as eligible", "case_id % 3 <> 0 as answerable")
    return reviews.report_layers(ev.metrics(ranked, qrels), known)


@query(
    "SELECT b.id, coalesce(c.n = 1, false) AS renewed, CASE WHEN c.n = 1 THEN b.created_at + INTERVAL 120 SECOND END AS lease_until FROM (SELECT *, user_id AS owner FROM jobs WHERE id % 2 = 0) b LEFT JOIN (SELECT k, user_id AS owner, count(*) AS n FROM jobs WHERE id % 2 = 1 AND status = 'processing' GROUP BY ALL) c ON c.k = b.k AND c.owner = b.owner"
)
def lease_renewals(spark, d):
    rows = t.jobs(spark, d)
    claimed = rows.where("id % 2 = 1").selectExpr("k as key", "user_id as owner", "if(status = 'processing', 'claimed', 'done') as status", "created_at as lease_until")
    return queues.renewals(rows.where("id % 2 = 0").selectExpr("k as key", "id", "user_id as owner", "created_at as at"), claimed).drop("key")


DONE = "CASE WHEN id % 7 = 0 THEN 'cancelled' ELSE status END"
STATE = "CASE id % 4 WHEN 0 THEN 'indexed' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' END"


@query(
    f"""SELECT id, outcome, CASE WHEN outcome = 'pending' THEN TIMESTAMP '{NOW}' + CAST(least(30, pow(2, greatest(attempts, 1))) AS INTEGER) * INTERVAL 1 MINUTE END AS available_at FROM (
 SELECT id, attempts, CASE WHEN s IN ('succeeded', 'cancelled') THEN 'noop' WHEN a IS NULL THEN 'cancelled' WHEN a = 'indexed' THEN 'succeeded' WHEN a = 'failed' OR attempts >= 3 THEN 'failed' ELSE 'pending' END AS outcome FROM (SELECT *, {DONE} AS s, {STATE} AS a FROM jobs))"""
)
def job_completion(spark, d):
    return queues.completed(t.jobs(spark, d).selectExpr("id", f"{DONE} as status", "attempts", f"{STATE} as attachment_status"), NOW)


@query(
    """SELECT id, event_id, connection_id, job_type, page_id FROM (SELECT *, row_number() OVER (PARTITION BY connection_id, job_type, page_id ORDER BY id) AS m FROM (
 SELECT *, CASE WHEN event_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY event_id ORDER BY id) END AS n FROM asked a WHERE event_id IS NULL OR event_id NOT IN (SELECT event_id FROM had WHERE event_id IS NOT NULL)) f
 WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM had h WHERE h.status IN ('pending', 'processing') AND h.connection_id = f.connection_id AND h.job_type = f.job_type AND h.page_id IS NOT DISTINCT FROM f.page_id)) WHERE m = 1""",
    "sync AS (SELECT id, CASE WHEN id % 3 <> 0 THEN k * 10 + id % 4 END AS event_id, user_id AS connection_id, event_type AS job_type, CASE WHEN id % 5 <> 0 THEN k END AS page_id, status FROM jobs)",
    "asked AS (SELECT * FROM sync WHERE id % 10 >= 6)",
    "had AS (SELECT * FROM sync WHERE id % 10 < 6)",
)
def sync_enqueue(spark, d):
    rows = t.jobs(spark, d).selectExpr("id", "case when id % 3 <> 0 then k * 10 + id % 4 end as event_id", "user_id as connection_id", "event_type as job_type", "case when id % 5 <> 0 then k end as page_id", "status")
    return queues.enqueued(rows.where("id % 10 >= 6").drop("status"), rows.where("id % 10 < 6"))


@query(
    f"""SELECT id, owner, outcome, CASE WHEN outcome = 'retry' THEN TIMESTAMP '{NOW}' + CAST(least(300, 15 * pow(2, greatest(tries - 1, 0))) AS INTEGER) * INTERVAL 1 SECOND END AS available_at FROM (
 SELECT id, id % 5 AS owner, tries, CASE WHEN NOT (id % 5 = user_id % 5 AND status = 'processing' AND created_at + INTERVAL 10 DAY > TIMESTAMP '{NOW}') THEN 'lost' WHEN id % 2 = 0 THEN 'succeeded' WHEN tries < 6 THEN 'retry' ELSE 'failed' END AS outcome FROM (SELECT *, attempts * 2 AS tries FROM jobs))"""
)
def sync_finalise(spark, d):
    rows = t.jobs(spark, d)
    held = rows.selectExpr("id", "user_id % 5 as owner", "status", "created_at + interval 10 days as lease_until", "attempts * 2 as attempts")
    return queues.finalised(rows.selectExpr("id", "id % 5 as owner", "id % 2 = 0 as ok"), held, NOW)


TITLE = "regexp_replace(split_part(content, chr(10), 1), '^\\s+|\\s+$', '', 'g')"


@query(
    f"""SELECT id, md5(body) AS body, substr(body, 1, 260) AS snippet, md5(every) AS embedded, substr(CASE WHEN hidden = '' THEN '记录' ELSE hidden END, 1, 120) AS shown FROM (
 SELECT id, regexp_replace(CASE WHEN title = '' THEN content ELSE substr(content, 1, instr(content, title) - 1) || substr(content, instr(content, title) + length(title)) END, '^\\s+|\\s+$', '', 'g') AS body,
  regexp_replace(CASE WHEN title = '' THEN content ELSE replace(content, title, '') END, '^\\s+|\\s+$', '', 'g') AS every,
  regexp_replace(regexp_replace(regexp_replace(CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN ' 记录 # ' || id ELSE CASE WHEN id % 4 = 2 THEN '记录#12 ' ELSE '' END || title END, '\\s+', ' ', 'g'), '记录\\s*#\\s*\\d+', '记录', 'g'), '^\\s+|\\s+$', '', 'g') AS hidden
 FROM (SELECT id, content, {TITLE} AS title FROM entries))"""
)
def titles_and_bodies(spark, d):
    said = F.expr("case id % 4 when 0 then '' when 1 then concat(' 记录 # ', id) when 2 then concat('记录#12 ', t) else t end")
    rows = t.entries(spark, d).withColumn("t", tx.first_line(F.col("content")))
    return rows.select("id", F.md5(tx.body(F.col("content"))).alias("body"), tx.snippet(F.col("content")).alias("snippet"), F.md5(tx.embedding_body(F.col("content"))).alias("embedded"), tx.public_title(said).alias("shown"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 6 = 5 THEN NULL ELSE len(embedding) END AS n, CASE WHEN vec_id % 6 <> 5 THEN round(CAST(embedding[1] AS DOUBLE), 5) END AS first FROM embeddings")
def vector_parse(spark, d):
    raw = F.to_json(F.col("embedding"))
    again = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    kind = F.col("vec_id") % 6
    text = F.when(kind == 5, F.concat(F.lit("not "), raw)).when(kind == 4, again(again(raw))).when(kind == 3, again(raw)).otherwise(raw)
    v = tx.vector_from(text)
    return t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.size(v).alias("n"), F.round(F.get(v, F.lit(0)), 5).alias("first")).withColumn("n", F.when(F.col("first").isNotNull(), F.col("n")))


@query("SELECT id, CASE WHEN id % 5 <> 4 THEN id END AS value FROM entries")
def json_extraction(spark, d):
    text = F.expr("""case id % 5 when 0 then concat('{"v": ', id, '}') when 1 then concat('Here it is:\n```json\n{"v": ', id, '}\n```\nDone.') when 2 then concat('So {"v": ', id, '} it is') when 3 then concat('  {"v":', id, ', "w": {"x": 1}} ') else '{"v": ' end""")
    return t.entries(spark, d).select("id", F.try_variant_get(F.try_parse_json(tx.json_in(text)), "$.v", "bigint").alias("value"))


EVIDENCE_TERMS = ["nicht", "pour", "the"]
PLACE = lambda start: f"(SELECT min(p) FROM (SELECT unnest([{', '.join(f'instr(substr(low, {start} + 1), {chr(39)}{x}{chr(39)})' for x in EVIDENCE_TERMS)}]) AS p) WHERE p > 0) + {start} - 1"
CUT = lambda at: f"substr(\"both\", greatest({at} - 180, 0) + 1, least({at} + 180, length(\"both\")) - greatest({at} - 180, 0))"


@query(
    """SELECT id, mode, title_hits, body_hits, term_hits, coverage, substr(shown, 1, 1400) AS evidence FROM (SELECT *, CASE WHEN mode = 'short_full_body' OR size = 0 THEN 1.0 WHEN mode = 'dense_stratified_segments' THEN round(least(size, 1385) / size::DOUBLE, 4) ELSE round(least(least(length(shown), 1400), size) / size::DOUBLE, 4) END AS coverage FROM shown)""",
    f"ev0 AS (SELECT id, id % 2 = 0 AS dense, content AS text, length(content) AS size, CASE WHEN title = '' THEN '记录' ELSE substr(title, 1, 120) END AS title FROM (SELECT id, content, regexp_replace(regexp_replace({TITLE}, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS title FROM entries))",
    "ev1 AS (SELECT *, title || chr(10) || text AS \"both\", lower(title || chr(10) || text) AS low, len(list_filter(['nicht', 'pour', 'the'], lambda x: contains(lower(title), x))) AS title_hits, len(list_filter(['nicht', 'pour', 'the'], lambda x: contains(lower(text), x))) AS body_hits FROM ev0)",
    f"ev2 AS (SELECT *, {PLACE(0)} AS a1 FROM ev1)",
    f"ev3 AS (SELECT *, {PLACE('(least(a1 + 180, length(low)) + 180)')} AS a2 FROM ev2)",
    f"ev4 AS (SELECT *, {PLACE('(least(a2 + 180, length(low)) + 180)')} AS a3 FROM ev3)",
    f"""shown AS (SELECT id, size, title_hits, body_hits, mode, CAST(list_sum(list_transform(['nicht', 'pour', 'the'], lambda x: (length(low) - length(replace(low, x, ''))) // length(x))) AS BIGINT) AS term_hits,
  CASE mode WHEN 'short_full_body' THEN text WHEN 'dense_stratified_segments' THEN array_to_string(list_transform(range(5), lambda i: substr(text, CAST(greatest(size - 277, 0) * i // 4 AS BIGINT) + 1, 277)), ' … ')
  ELSE (SELECT string_agg(p, ' … ' ORDER BY n) FROM (SELECT p, min(n) AS n FROM (SELECT unnest(parts) AS p, generate_subscripts(parts, 1) AS n) WHERE p <> '' GROUP BY p)) END AS shown
 FROM (SELECT *, CASE WHEN size > 0 AND size <= 400 THEN 'short_full_body' WHEN title_hits + body_hits = 0 AND dense AND size > 400 THEN 'dense_stratified_segments' ELSE 'title_opening_windows' END AS mode,
  list_transform(list_filter([substr(text, 1, 160), CASE WHEN a1 IS NULL THEN substr("both", 1, 360) ELSE {CUT('a1')} END, CASE WHEN a2 IS NOT NULL THEN {CUT('a2')} END, CASE WHEN a3 IS NOT NULL THEN {CUT('a3')} END], lambda x: x IS NOT NULL), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS parts FROM ev4))""",
)
def judge_evidence(spark, d):
    rows = t.entries(spark, d).select("id", tx.first_line(F.col("content")).alias("title"), F.col("content").alias("text"), (F.col("id") % 2 == 0).alias("dense"))
    return answers.judge_evidence(rows, EVIDENCE_TERMS)


@query("SELECT id, CASE WHEN id % 2 = 0 THEN '标题直接命中检索主题' WHEN id % 3 = 0 AND id % 5 >= 2 THEN '正文多处涉及检索主题' WHEN id % 3 = 0 THEN '正文包含相关内容' WHEN id % 7 >= 5 THEN '内容较完整地覆盖检索主题' ELSE '内容与检索主题相关' END AS reason FROM entries")
def relevance_reasons(spark, d):
    return t.entries(spark, d).select("id", answers.relevance_reason(F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("id") % 5, F.col("id") % 7 / 10).alias("reason"))


@query(
    """SELECT id, CASE WHEN id % 3 = 0 THEN '为你筛选到以下相关记录。' || CASE WHEN id % 5 = 0 THEN '' ELSE chr(10) || CASE WHEN id % 5 = 1 THEN '这里是相关记录，相关记录' ELSE '答案 ' || CAST(id AS VARCHAR) || ' x' END END ELSE CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN '这里是全部相关的记录，列出所有。' ELSE '答案 ' || CAST(id AS VARCHAR) || '  x' END END AS answer FROM entries"""
)
def scoped_answers(spark, d):
    said = F.expr("case when id % 5 = 0 then ' ' when id % 5 = 1 then '这里是全部相关的记录，列出所有。' else concat('答案 ', id, '  x') end")
    return t.entries(spark, d).select("id", answers.scoped(said, F.lit("lookup_all"), F.expr("if(id % 3 = 0, 'budget_filtered', 'complete')")).alias("answer"))


@query("SELECT item_id AS query_id, 'answer_content' AS operation, CASE WHEN item_id % 3 = 0 THEN trim(substr(text, 1, 20), ' ') WHEN item_id % 3 = 1 THEN text END AS topic, NULL AS named_source, 'answer' AS presentation FROM (SELECT item_id, trim(text, ' ') AS text FROM benchmark)")
def fallback_plan(spark, d):
    text = F.when(F.col("item_id") % 3 != 2, F.col("text")).otherwise("  ")
    topic = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" "), F.substring("text", 1, 20)))
    return catalog.fallback_plans(t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"), topic.alias("topic")))


@query("SELECT 'entry:' || CAST(id AS VARCHAR) AS reference_key, 'entry' AS source_type, label_code AS label_name FROM entries")
def public_references(spark, d):
    rows = t.entries(spark, d).select(F.concat(F.lit("entry:"), F.col("id").cast("string")).alias("reference_key"), F.lit("entry").alias("source_type"), F.col("label_code").alias("label_name"), "user_id", F.col("content").alias("judge_evidence"))
    return catalog.public_view(rows)


@query("SELECT vec_id AS id, CASE vec_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'slides' WHEN 2 THEN 'image' END AS extractor FROM embeddings")
def attachment_extractors(spark, d):
    kind = F.expr("element_at(array('application/pdf', 'application/vnd.openxmlformats-officedocument.presentationml.presentation', ' image/PNG', 'text/plain', null), cast(vec_id % 5 + 1 as int))")
    return sync.extractors(t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), kind.alias("mime_type")))
