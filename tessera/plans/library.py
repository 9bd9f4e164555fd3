"""Queries over entries, labels and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import analytics as a
from tessera.plans.registry import query
from tessera.sources import tables as t

CLOCK = t.ENTRY_CLOCK
USERS = list(range(8))
LEXICON = ["the and", "nicht", "pour", "para", "worthless", "src1"]
TERMS = ["the", "and", "nicht", "pour"]
LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
SINCE = lambda days: f"TIMESTAMP '{CLOCK}' - INTERVAL {days} DAY"


@query("SELECT user_id, label_code, count(*) AS n FROM entries GROUP BY ALL")
def label_counts(spark, d):
    return a.label_counts(t.entries(spark, d))


@query("SELECT u.user_id, code, name, row_number() OVER (PARTITION BY u.user_id ORDER BY code) - 1 AS sort_order, (SELECT count(*) FROM entries e WHERE e.user_id = u.user_id AND e.label_code = l.code) AS n FROM entry_labels l, (SELECT unnest(range(8)) AS user_id) u")
def label_list_counts(spark, d):
    return a.label_list(t.entry_labels(spark, d), t.entries(spark, d), USERS)


@query(
    "SELECT user_id, max(n) FILTER (kind = 'entries') AS entries, coalesce(max(n) FILTER (kind = 'roots'), 0) AS root_todos, coalesce(max(n) FILTER (kind = 'open'), 0) AS open_root_todos, coalesce(max(n) FILTER (kind = 'vectors'), 0) AS vectors FROM (SELECT user_id, 'entries' AS kind, count(*) AS n FROM entries GROUP BY user_id UNION ALL SELECT user_id, 'roots', count(*) FROM todos WHERE parent_id IS NULL GROUP BY user_id UNION ALL SELECT user_id, 'open', count(*) FROM todos WHERE parent_id IS NULL AND NOT is_done GROUP BY user_id UNION ALL SELECT user_id, 'vectors', count(*) FROM entries JOIN vectors USING (id) GROUP BY user_id) WHERE user_id < 8 GROUP BY user_id"
)
def database_catalog(spark, d):
    """Counts of entries, root tasks, open root tasks and vectors of each user who may have entries (A3)."""
    e, todos = t.entries(spark, d), t.todos(spark, d).where("parent_id is null")
    counts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"))
    tasks = todos.groupBy("user_id").agg(F.count(F.lit(1)).alias("root_todos"), F.count_if(~F.col("is_done")).alias("open_root_todos"))
    has = e.join(t.content_vectors(spark, d).select("id"), "id").groupBy("user_id").agg(F.count(F.lit(1)).alias("vectors"))
    return counts.join(tasks, "user_id", "left").join(has, "user_id", "left").na.fill(0)


@query(f"SELECT user_id, label_code, n, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM (SELECT user_id, label_code, count(*) AS n FROM entries WHERE created_at >= {SINCE(7)} GROUP BY ALL)")
def label_stats_window(spark, d):
    return a.window_stats(t.entries(spark, d), CLOCK, 7)


@query(f"SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM entries WHERE created_at >= {SINCE(30)} GROUP BY ALL")
def timeline_daily(spark, d):
    return a.timeline(t.entries(spark, d), CLOCK)


@query(
    """SELECT c.user_id, c.label_code, c.n, c.rank, CASE WHEN c.rank <= 4 THEN s.newest END AS newest
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, label_code) AS rank FROM (SELECT user_id, label_code, count(*) AS n FROM entries GROUP BY ALL)) c
LEFT JOIN (SELECT user_id, label_code, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) AS newest FROM (SELECT user_id, label_code, id, row_number() OVER (PARTITION BY user_id, label_code ORDER BY created_at DESC, id DESC) AS k FROM entries) WHERE k <= 2 GROUP BY ALL) s
ON s.user_id = c.user_id AND s.label_code = c.label_code WHERE c.rank <= 12"""
)
def knowledge_clusters(spark, d):
    return a.clusters(t.entries(spark, d))


@query(
    f"SELECT user_id, rank, id, terms FROM (SELECT user_id, id, terms, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM (SELECT user_id, id, created_at, array_to_string(list_filter({LIST(LEXICON)}, lambda x: contains(lower(concat_ws(chr(10), content, label_code, l.name)), x)), ',') AS terms FROM entries LEFT JOIN entry_labels l ON l.code = label_code WHERE created_at >= {SINCE(30)}) WHERE terms <> '') WHERE rank <= 10"
)
def lexicon_match(spark, d):
    return a.lexicon_hits(t.entries(spark, d), t.entry_labels(spark, d), LEXICON, CLOCK)


@query(
    """SELECT p.user_id, position, p.id, p.label_code, total, coalesce(children, '') AS children
FROM (SELECT user_id, id, label_code, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM entries WHERE parent_id IS NULL) p
LEFT JOIN (SELECT parent_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) AS children FROM entries WHERE parent_id IS NOT NULL GROUP BY parent_id) c ON c.id = p.id WHERE position > 10 AND position <= 30"""
)
def entry_list_page(spark, d):
    entries = t.entries(spark, d)
    return a.entry_page(entries, a.listed(entries, t.entry_labels(spark, d)), 10, 20)


@query(
    """SELECT p.user_id, position, p.id, p.label_code, total, coalesce(children, '') AS children
FROM (SELECT user_id, id, label_code, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM entries LEFT JOIN entry_labels l ON l.code = label_code
 WHERE parent_id IS NULL AND label_code = 'src3' AND (lower(content) LIKE '%the%' OR lower(content) LIKE '%nicht%' OR lower(label_code) LIKE '%zzz%' OR lower(l.name) LIKE '%zzz%')) p
LEFT JOIN (SELECT parent_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) AS children FROM entries WHERE parent_id IS NOT NULL GROUP BY parent_id) c ON c.id = p.id WHERE position <= 20"""
)
def entry_list_filtered(spark, d):
    entries = t.entries(spark, d)
    return a.entry_page(entries, a.listed(entries, t.entry_labels(spark, d), "src3", ["the", "nicht", "zzz"]), 0, 20)


@query("SELECT e.id, p.id AS parent, g.id AS grandparent, coalesce(g.id, p.id, e.id) AS root FROM entries e LEFT JOIN entries p ON p.id = e.parent_id LEFT JOIN entries g ON g.id = p.parent_id")
def entry_parent_context(spark, d):
    return a.parents(t.entries(spark, d))


@query("SELECT id, user_id FROM entries WHERE id NOT IN (SELECT id FROM vectors)")
def entries_missing_embeddings(spark, d):
    return a.without_vectors(t.entries(spark, d), t.content_vectors(spark, d))


@query("SELECT session_id, turn, role, length(content) AS chars FROM messages m WHERE turn = (SELECT max(turn) FROM messages x WHERE x.session_id = m.session_id)")
def session_latest_message(spark, d):
    return a.latest_messages(t.messages(spark, d))


@query("SELECT user_id, session_id, count(*) AS n, count(*) FILTER (role = 'user') AS from_user, max(turn) AS last_turn, count(*) >= 100 AS \"full\" FROM messages GROUP BY user_id, session_id")
def session_list(spark, d):
    return a.sessions(t.messages(spark, d))


@query(
    f"SELECT user_id, session_id, turn, round(hits / 4.0, 6)::DOUBLE AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY session_id DESC, turn DESC) AS k FROM (SELECT user_id, session_id, turn, len(list_filter({LIST(TERMS)}, lambda x: contains(lower(content), x))) AS hits FROM messages) WHERE hits > 0) WHERE k <= 8"
)
def session_like_search(spark, d):
    return a.like_relevance(t.messages(spark, d), TERMS)


@query(
    """SELECT session_id, len(s) AS n, array_to_string(CASE WHEN len(s) > 6 THEN s[1:3] || ['...'] || s[-2:] ELSE s END, ' | ') AS summary
FROM (SELECT session_id, list(sentence ORDER BY turn) AS s FROM (SELECT session_id, turn, role, substr(trim(regexp_extract(content, '^[^.!?\\n]*[.!?]?'), ' '), 1, 200) AS sentence, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM messages) WHERE k <= 30 AND role = 'user' AND sentence <> '' GROUP BY session_id)"""
)
def conversation_summary(spark, d):
    return a.first_sentences(t.messages(spark, d))
