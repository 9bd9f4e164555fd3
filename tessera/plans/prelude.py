"""The data model as DuckDB views in a WITH clause, for the SQL that results are compared with."""

ENTITIES = """
entries AS (
  SELECT doc_id AS id, doc_id % 8 AS user_id, CASE WHEN doc_id % 5 IN (1, 2) THEN doc_id - doc_id % 5 END AS parent_id,
         source AS label_code, lang, text AS content, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS created_at
  FROM documents),
entry_labels AS (SELECT DISTINCT source AS code, upper(source) AS name FROM documents WHERE source IS NOT NULL),
todos AS (
  SELECT o.o_orderkey AS id, p.o_orderkey AS parent_id, (o.o_orderkey // 4) % 50 AS user_id,
         CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE o.o_orderkey % 5 END AS sort_order,
         o.o_orderpriority AS content,
         'P' || CAST(CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) - 1 AS VARCHAR) AS priority,
         substr(o.o_orderpriority, 1, 1) = '1' AS is_urgent, o.o_orderstatus = 'F' AS is_done,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 30 AS INTEGER) END AS due_date,
         CAST(o.o_orderdate AS DATE) AS created_on,
         CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 13 <> 0 THEN CAST(o.o_orderdate AS DATE) + CAST(o.o_orderkey % 9 AS INTEGER) END AS completed_on
  FROM orders o LEFT JOIN orders p ON o.o_orderkey % 4 <> 0 AND p.o_orderkey = o.o_orderkey - 1),
plan_items AS (
  SELECT l_orderkey AS todo_id, CAST(l_shipdate AS DATE) AS plan_date,
         min(CASE l_returnflag WHEN 'N' THEN 'active' WHEN 'A' THEN 'completed' ELSE CASE l_linestatus WHEN 'O' THEN 'carried' ELSE 'returned' END END) AS status,
         l_orderkey * 100000 + (CAST(l_shipdate AS DATE) - DATE '1990-01-01') AS id
  FROM lineitem GROUP BY l_orderkey, CAST(l_shipdate AS DATE)),
closure AS (
  SELECT id, user_id, id AS ancestor, 0 AS distance FROM todos
  UNION ALL SELECT t.id, t.user_id, a.id, 1 FROM todos t JOIN todos a ON t.parent_id = a.id
  UNION ALL SELECT t.id, t.user_id, b.id, 2 FROM todos t JOIN todos a ON t.parent_id = a.id JOIN todos b ON a.parent_id = b.id
  UNION ALL SELECT t.id, t.user_id, c.id, 3 FROM todos t JOIN todos a ON t.parent_id = a.id JOIN todos b ON a.parent_id = b.id JOIN todos c ON b.parent_id = c.id),
vectors AS (
  SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS content_vector, CAST(coalesce(n.embedding, e.embedding) AS DOUBLE[]) AS title_vector, e.label
  FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1),
query_vectors AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query_vector, label AS query_label FROM embeddings WHERE vec_id % 100 = 0),
messages AS (SELECT conv_id AS session_id, turn, role, text AS content, conv_id % 8 AS user_id FROM conversations),
site_pages AS (
  SELECT page_id AS id, CASE WHEN page_id % 4 <> 0 THEN page_id - 1 END AS parent_id, page_id % 8 AS user_id, url,
         split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(split_part(url, '://', 2), '/', 2) AS lang,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html,
         CASE page_id % 6 WHEN 0 THEN 'indexed' WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' WHEN 3 THEN 'syncing' WHEN 4 THEN 'deleted' ELSE 'pending' END AS sync_status
  FROM pages),
jobs AS (
  SELECT event_id AS id, user_id, ts AS created_at, event_type,
         CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status,
         CAST(event_id % 4 AS INTEGER) AS attempts, CAST(event_id % 3 AS INTEGER) AS priority, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
term_queries AS (
  SELECT item_id AS query_id, list(w ORDER BY p) AS terms FROM (
    SELECT item_id, w, min(p) AS p FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9äöüßéèêçàáíóúñ]+'), lambda w: length(w) >= 4)[1:3]) AS w, generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9äöüßéèêçàáíóúñ]+'), lambda w: length(w) >= 4)[1:3], 1) AS p FROM benchmark WHERE item_id % 100 = 0) GROUP BY item_id, w)
  GROUP BY item_id),
rankings AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, list_idx ORDER BY draw, doc_id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY draw, doc_id) AS idx FROM (
    SELECT doc_id, doc_id // 100 AS query_id, CAST(doc_id % 4 AS INTEGER) AS list_idx, (doc_id * 37) % 1009 AS draw,
      'note:' || (['chunk', 'source', 'entry', 'page'])[(doc_id * 3) % 4 + 1] || ':' || CAST((doc_id * 31) % 13 AS VARCHAR) AS key,
      'o' || CAST((doc_id * 31) % 23 AS VARCHAR) AS origin, CAST((doc_id * 53) % 1000 AS DOUBLE) / 1000 AS score,
      (['lexical', 'knowledge', 'entry', 'attachment', 'other'])[(doc_id * 7) % 5 + 1] AS channel,
      CASE WHEN (doc_id * 11) % 3 = 0 THEN 'attachment_chunk' ELSE 'mirror' END AS source_type FROM documents))
"""


def with_entities(body: str, *more: str) -> str:
    """A query over the entities; ``more`` are further common tables, in order."""
    return "WITH " + ",\n".join([ENTITIES.strip(), *more]) + "\n" + body
