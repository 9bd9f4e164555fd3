"""Queries of hybrid search and lookup over all channels.

Rows of the vector table are dealt to three sources: entries (id % 3 = 1, by title and content), chunks of the entry
before (id % 3 = 2), and attachments of the entry id / 2 (id % 3 = 0).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import pools as p
from tessera.operators import retrieval as r
from tessera.plans import search as s
from tessera.plans.families import TITLE
from tessera.plans.registry import query
from tessera.sources import tables as t


def named(prefix, column="id"):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def part(rows, number, key, origin, source_type, score, channel="lexical", given=None):
    """Hits of a channel in the form that pools take."""
    given = F.lit(None).cast("long") if given is None else given
    return rows.select("query_id", F.lit(number).alias("part"), "rank", key.alias("key"), origin.alias("origin"), F.lit(source_type).alias("source_type"), score.cast("double").alias("score"), F.lit(channel).alias("channel"), given.alias("given"))


def entry_hits(spark, d, number, k):
    rows = r.entry_dense(t.query_vectors(spark, d), t.vectors(spark, d).where("id % 3 = 1"), k=k)
    return part(rows, number, named("entry:"), named("e"), "entry", F.col("score"), "entry_dense", F.col("rank"))


def chunk_hits(spark, d, number, k):
    rows = r.dense(t.query_vectors(spark, d), t.content_vectors(spark, d).where("id % 3 = 2"), k=k).withColumn("entry", F.col("id") - 1)
    return part(rows, number, named("chunk:"), named("e", "entry"), "knowledge_source", F.col("score"), "knowledge_dense")


def file_hits(spark, d, number, k):
    rows = r.dense(t.query_vectors(spark, d), t.content_vectors(spark, d).where("id % 3 = 0"), k=k).withColumn("entry", F.expr("id div 2"))
    return part(rows, number, named("attachment:"), named("e", "entry"), "attachment_chunk", F.col("score"), "attachment_dense")


def task_hits(spark, d, number, k):
    return part(r.lexical(t.term_queries(spark, d), t.todos(spark, d), k=k), number, named("todo:"), named("t"), "todo", F.lit(1.0))


def page_hits(spark, d, number, k):
    return part(r.page_lexical(t.term_queries(spark, d), t.pages(spark, d), k=k), number, named("page:"), named("p"), "notion_page", F.col("score"))


def texts(spark, d):
    """What candidates say: (key, title, text)."""
    own = t.entries(spark, d).select("id", tx.first_line(F.col("content")).alias("title"), F.col("content").alias("text"))
    entries = own.select(named("entry:").alias("key"), "title", "text")
    chunks = own.select(F.concat(F.lit("chunk:"), (F.col("id") + 1).cast("string")).alias("key"), "title", "text")
    tasks = t.todos(spark, d).select(named("todo:").alias("key"), F.col("content").alias("title"), F.col("content").alias("text"))
    pages = t.pages(spark, d).select(named("page:").alias("key"), "title", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return entries.unionByName(chunks).unionByName(tasks).unionByName(pages)


def parents(spark, d):
    return t.entries(spark, d).where("parent_id is not null").select(named("entry:").alias("key"), named("entry:", "parent_id").alias("parent"))


VECTOR_HITS = (
    s.DENSE,
    s.MIX,
    f"""entry_hits AS (SELECT query_id, {s.RANKED} AS rank, 'entry:' || CAST(id AS VARCHAR) AS key, 'e' || CAST(id AS VARCHAR) AS origin, 'entry' AS source_type, score FROM (SELECT *, {s.RANKED} AS n FROM
 (SELECT query_id, id, round(list_inner_product(m, query_vector) / sqrt(list_inner_product(m, m)) / sqrt(list_inner_product(query_vector, query_vector)), 6) AS score FROM mix WHERE id % 3 = 1)) WHERE n <= 240 AND score >= 0.35)""",
    f"chunk_hits AS (SELECT query_id, {s.RANKED} AS rank, 'chunk:' || CAST(id AS VARCHAR) AS key, 'e' || CAST(id - 1 AS VARCHAR) AS origin, 'knowledge_source' AS source_type, score FROM dense WHERE id % 3 = 2 AND score >= 0.35)",
    f"file_hits AS (SELECT query_id, {s.RANKED} AS rank, 'attachment:' || CAST(id AS VARCHAR) AS key, 'e' || CAST(id // 2 AS VARCHAR) AS origin, 'attachment_chunk' AS source_type, score FROM dense WHERE id % 3 = 0 AND score >= 0.35)",
)
WORD_HITS = (
    s.LEX,
    s.PAGE_LEX,
    "task_lex AS (SELECT query_id, id, len(list_filter(terms, lambda x: contains(lower(content), x))) AS body_hits FROM todos, term_queries)",
    "task_hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY body_hits DESC, id) AS rank, 'todo:' || CAST(id AS VARCHAR) AS key, 't' || CAST(id AS VARCHAR) AS origin, 'todo' AS source_type, 1.0::DOUBLE AS score FROM task_lex WHERE body_hits > 0)",
    f"page_hits AS (SELECT query_id, {s.RANKED} AS rank, 'page:' || CAST(id AS VARCHAR) AS key, 'p' || CAST(id AS VARCHAR) AS origin, 'notion_page' AS source_type, score::DOUBLE AS score FROM page_lex WHERE score > 0)",
)


def joined_sql(name, *parts):
    """Parts one after another, one row for each origin."""
    union = " UNION ALL ".join(f"SELECT *, {i} AS part FROM ({q})" for i, q in enumerate(parts))
    return (
        f"{name}_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, key) AS place FROM ({union}))",
        f"{name} AS (SELECT *, min(place) OVER (PARTITION BY query_id, origin) AS first FROM {name}_all QUALIFY row_number() OVER (PARTITION BY query_id, origin ORDER BY CASE WHEN source_type = 'attachment_chunk' THEN 0 ELSE 1 END, place) = 1)",
    )


HIT = "query_id, rank, key, origin, source_type, score"
HYBRID = (
    *VECTOR_HITS,
    *WORD_HITS,
    "word_hits AS (" + s.KEYWORD_SQL + ")",
    *joined_sql("own", f"SELECT {HIT} FROM chunk_hits WHERE rank <= 30", f"SELECT {HIT} FROM entry_hits WHERE rank <= 30"),
    *joined_sql("files", f"SELECT {HIT} FROM file_hits WHERE rank <= 10"),
    f"""hybrid_lists AS (SELECT query_id, 0 AS list_idx, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank, key, origin, source_type, score FROM own
 UNION ALL SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, key), key, origin, source_type, score FROM (
  SELECT query_id, 0 AS part, rank, 'entry:' || CAST(id AS VARCHAR) AS key, 'e' || CAST(id AS VARCHAR) AS origin, 'entry' AS source_type, score FROM word_hits
  UNION ALL SELECT query_id, 1, {HIT.removeprefix('query_id, ')} FROM task_hits WHERE rank <= 30 UNION ALL SELECT query_id, 2, {HIT.removeprefix('query_id, ')} FROM page_hits WHERE rank <= 30)
 UNION ALL SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY first), key, origin, source_type, score FROM files)""",
    "hybrid_sums AS (SELECT query_id, key, arg_min(origin, row(list_idx, rank)) AS origin, arg_min(source_type, row(list_idx, rank)) AS source_type, round(sum(([1.0, 0.9, 0.85])[list_idx + 1] / (60 + rank)), 9) AS rrf, min(row(list_idx, rank)) AS first, count(DISTINCT list_idx) AS lists FROM hybrid_lists GROUP BY query_id, key)",
    "hybrid_best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, key) AS n FROM hybrid_sums QUALIFY n <= 15)",
    "hybrid_rows AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position, key, origin, rrf, CASE WHEN lists > 1 THEN 'hybrid_rrf' ELSE 'single' END AS source_reason FROM (SELECT *, min(n) OVER (PARTITION BY query_id, origin) AS place FROM hybrid_best QUALIFY row_number() OVER (PARTITION BY query_id, origin ORDER BY CASE WHEN source_type = 'attachment_chunk' THEN 0 ELSE 1 END, n) = 1))",
    f"""seen_files AS (SELECT query_id, 'e' || CAST(id // 2 AS VARCHAR) AS origin, max(score) AS score, arg_max('attachment:' || CAST(id AS VARCHAR), row(score, 'attachment:' || CAST(id AS VARCHAR))) AS key FROM (SELECT query_id, id, round({s.COS('title_vector', 'query_vector')}, 6) AS score FROM dense WHERE id % 3 = 0) WHERE score >= 0.25 GROUP BY ALL)""",
    """visual_tail AS (SELECT query_id, coalesce(last, 0) + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, origin) AS position, key, origin, 0.0::DOUBLE AS rrf, 'visual' AS source_reason, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, origin) AS n
 FROM (SELECT * FROM seen_files f WHERE NOT EXISTS (SELECT 1 FROM hybrid_rows h WHERE h.query_id = f.query_id AND h.origin = f.origin)) LEFT JOIN (SELECT query_id, max(position) AS last FROM hybrid_rows GROUP BY query_id) USING (query_id) QUALIFY n <= 3)""",
    "hybrid_found AS (SELECT query_id, position, key, origin, rrf, source_reason FROM hybrid_rows UNION ALL SELECT query_id, position, key, origin, rrf, source_reason FROM visual_tail)",
)


def hybrid_of(spark, d, k=15):
    own = chunk_hits(spark, d, 0, 30).unionByName(entry_hits(spark, d, 1, 30))
    said = r.keyword(t.term_queries(spark, d), t.entries(spark, d), s.CLOCK)
    words = part(said, 0, named("entry:"), named("e"), "entry", F.col("score")).unionByName(task_hits(spark, d, 1, 30)).unionByName(page_hits(spark, d, 2, 30))
    # A picture's own vector is what the model of titles has for it.
    pictures = t.vectors(spark, d).where("id % 3 = 0").select("id", F.col("title_vector").alias("content_vector"))
    seen = r.dense(t.query_vectors(spark, d), pictures, k=1000, least=0.25).withColumn("entry", F.expr("id div 2"))
    visual = seen.select("query_id", named("attachment:").alias("key"), named("e", "entry").alias("origin"), "score")
    return p.hybrid(own, words, file_hits(spark, d, 0, 10), visual, k)


@query(
    "SELECT h.query_id, h.position, h.key, h.rrf, h.source_reason, CASE WHEN e.parent_id IS NOT NULL THEN 'entry:' || CAST(e.parent_id AS VARCHAR) END AS parent FROM hybrid_found h LEFT JOIN entries e ON h.key = 'entry:' || CAST(e.id AS VARCHAR)",
    *HYBRID,
)
def hybrid_pipeline(spark, d):
    """The whole search (R30): vector hits of chunks and entries, words in entries, tasks and pages as one list,
    attachments; fused, mirrors merged, a visual tail, and parents (J12)."""
    return hybrid_of(spark, d).join(parents(spark, d), "key", "left").select("query_id", "position", "key", "rrf", "source_reason", "parent")


LOOKUP = (
    *VECTOR_HITS,
    *WORD_HITS,
    s.SCANNED.format(2000),
    *joined_sql(
        "pool",
        f"SELECT query_id, {s.BY_HITS} AS rank, 'entry:' || CAST(id AS VARCHAR) AS key, 'e' || CAST(id AS VARCHAR) AS origin, 'entry' AS source_type, 1.0::DOUBLE AS score, 'lexical' AS channel, NULL::BIGINT AS given FROM scanned WHERE n <= 2000",
        f"SELECT {HIT}, 'lexical' AS channel, NULL::BIGINT AS given FROM task_hits WHERE rank <= 120",
        f"SELECT {HIT}, 'lexical' AS channel, NULL::BIGINT AS given FROM page_hits WHERE rank <= 120",
        f"SELECT {HIT}, 'entry_dense' AS channel, rank AS given FROM entry_hits WHERE rank <= 80",
        f"SELECT {HIT}, 'knowledge_dense' AS channel, NULL::BIGINT AS given FROM chunk_hits WHERE rank <= 80",
        f"SELECT {HIT}, 'attachment_dense' AS channel, NULL::BIGINT AS given FROM file_hits WHERE rank <= 40",
    ),
    f"""pool_texts AS (SELECT 'entry:' || CAST(id AS VARCHAR) AS key, {TITLE} AS title, content AS text FROM entries UNION ALL SELECT 'chunk:' || CAST(id + 1 AS VARCHAR), {TITLE}, content FROM entries
 UNION ALL SELECT 'todo:' || CAST(id AS VARCHAR), content, content FROM todos UNION ALL SELECT 'page:' || CAST(id AS VARCHAR), title, regexp_replace(html, '<[^>]*>', ' ', 'g') FROM site_pages)""",
    """pool_seen AS (SELECT query_id, key, channel, given, score, len(list_filter(terms, lambda x: contains(lower(title), x))) AS title_hits, len(list_filter(terms, lambda x: contains(lower(text), x))) AS body_hits, length(text) AS size,
  CAST(coalesce(list_sum(list_transform(terms, lambda x: (length(title || chr(10) || text) - length(replace(lower(title || chr(10) || text), x, ''))) // length(x))), 0) AS BIGINT) AS term_hits
 FROM (SELECT query_id, key, channel, given, score, coalesce(terms, []) AS terms, coalesce(text, '') AS text, CASE WHEN coalesce(title, '') = '' THEN '记录' ELSE substr(regexp_replace(title, '\\s+', ' ', 'g'), 1, 120) END AS title FROM pool LEFT JOIN pool_texts USING (key) LEFT JOIN term_queries USING (query_id)))""",
    """pool_named AS (SELECT * REPLACE (CASE WHEN channel <> 'lexical' THEN channel WHEN title_hits > 0 THEN 'lexical_title' ELSE 'lexical_body' END AS channel), count(*) OVER (PARTITION BY query_id) > 120 AS cut,
  CASE WHEN size BETWEEN 1 AND 400 THEN 'short_full_body' WHEN title_hits + body_hits = 0 AND channel <> 'lexical' AND size > 400 THEN 'dense_stratified_segments' ELSE 'title_opening_windows' END AS mode FROM pool_seen)""",
    "pool_ranked AS (SELECT *, CASE WHEN cut THEN coalesce(given, row_number() OVER (PARTITION BY query_id, channel ORDER BY given NULLS LAST, score DESC, key)) END AS cr FROM pool_named)",
    "pool_seated AS (SELECT *, cut AND channel IN ('entry_dense', 'knowledge_dense', 'attachment_dense') AND row_number() OVER (PARTITION BY query_id, channel ORDER BY CASE WHEN title_hits > 0 THEN 0 ELSE 1 END, title_hits DESC, body_hits DESC, cr, key) = 1 AS reserved FROM pool_ranked)",
    "pool_chosen AS (SELECT * FROM pool_seated QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reserved THEN 0 ELSE 1 END, CASE WHEN title_hits > 0 THEN 0 ELSE 1 END, title_hits DESC, body_hits DESC, cr, key) <= 120)",
)


def lookup_of(spark, d):
    said = r.lexical(t.term_queries(spark, d), t.entries(spark, d), k=None, budget=2000)
    parts = [
        part(said, 0, named("entry:"), named("e"), "entry", F.lit(1.0)),
        task_hits(spark, d, 1, 120),
        page_hits(spark, d, 2, 120),
        entry_hits(spark, d, 3, 80),
        chunk_hits(spark, d, 4, 80),
        file_hits(spark, d, 5, 40),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return p.lookup(rows, texts(spark, d), t.term_queries(spark, d), parents(spark, d))


@query(
    """SELECT c.query_id, row_number() OVER (PARTITION BY c.query_id ORDER BY CASE WHEN title_hits > 0 THEN 0 ELSE 1 END, title_hits DESC, body_hits DESC, cr, key) AS position, key, channel, CASE WHEN cut THEN 'budget_filtered' ELSE 'exhaustive' END AS scope, reserved, title_hits, body_hits, term_hits, mode,
 CASE WHEN e.parent_id IS NOT NULL THEN 'entry:' || CAST(e.parent_id AS VARCHAR) END AS parent FROM pool_chosen c LEFT JOIN entries e ON c.key = 'entry:' || CAST(e.id AS VARCHAR)""",
    *LOOKUP,
)
def lookup_pool(spark, d):
    """The pool of a lookup (R33): six channels, mirrors merged, evidence, the selection under a budget with seats for
    the dense channels, parents."""
    return lookup_of(spark, d).drop("coverage", "evidence")


@query(
    f"SELECT query_id, 'vector' AS retriever, rank, key FROM entry_hits WHERE rank <= 20 UNION ALL SELECT query_id, 'keyword', rank, 'entry:' || CAST(id AS VARCHAR) FROM word_hits WHERE rank <= 20 UNION ALL SELECT query_id, 'hybrid', position, key FROM hybrid_found WHERE position <= 20",
    *HYBRID,
)
def live_rankings(spark, d):
    """The same queries through three strategies, the first twenty of each (E20): vectors (R15), words (R8), both."""
    one = lambda rows, name, rank="rank": rows.select("query_id", F.lit(name).alias("retriever"), F.col(rank).alias("rank"), "key")
    words = r.keyword(t.term_queries(spark, d), t.entries(spark, d), s.CLOCK, k=30).where("rank <= 20").withColumn("key", named("entry:"))
    return one(entry_hits(spark, d, 0, 20), "vector").union(one(words, "keyword")).union(one(hybrid_of(spark, d).where("position <= 20"), "hybrid", "position"))
