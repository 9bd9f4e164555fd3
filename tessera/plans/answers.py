"""Queries over evidence, citations, budgets, mirrors and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import answers as a
from tessera.operators import sync as s
from tessera.operators.evaluation import shown
from tessera.plans.registry import query
from tessera.sources import tables as t

STOP = ["the", "and", "of"]
TERMS = ["the", "nicht", "pour"]
TERM_COLUMN = lambda: F.array(*[F.lit(x) for x in TERMS])


@query("SELECT item_id AS query_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND w NOT IN ('the', 'and', 'of')))), '|') AS topic FROM benchmark")
def topic_terms(spark, d):
    return t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), a.topic(tx.tokens(F.col("text")), STOP).alias("topic"))


WINDOW = "(SELECT id, content, lower(content) AS low, (SELECT min(p) FROM (SELECT unnest([instr(lower(content), 'the'), instr(lower(content), 'nicht'), instr(lower(content), 'pour')]) AS p) WHERE p > 0) - 1 AS f FROM entries)"


@query(
    f"""SELECT id, CASE WHEN f IS NULL THEN substr(content, 1, 360) ELSE substr(content, greatest(f - 180, 0) + 1, least(f + 180, length(content)) - greatest(f - 180, 0)) END AS "window", f IS NOT NULL AND
 (instr(substr(low, e), 'the') > 0 OR instr(substr(low, e), 'nicht') > 0 OR instr(substr(low, e), 'pour') > 0) AS more FROM (SELECT *, least(f + 180, length(content)) + 181 AS e FROM {WINDOW})"""
)
def term_windows(spark, d):
    found = a.hit_windows(F.col("content"), TERMS)
    # An empty text has no windows; what is shown of it is empty. The windows come first, or they would be made twice.
    first = F.coalesce(F.get(found, F.lit(0)), F.when(F.col("content") == "", ""))
    return t.entries(spark, d).select("id", first.alias("window"), (F.size(found) > 1).alias("more"))


@query("SELECT id, substr('[record] ' || label_code || chr(10) || content, 1, 4000) AS body FROM entries")
def evidence_bodies(spark, d):
    return t.entries(spark, d).select("id", a.body(F.concat(F.lit("[record] "), F.col("label_code")), F.col("content")).alias("body"))


@query("SELECT query_id, key, list_idx AS priority FROM (SELECT *, min(list_idx) OVER (PARTITION BY query_id) AS f FROM rankings WHERE score >= 0.9 AND (doc_id // 100) % 4 <= list_idx) WHERE list_idx = f")
def fallback_cascade(spark, d):
    rows = t.rankings(spark, d).where("score >= 0.9 and query_id % 4 <= list_idx")
    return a.cascade(rows.select("query_id", "key", F.col("list_idx").alias("priority")))


ANSWERS = "answers AS (SELECT query_id, string_agg('claim [S' || CAST(doc_id * 7 % 9 AS VARCHAR) || '] ', '' ORDER BY idx) AS text, query_id % 10 AS sources FROM rankings WHERE idx <= query_id % 5 GROUP BY query_id)"


@query(
    "SELECT query_id, array_to_string(k, ',') AS cited, len(k) AS n, code, code = 'ok' OR sources = 0 AS grounded FROM (SELECT *, CASE WHEN len(u) = 0 THEN 'missing' WHEN len(k) < len(u) THEN 'unknown' ELSE 'ok' END AS code FROM (SELECT *, list_filter(u, lambda i: i >= 1 AND i <= sources) AS k FROM (SELECT query_id, sources, list(i ORDER BY p) AS u FROM (SELECT query_id, sources, i, min(p) AS p FROM (SELECT query_id, sources, unnest(x) AS i, generate_subscripts(x, 1) AS p FROM (SELECT *, list_transform(regexp_extract_all(text, '\\[S([0-9]+)\\]', 1), lambda v: CAST(v AS INTEGER)) AS x FROM answers)) GROUP BY ALL) GROUP BY ALL)))",
    ANSWERS,
)
def citation_check(spark, d):
    rows = t.rankings(spark, d).where("idx <= query_id % 5").withColumn("c", F.expr("concat('claim [S', cast(doc_id * 7 % 9 as string), '] ')"))
    texts = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "c"))), lambda x: x["c"]), "").alias("text"))
    return a.citations(texts, F.col("query_id") % 10)


UNITS = "units AS (SELECT query_id, idx AS rank, doc_id AS id, doc_id * 17 % 1500 AS size, channel = 'lexical' AS reserved FROM rankings)"


@query(
    'SELECT query_id, id, grp AS "group" FROM packed',
    UNITS,
    """packed AS (WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS n FROM units),
  f(query_id, n, id, grp, used) AS (SELECT query_id, n, id, 0, size + 16 FROM u WHERE n = 1
   UNION ALL SELECT u.query_id, u.n, u.id, CASE WHEN f.used + u.size + 16 > 6000 THEN f.grp + 1 ELSE f.grp END, CASE WHEN f.used + u.size + 16 > 6000 THEN u.size + 16 ELSE f.used + u.size + 16 END FROM f JOIN u ON u.query_id = f.query_id AND u.n = f.n + 1) SELECT * FROM f)""",
)
def packed_groups(spark, d):
    """Units packed into groups of characters."""
    return a.packed_groups(t.rankings(spark, d).selectExpr("query_id", "idx as rank", "doc_id as id", "doc_id * 17 % 1500 as size"))


@query(
    "SELECT query_id, rank, id, size FROM fitted WHERE taken",
    UNITS,
    """fitted AS (WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT reserved, rank, id) AS n FROM units),
  f(query_id, n, rank, id, size, used, many, taken) AS (SELECT query_id, n, rank, id, size, size, 1, true FROM u WHERE n = 1
   UNION ALL SELECT u.query_id, u.n, u.rank, u.id, u.size, f.used + CASE WHEN f.many < 20 AND f.used + u.size <= 16000 THEN u.size ELSE 0 END, f.many + CASE WHEN f.many < 20 AND f.used + u.size <= 16000 THEN 1 ELSE 0 END, f.many < 20 AND f.used + u.size <= 16000
   FROM f JOIN u ON u.query_id = f.query_id AND u.n = f.n + 1) SELECT * FROM f)""",
)
def context_budget(spark, d):
    """Units that fit a budget, oversized ones skipped."""
    return a.skipping_budget(t.rankings(spark, d).selectExpr("query_id", "idx as rank", "doc_id as id", "doc_id * 17 % 1500 as size", "channel = 'lexical' as reserved"))


def attempt(shift: int) -> str:
    return f"named_struct('eligible', (id + {shift}) % 3 = 0, 'quality', element_at(array('ok', 'low', 'unusable', 'none'), cast((id * 5 + {shift}) % 4 + 1 as int)), 'score', (id * 3 + {shift}) % 4 / 4.0D, 'confidence', case when (id + {shift}) % 5 = 0 then null else (id + {shift}) % 2 / 2.0D end, 'chars', (id * 11 + {shift} * 3) % 50)"


def attempt_sql(n: str, shift: int) -> str:
    return f"(id + {shift}) % 3 = 0 AS e{n}, CASE (id * 5 + {shift}) % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS q{n}, (id * 3 + {shift}) % 4 AS s{n}, CASE WHEN (id + {shift}) % 5 = 0 THEN -1.0 ELSE (id + {shift}) % 2 / 2.0 END AS c{n}, (id * 11 + {shift} * 3) % 50 AS n{n}"


@query(f"SELECT id, CASE WHEN CASE WHEN e1 <> e2 THEN e2 WHEN q1 <> q2 THEN q2 > q1 WHEN s1 <> s2 THEN s2 > s1 WHEN c1 <> c2 THEN c2 > c1 ELSE n2 > n1 END THEN 'fallback' ELSE 'primary' END AS chosen FROM (SELECT id, {attempt_sql('1', 0)}, {attempt_sql('2', 1)} FROM entries)")
def best_attempt(spark, d):
    return a.best_attempts(t.entries(spark, d).selectExpr("id", f"{attempt(0)} as p", f"{attempt(1)} as f"))


CHUNKS = "chunks AS (SELECT doc_id // 4 AS attachment_id, doc_id % 4 AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'caption' END AS modality, CASE WHEN doc_id % 5 = 0 THEN 'succeeded' WHEN doc_id % 5 = 1 THEN 'failed' ELSE 'pending' END AS status, lang AS provider, 'v' || CAST(doc_id % 7 // 6 AS VARCHAR) AS version, 'm' || CAST(doc_id % 2 AS VARCHAR) AS method FROM documents)"


@query(
    "SELECT attachment_id, CASE WHEN bool_or(modality = 'ocr' AND status = 'succeeded') THEN 'succeeded' ELSE arg_max(status, chunk_index) FILTER (modality <> 'ocr') END AS status, arg_max(provider, chunk_index) AS provider, bool_or(version <> 'v0') AS reindex_required, (SELECT string_agg(method, ',' ORDER BY c) FROM (SELECT method, min(chunk_index) AS c FROM chunks x WHERE x.attachment_id = k.attachment_id GROUP BY method)) AS methods FROM chunks k GROUP BY attachment_id",
    CHUNKS,
)
def image_rollup(spark, d):
    rows = t.table(spark, d, "documents").selectExpr("doc_id div 4 as attachment_id", "doc_id % 4 as chunk_index", "case when doc_id % 3 = 0 then 'ocr' else 'caption' end as modality", "case when doc_id % 5 = 0 then 'succeeded' when doc_id % 5 = 1 then 'failed' else 'pending' end as status", "lang as provider", "concat('v', cast(doc_id % 7 div 6 as string)) as version", "concat('m', cast(doc_id % 2 as string)) as method")
    return a.image_rollup(rows, "v0")


QRELS = "good AS (SELECT DISTINCT query_id AS case_id, key FROM rankings WHERE doc_id % 5 = 0)"


def good(spark, d):
    return t.rankings(spark, d).where("doc_id % 5 = 0").select(F.col("query_id").alias("case_id"), "key").distinct()


@query(
    "SELECT case_id, layer, round(hits / relevant::DOUBLE, 6) AS recall, round(hits / n::DOUBLE, 6) AS precision FROM (SELECT l.case_id, layer, count(*) AS n, count(g.key) AS hits FROM (SELECT DISTINCT query_id AS case_id, channel AS layer, key FROM rankings) l LEFT JOIN good g USING (case_id, key) GROUP BY ALL) LEFT JOIN (SELECT case_id, count(*) AS relevant FROM good GROUP BY case_id) USING (case_id)",
    QRELS,
)
def layer_metrics(spark, d):
    return a.layer_metrics(t.rankings(spark, d).select(F.col("query_id").alias("case_id"), F.col("channel").alias("layer"), "key"), good(spark, d))


SCORED = """scored AS (SELECT case_id, CASE WHEN infra THEN NULL WHEN relevant = 0 OR NOT answerable THEN CASE WHEN cited = 0 THEN 1.0 ELSE 0.0 END WHEN cited = 0 THEN 0.0 ELSE hits / cited::DOUBLE END AS precision,
 CASE WHEN infra OR relevant = 0 OR NOT answerable THEN NULL ELSE hits / relevant::DOUBLE END AS recall, CASE WHEN infra THEN 'infra' WHEN NOT answerable AND cited > 0 THEN 'should_abstain' WHEN answerable AND cited = 0 THEN 'missing_citation' ELSE '' END AS failure
 FROM (SELECT id AS case_id, id % 7 <> 0 AS answerable, id % 11 = 0 AS infra, id % 4 AS cited, id % 3 AS relevant, least(id % 4, id % 3) AS hits FROM entries))"""


def case_scores_of(spark, d):
    return a.case_scores(t.entries(spark, d).selectExpr("id as case_id", "id % 7 <> 0 as answerable", "id % 11 = 0 as infra", "id % 4 as cited", "id % 3 as relevant", "least(id % 4, id % 3) as hits"))


@query("SELECT case_id, round(precision, 6) AS precision, round(recall, 6) AS recall, failure FROM scored", SCORED)
def case_scores(spark, d):
    return shown(case_scores_of(spark, d))


@query("SELECT failure, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM scored GROUP BY failure", SCORED)
def generation_report(spark, d):
    return a.report(case_scores_of(spark, d))


@query("SELECT query_id AS case_id, key, max(CAST(doc_id % 5 AS INTEGER)) AS relevance FROM rankings WHERE doc_id % 5 BETWEEN 1 AND 3 AND CASE WHEN doc_id % 8 = 0 THEN 'page' ELSE 'note' END = 'note' GROUP BY ALL")
def qrel_cleaning(spark, d):
    return a.qrels_cleaned(t.rankings(spark, d).selectExpr("query_id as case_id", "key", "cast(doc_id % 5 as int) as relevance", "case when doc_id % 8 = 0 then 'page' else 'note' end as source_type"))


@query(
    r"""SELECT id, length(clean) AS chars, sha256(substr(clean, 1, 2097152)) AS content_hash, length(clean) > 2097152 AS partial FROM (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|https?://[^\s<]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '', 'g'), '\s+', ' ', 'g'), ' ') AS clean FROM site_pages)""".replace("\\\\", "\\")
)
def page_texts(spark, d):
    """Page text without private parts."""
    return s.page_texts(t.pages(spark, d))


@query("SELECT id, CASE WHEN id % 10 = 0 THEN 'insert' WHEN id % 10 = 1 THEN 'delete' WHEN id % 10 = 2 THEN 'update' ELSE 'skip' END AS action FROM entries")
def mirror_upserts(spark, d):
    rows = t.entries(spark, d).select("id", F.sha2("content", 256).alias("content_hash"))
    old = rows.where("id % 10 <> 0").withColumn("content_hash", F.when(F.col("id") % 10 == 2, "stale").otherwise(F.col("content_hash")))
    return s.upserts(old, rows.where("id % 10 <> 1"))


@query("SELECT origin AS id, arg_max(key, idx * 1000000 + doc_id) AS title FROM rankings GROUP BY origin")
def discovery_merge(spark, d):
    rows = t.rankings(spark, d).selectExpr("origin as id", "key as title", "idx * 1000000 + doc_id as seq")
    return s.merged_discovery(rows).select("id", "title")


@query("SELECT user_id AS session_id, 2 * (row_number() OVER (PARTITION BY user_id ORDER BY id)) - 1 AS seq, event_type AS event, '{\"k\":' || CAST(k AS VARCHAR) || '}' AS data FROM jobs")
def sse_frames(spark, d):
    """Frames written with a comment before each, and parsed again."""
    line = F.expr("concat(': wait\n\nevent: ', event_type, '\ndata: {\"k\":', cast(k as string), '}')")
    rows = t.jobs(spark, d).select("user_id", F.struct("id", line.alias("f")).alias("x")).groupBy(F.col("user_id").alias("session_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]), "\n\n").alias("text"))
    return s.frames(rows)


EVENTS = "turn AS (SELECT user_id // 3 AS request, created_at AS at_, id, CASE WHEN rn = 1 AND user_id % 2 = 0 THEN 'meta' WHEN rb = 1 AND user_id % 3 = 0 THEN 'done' ELSE 'text_delta' END AS event FROM (SELECT *, row_number() OVER (PARTITION BY user_id // 3 ORDER BY created_at, id) AS rn, row_number() OVER (PARTITION BY user_id // 3 ORDER BY created_at DESC, id DESC) AS rb FROM jobs))"


@query("SELECT request, count(*) AS events, arg_min(event, row(at_, id)) = 'meta' AND arg_max(event, row(at_, id)) = 'done' AND count(*) > 1 AS valid FROM turn GROUP BY request", EVENTS)
def turn_check(spark, d):
    rn = F.expr("row_number() over (partition by user_id div 3 order by created_at, id)")
    rb = F.expr("row_number() over (partition by user_id div 3 order by created_at desc, id desc)")
    rows = t.jobs(spark, d).withColumn("rn", rn).withColumn("rb", rb)
    event = F.expr("case when rn = 1 and user_id % 2 = 0 then 'meta' when rb = 1 and user_id % 3 = 0 then 'done' else 'text_delta' end")
    return s.turns_checked(rows.select(F.expr("user_id div 3").alias("request"), F.col("created_at").alias("at"), "id", event.alias("event")))


@query(
    "SELECT session_id, id, CASE WHEN ok THEN 'confirmed' ELSE 'conflict' END AS outcome, now AS version FROM versions",
    """versions AS (WITH RECURSIVE r AS (SELECT user_id AS session_id, id, id % 3 AS base, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM jobs),
  f(session_id, n, id, now, ok) AS (SELECT session_id, n, id, CASE WHEN base = 0 THEN 1 ELSE 0 END, base = 0 FROM r WHERE n = 1
   UNION ALL SELECT r.session_id, r.n, r.id, CASE WHEN base = now THEN now + 1 ELSE now END, base = now FROM f JOIN r ON r.session_id = f.session_id AND r.n = f.n + 1) SELECT * FROM f)""",
)
def source_set_versions(spark, d):
    """Confirmations folded into versions (Q13)."""
    return s.versions(t.jobs(spark, d).selectExpr("user_id as session_id", "created_at as at", "id", "cast(id % 3 as bigint) as base"))


SPLIT = "a AS (SELECT DISTINCT ON (query_id, key) query_id, key, rank AS position, score AS payload FROM rankings WHERE list_idx = 0 ORDER BY query_id, key, rank), b AS (SELECT DISTINCT ON (query_id, key) query_id, key, rank AS position, score AS payload FROM rankings WHERE list_idx = 1 ORDER BY query_id, key, rank)"


def half(spark, d, i):
    rows = t.rankings(spark, d).where(F.col("list_idx") == i)
    return rows.groupBy("query_id", "key").agg(F.min("rank").alias("position"), F.min_by("score", "rank").alias("payload"))


@query("SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY l, p, key) AS position, payload FROM (SELECT query_id, key, CASE WHEN a.key IS NOT NULL THEN 0 ELSE 1 END AS l, coalesce(a.position, b.position) AS p, coalesce(b.payload, a.payload) AS payload FROM a FULL JOIN b USING (query_id, key))", SPLIT)
def keyed_union(spark, d):
    return s.keyed_union(half(spark, d, 0), half(spark, d, 1))


@query("SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY l, p, key) - 1 AS display_order FROM (SELECT query_id, key, CASE WHEN a.key IS NOT NULL THEN 0 ELSE 1 END AS l, coalesce(a.position, b.position) AS p FROM a FULL JOIN b USING (query_id, key))", SPLIT)
def member_union(spark, d):
    return s.member_union(half(spark, d, 0), half(spark, d, 1))


@query("SELECT query_id, bool_and(w AND p) AS permutation FROM (SELECT query_id, origin, bool_or(list_idx IN (0, 1, 2)) AS w, bool_or(list_idx IN (1, 2, 3)) AS p FROM rankings WHERE query_id % 2 = 0 OR list_idx IN (1, 2) GROUP BY ALL) GROUP BY query_id")
def order_permutation(spark, d):
    rows = t.rankings(spark, d).where("query_id % 2 = 0 or list_idx in (1, 2)").withColumn("key", F.col("origin"))
    return s.same_members(rows.where("list_idx in (0, 1, 2)"), rows.where("list_idx in (1, 2, 3)"))


@query("SELECT DISTINCT f.query_id, f.key, k.key AS known FROM rankings f JOIN rankings k ON f.query_id = k.query_id AND f.origin = k.origin WHERE f.list_idx = 0 AND k.list_idx = 1")
def alias_match(spark, d):
    rows = t.rankings(spark, d).select("query_id", "key", "list_idx", F.array("origin", F.concat(F.lit("own:"), F.col("doc_id").cast("string"))).alias("aliases"))
    return s.alias_matches(rows.where("list_idx = 0"), rows.where("list_idx = 1"))


@query("SELECT DISTINCT c.query_id AS source_id, c.idx AS chunk_index FROM rankings h JOIN rankings c ON c.query_id = h.query_id AND c.idx BETWEEN h.idx - 1 AND h.idx + 1 WHERE h.doc_id % 10 = 3")
def neighbour_chunks(spark, d):
    rows = t.rankings(spark, d).select(F.col("query_id").alias("source_id"), F.col("idx").alias("chunk_index"), "doc_id")
    return s.neighbours(rows.where("doc_id % 10 = 3"), rows.select("source_id", "chunk_index"))


@query("SELECT parent_id, CAST(coalesce(max(sort_order) + 1, 0) AS BIGINT) AS \"next\" FROM todos WHERE parent_id IS NOT NULL GROUP BY parent_id")
def next_sort_order(spark, d):
    return s.next_positions(t.todos(spark, d))


@query("SELECT user_id, count(*) FILTER (NOT x) AS live, count(*) FILTER (x) AS deleted, count(*) FILTER (x) / count(*)::DOUBLE > 0.2 AS rebuild FROM (SELECT user_id, id % (user_id + 3) = 0 AS x FROM entries) GROUP BY user_id")
def index_statistics(spark, d):
    return s.index_statistics(t.entries(spark, d).withColumn("deleted", F.expr("id % (user_id + 3) = 0")))
