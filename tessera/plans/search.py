"""Queries of dense and lexical search, fusion and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import admission as ad
from tessera.operators import fusion as fu
from tessera.operators import retrieval as r
from tessera.plans.registry import query
from tessera.sources import tables as t

CLOCK = t.ENTRY_CLOCK
COS = lambda a, b: f"CASE WHEN list_inner_product({a}, {a}) * list_inner_product({b}, {b}) > 0 THEN list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) ELSE 0.0 END"
DENSE = f"dense AS (SELECT query_id, id, round({COS('content_vector', 'query_vector')}, 6) AS score, label, query_label, content_vector, title_vector, query_vector FROM vectors, query_vectors)"
MIX = "mix AS (SELECT query_id, id, label, query_label, query_vector, list_transform(list_zip(title_vector, content_vector), lambda z: 0.3 * z[1] + 0.7 * z[2]) AS m FROM vectors, query_vectors)"
RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"


def mixed_sql(label: str) -> str:
    unit = "list_inner_product(m, query_vector) / sqrt(list_inner_product(m, m)) / sqrt(list_inner_product(query_vector, query_vector))"
    return f"SELECT query_id, {RANKED} AS rank, id, score FROM (SELECT *, {RANKED} AS n FROM (SELECT query_id, id, label, query_label, round({unit}, 6) AS score FROM mix)) WHERE n <= 30 AND score >= 0.35 {label} QUALIFY rank <= 10"


@query(mixed_sql(""), MIX)
def entry_dense_topk(spark, d):
    return r.entry_dense(t.query_vectors(spark, d), t.vectors(spark, d))


@query(mixed_sql("AND label = query_label"), MIX)
def entry_dense_labelled(spark, d):
    return r.entry_dense(t.query_vectors(spark, d), t.vectors(spark, d), label="query_label")


@query(
    f"SELECT query_id, rank, id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM (SELECT query_id, id, score, {RANKED} AS rank FROM (SELECT query_id, id, round(0.3 * ({COS('title_vector', 'query_vector')}) + 0.7 * ({COS('content_vector', 'query_vector')}), 6) AS score FROM dense)) WHERE rank <= 10) WHERE score >= 0.35 OR top < 0.35",
    DENSE,
)
def entry_dense_fallback(spark, d):
    return r.entry_dense_fallback(t.query_vectors(spark, d), t.vectors(spark, d))


@query(f"SELECT query_id, {RANKED} AS rank, id, score FROM dense WHERE score >= 0.35 QUALIFY rank <= 30", DENSE)
def knowledge_dense_topk(spark, d):
    return r.dense(t.query_vectors(spark, d), t.content_vectors(spark, d))


@query(f"SELECT query_id, {RANKED} AS rank, id, score FROM dense WHERE score >= 0.25 AND id <> query_id QUALIFY rank <= 8", DENSE)
def session_vector_topk(spark, d):
    return r.dense(t.query_vectors(spark, d), t.content_vectors(spark, d), k=8, least=0.25, skip_own=True)


@query(f"SELECT query_id, {RANKED} AS rank, id, score FROM dense WHERE score >= 0.25 QUALIFY rank <= 12", DENSE)
def memory_vector_topk(spark, d):
    return r.dense(t.query_vectors(spark, d), t.content_vectors(spark, d), k=12, least=0.25)


OCC = lambda h: f"((length({h}) - length(replace({h}, x, ''))) // length(x))"


KEYWORD_SQL = f"""SELECT query_id, rank, id, score FROM (SELECT *, {RANKED} AS rank FROM (SELECT query_id, id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score FROM (
 SELECT query_id, id, points + greatest(0.0, 0.2 - least(greatest(DATE '2024-02-01' - CAST(created_at AS DATE), 0), 365) / 365 * 0.2) AS raw FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id DESC) AS n FROM (
 SELECT query_id, id, created_at, list_sum(list_transform(list_filter(list_transform(terms, lambda x: {OCC('h')}), lambda c: c > 0), lambda c: 1 + 0.15 * least(c, 5)))::DOUBLE AS points FROM (SELECT id, created_at, lower(concat_ws(chr(10), content, label_code)) AS h FROM entries), term_queries) WHERE points > 0) WHERE n <= 90))) WHERE rank <= 30"""


@query(KEYWORD_SQL)
def keyword_search(spark, d):
    return r.keyword(t.term_queries(spark, d), t.entries(spark, d), CLOCK)


LEX = "lex AS (SELECT query_id, id, len(list_filter(terms, lambda x: contains(title, x))) AS title_hits, len(list_filter(terms, lambda x: contains(body, x))) AS body_hits FROM (SELECT id, lower(substr(trim(split_part(content, chr(10), 1), ' '), 1, 120)) AS title, lower(content) AS body FROM entries), term_queries)"


@query("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN title_hits > 0 THEN 0 ELSE 1 END, title_hits DESC, body_hits DESC, id) AS rank, id, title_hits, body_hits FROM lex WHERE body_hits > 0 QUALIFY rank <= 40", LEX)
def lexical_union(spark, d):
    return r.lexical(t.term_queries(spark, d), t.entries(spark, d))


PAGE_LEX = "page_lex AS (SELECT query_id, id, terms, plain, len(list_filter(terms, lambda x: contains(h, x))) AS score FROM (SELECT id, plain, lower(concat_ws(chr(10), title, host, lang, plain)) AS h FROM (SELECT *, regexp_replace(html, '<[^>]*>', ' ', 'g') AS plain FROM site_pages)), term_queries)"


@query(
    f"""SELECT query_id, rank, id, score, CASE WHEN spot IS NULL THEN substr(plain, 1, 420) ELSE substr(plain, greatest(spot - 40, 0) + 1, spot + 200 - greatest(spot - 40, 0)) END AS snippet
 FROM (SELECT *, list_filter(list_transform(terms, lambda x: instr(lower(plain), x)), lambda p: p > 0)[1] - 1 AS spot, {RANKED} AS rank FROM page_lex WHERE score > 0 QUALIFY rank <= 20)""",
    PAGE_LEX,
)
def page_lexical(spark, d):
    return r.page_lexical(t.term_queries(spark, d), t.pages(spark, d))


SCANNED = """scanned AS (SELECT *, count(*) OVER (PARTITION BY query_id) > {0} AS cut, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM lex WHERE body_hits > 0)"""
BY_HITS = "row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN title_hits > 0 THEN 0 ELSE 1 END, title_hits DESC, body_hits DESC, id)"


@query(f"SELECT query_id, {BY_HITS} AS rank, id, title_hits, body_hits, cut FROM scanned WHERE n <= 100", LEX, SCANNED.format(100))
def lexical_scan_budget(spark, d):
    """The texts with a term under a budget (R9): the first by id are ranked, and one more tells that there were more."""
    return r.lexical(t.term_queries(spark, d), t.entries(spark, d), k=None, budget=100)


RRF = lambda key, weights: f"SELECT query_id, {key} AS key, sum(coalesce({weights}[list_idx + 1], 1.0) / (60 + rank)) AS s, min(row(list_idx, rank)) AS first, max(relevance) AS most, count(DISTINCT list_idx) AS methods FROM l GROUP BY query_id, {key}"
FUSED = "fused AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, key) AS rank, key, rrf, greatest(most, rrf) AS relevance, CASE WHEN methods > 1 THEN 'hybrid_rrf' ELSE 'single' END AS source_reason FROM (SELECT *, round(s, 9) AS rrf FROM f))"
LISTS = "l AS (SELECT query_id, list_idx, rank, key, score AS relevance FROM rankings)"


@query("SELECT * FROM fused", LISTS, f"f AS ({RRF('key', '[1.0, 0.9, 0.85]')})", FUSED)
def rrf_fusion(spark, d):
    return fu.rrf(t.rankings(spark, d).select("query_id", "list_idx", "rank", "key", F.col("score").alias("relevance")))


@query("SELECT query_id, rank, key, rrf FROM fused", "l AS (SELECT query_id, list_idx, row_number() OVER (PARTITION BY query_id, list_idx ORDER BY rank, key) AS rank, key, 0.0 AS relevance FROM rankings WHERE regexp_matches(key, '^[a-z_]+:(chunk|source|entry):[0-9]+$'))", f"f AS ({RRF('key', '[1.0, 1.0, 1.0]')})", FUSED)
def rrf_keys(spark, d):
    return fu.rrf_keys(t.rankings(spark, d).select("query_id", "list_idx", "rank", "key"))


@query(
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, key, origin, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, origin ORDER BY place) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_idx, rank, key) AS place FROM rankings WHERE list_idx < 2)) WHERE nth = 1"
)
def dense_channel_merge(spark, d):
    return fu.channels_merged(t.rankings(spark, d).where("list_idx < 2").withColumnRenamed("list_idx", "channel_order"))


@query(
    "SELECT query_id, key, origin, position, key = kept_key AS kept, CASE WHEN key <> kept_key THEN kept_key END AS duplicate_of FROM (SELECT query_id, key, origin, min(idx) OVER w AS position, first_value(key) OVER (w ORDER BY CASE WHEN source_type = 'attachment_chunk' THEN 0 ELSE 1 END, idx, key) AS kept_key FROM rankings WINDOW w AS (PARTITION BY query_id, origin))"
)
def mirror_dedupe(spark, d):
    return fu.mirrors_merged(t.rankings(spark, d).drop("rank").withColumnRenamed("idx", "rank"))


@query(
    """SELECT query_id, rank, origin AS attachment_id, score, 'text' AS channel FROM rankings WHERE list_idx = 0 UNION ALL
SELECT query_id, coalesce(last, 0) + n, attachment_id, score, 'visual' FROM (SELECT query_id, origin AS attachment_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, origin) AS n FROM rankings r WHERE list_idx = 3 AND score >= 0.25 AND NOT EXISTS (SELECT 1 FROM rankings x WHERE x.list_idx = 0 AND x.query_id = r.query_id AND x.origin = r.origin) GROUP BY query_id, origin)
LEFT JOIN (SELECT query_id, max(rank) AS last FROM rankings WHERE list_idx = 0 GROUP BY query_id) USING (query_id) WHERE n <= 3"""
)
def visual_late_fusion(spark, d):
    rows = t.rankings(spark, d).withColumnRenamed("origin", "attachment_id")
    visual = rows.where("list_idx = 3").groupBy("query_id", "attachment_id").agg(F.max("score").alias("score"))
    return fu.with_visual(rows.where("list_idx = 0").select("query_id", "rank", "attachment_id", "score"), visual)


HYBRID = f"""l AS (SELECT query_id, 0 AS list_idx, {RANKED} AS rank, 'entry:entry:' || CAST(id AS VARCHAR) AS key, score AS relevance FROM dense WHERE score >= 0.35 QUALIFY rank <= 30
 UNION ALL SELECT query_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN title_hits > 0 THEN 0 ELSE 1 END, title_hits DESC, body_hits DESC, id) AS rank, 'entry:entry:' || CAST(id AS VARCHAR), 1.0 FROM lex WHERE body_hits > 0 QUALIFY rank <= 30)"""


@query("SELECT * FROM fused", DENSE, LEX, HYBRID, f"f AS ({RRF('key', '[1.0, 0.9, 0.85]')})", FUSED)
def hybrid_search(spark, d):
    """Dense and lexical lists of the same queries, fused (R24); a query that one channel lacks still gets the other."""
    dense = r.dense(t.query_vectors(spark, d), t.content_vectors(spark, d)).select("query_id", F.lit(0).alias("list_idx"), "rank", "id", F.col("score").alias("relevance"))
    words = r.lexical(t.term_queries(spark, d), t.entries(spark, d), k=30).select("query_id", F.lit(1).alias("list_idx"), "rank", "id", F.lit(1.0).alias("relevance"))
    return fu.rrf(dense.unionByName(words).withColumn("key", F.concat(F.lit("entry:entry:"), F.col("id").cast("string"))))


BUCKETS = "h AS (SELECT query_id, (['dense', 'fused', 'keyword', 'attachment'])[list_idx + 1] AS bucket, key, min(rank) AS rank FROM rankings GROUP BY ALL)"


def pool_sql() -> tuple[str, ...]:
    tables, earlier = [BUCKETS], []
    for i, (b, n) in enumerate(ad.QUOTAS.items()):
        skip = "".join(f" AND NOT EXISTS (SELECT 1 FROM b{j} x WHERE x.query_id = h.query_id AND x.key = h.key)" for j in earlier)
        tables.append(f"b{i} AS (SELECT query_id, key, {i} AS \"order\", row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS n FROM h WHERE bucket = '{b}'{skip} QUALIFY n <= {n})")
        earlier.append(i)
    skip = " AND ".join(f"NOT EXISTS (SELECT 1 FROM b{j} x WHERE x.query_id = h.query_id AND x.key = h.key)" for j in earlier)
    tables.append(f"rest AS (SELECT query_id, key, {len(earlier)} AS \"order\", row_number() OVER (PARTITION BY query_id ORDER BY rank, key) AS n FROM (SELECT query_id, key, min(rank) AS rank FROM h WHERE {skip} GROUP BY ALL))")
    return tuple(tables)


@query('SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY "order", n) AS position, key, "order" FROM (FROM b0 UNION ALL FROM b1 UNION ALL FROM b2 UNION ALL FROM b3 UNION ALL FROM rest) QUALIFY position <= 40', *pool_sql())
def generation_pool(spark, d):
    bucket = F.element_at(F.array(*[F.lit(b) for b in ad.QUOTAS]), F.col("list_idx") + 1)
    return ad.pool(t.rankings(spark, d).groupBy("query_id", bucket.alias("bucket"), "key").agg(F.min("rank").alias("rank")))


CANDIDATES = "c AS (SELECT query_id, key, channel, title_hits, body_hits, CASE WHEN channel <> 'lexical' THEN row_number() OVER (PARTITION BY query_id, channel ORDER BY idx) END AS dense_rank FROM (SELECT query_id, key, arg_min(channel, idx) AS channel, min(idx) AS idx, max(doc_id % 3) AS title_hits, max(doc_id % 7) AS body_hits FROM rankings GROUP BY query_id, key))"


@query(
    """SELECT query_id, key, channel, seat = 0 AS reserved FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS every, row_number() OVER (PARTITION BY query_id ORDER BY seat, CASE WHEN title_hits > 0 THEN 0 ELSE 1 END, title_hits DESC, body_hits DESC, dense_rank NULLS LAST, key) AS n
FROM (SELECT *, CASE WHEN channel <> 'lexical' AND row_number() OVER (PARTITION BY query_id, channel ORDER BY dense_rank NULLS LAST, key) = 1 THEN 0 ELSE 1 END AS seat FROM c)) WHERE every <= 20 OR n <= 20""",
    CANDIDATES,
)
def budget_selection(spark, d):
    rows = t.rankings(spark, d).groupBy("query_id", "key").agg(F.min_by("channel", "idx").alias("channel"), F.min("idx").alias("idx"), F.max(F.expr("doc_id % 3")).alias("title_hits"), F.max(F.expr("doc_id % 7")).alias("body_hits"))
    rows = rows.withColumn("dense_rank", F.expr("case when channel <> 'lexical' then row_number() over (partition by query_id, channel order by idx) end"))
    return ad.within_budget(rows, cap=20)


@query(
    """SELECT query_id, idx, channel, score, NOT entered AS by_floor FROM (SELECT *, count(*) FILTER (entered) OVER (PARTITION BY query_id) AS have, sum(CASE WHEN entered THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY idx) AS waiting
FROM (SELECT query_id, idx, channel, score, channel = 'lexical' OR (channel IN ('knowledge', 'entry', 'attachment') AND (score >= greatest(0.35, max(score) OVER c * CASE WHEN channel = 'attachment' THEN 0.98 ELSE 0.985 END)
 OR row_number() OVER (c ORDER BY score DESC, idx) <= CASE channel WHEN 'knowledge' THEN 6 ELSE 3 END)) AS entered FROM rankings WHERE idx <= 25 WINDOW c AS (PARTITION BY query_id, channel))) WHERE entered OR waiting <= greatest(8 - have, 0)"""
)
def rag_admission(spark, d):
    return ad.admitted(t.rankings(spark, d).where("idx <= 25").select("query_id", "idx", "channel", "score"))


@query(
    "SELECT query_id, rank, id, used FROM (SELECT query_id, idx AS rank, doc_id AS id, CAST(sum(length(key) * 9 + 200) OVER (PARTITION BY query_id ORDER BY idx) + idx + 1 AS BIGINT) AS used FROM rankings) WHERE rank <= 48 AND used <= 14000"
)
def prompt_budget(spark, d):
    return ad.prompt_prefix(t.rankings(spark, d).selectExpr("query_id", "idx as rank", "doc_id as id", "cast(length(key) * 9 + 200 as bigint) as size"))


@query("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY idx) AS position, origin AS family, idx, position <= 3 AS by_floor FROM (SELECT query_id, origin, min(idx) AS idx FROM rankings GROUP BY ALL)")
def explainer_families(spark, d):
    return ad.families(t.rankings(spark, d).withColumnRenamed("origin", "family"))


@query(
    """SELECT query_id, key, relevance, CASE WHEN NOT known THEN 'unknown_key' WHEN relevance < 2 THEN 'low_relevance' WHEN place > 10 THEN 'over_limit' ELSE 'selected' END AS reason
FROM (SELECT *, sum(CASE WHEN known AND relevance >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY seq, key) AS place FROM (SELECT query_id, key, max(doc_id % 4) AS relevance, min(idx) AS seq, bool_or(list_idx < 3) AS known FROM rankings GROUP BY ALL))"""
)
def judge_selection(spark, d):
    rows = t.rankings(spark, d)
    return ad.judged(rows.select("query_id", "key", F.expr("doc_id % 4").alias("relevance"), F.col("idx").alias("seq")), rows.where("list_idx < 3").select("query_id", "key").distinct())


PASS = lambda n, m: f"p{n} AS (SELECT query_id, key, max(doc_id % {m}) > {m // 2} AS relevant FROM rankings WHERE list_idx <> {n} GROUP BY ALL)"


@query(
    """SELECT query_id, key, CASE WHEN rb IS NULL THEN coalesce(ra, false) WHEN ra IS NOT DISTINCT FROM rb THEN ra ELSE coalesce(rc, ra, false) END AS relevant, ra IS DISTINCT FROM rb AS disputed
FROM (SELECT query_id, key, a.relevant AS ra, b.relevant AS rb, c.relevant AS rc FROM p0 a FULL JOIN p1 b USING (query_id, key) LEFT JOIN p2 c USING (query_id, key))""",
    PASS(0, 5), PASS(1, 7), PASS(2, 3),
)
def judge_merge(spark, d):
    rows = t.rankings(spark, d)
    passed = lambda n, m: rows.where(F.col("list_idx") != n).groupBy("query_id", "key").agg((F.max(F.expr(f"doc_id % {m}")) > m // 2).alias("relevant"))
    return ad.judgments_merged(passed(0, 5), passed(1, 7), passed(2, 3), list_all=False)


@query(
    """SELECT query_id, claim, array_to_string(list_sort(list_filter(ks, lambda k: list_contains(kn, k) AND list_contains(us, k))), ',') AS valid_keys,
 CASE WHEN abstains THEN '' ELSE concat_ws(',', CASE WHEN len(ks) = 0 THEN 'no_keys' END, CASE WHEN len(us) = 0 THEN 'no_used_keys' END, CASE WHEN len(list_filter(ks, lambda k: NOT list_contains(kn, k))) > 0 THEN 'unknown_key' END, CASE WHEN len(list_filter(ks, lambda k: list_contains(kn, k) AND NOT list_contains(us, k))) > 0 THEN 'unused_key' END) END AS codes
FROM (SELECT query_id, claim, ks, abstains, coalesce(kn, []) AS kn, coalesce(us, []) AS us FROM (SELECT query_id, idx % 10 AS claim, list(DISTINCT key) AS ks, query_id % 9 = 0 AS abstains FROM rankings GROUP BY ALL)
 LEFT JOIN (SELECT query_id, list(DISTINCT key) AS kn FROM rankings WHERE list_idx < 3 GROUP BY ALL) USING (query_id) LEFT JOIN (SELECT query_id, list(DISTINCT key) AS us FROM rankings WHERE list_idx = 1 GROUP BY ALL) USING (query_id))"""
)
def claim_contract(spark, d):
    rows = t.rankings(spark, d)
    claims = rows.groupBy("query_id", F.expr("idx % 10").alias("claim")).agg(F.collect_set("key").alias("keys")).withColumn("abstains", F.expr("query_id % 9 = 0"))
    return ad.claims_checked(claims, rows.where("list_idx < 3").select("query_id", "key"), rows.where("list_idx = 1").select("query_id", "key"))


SYNONYMS = {"the": ["der", "le"], "and": ["und", "et"], "der": ["el"]}


@query("SELECT doc_id AS id, regexp_replace(regexp_replace(substr(text, 1, 60), '([一-鿿])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([一-鿿])', '\\1 \\2', 'g') AS spaced FROM (SELECT doc_id, '文' || replace(text, 'a', '字') AS text FROM documents)")
def script_boundary_split(spark, d):
    text = F.concat(F.lit("文"), F.replace(F.col("content"), F.lit("a"), F.lit("字")))
    return t.entries(spark, d).select("id", tx.split_scripts(F.substring(text, 1, 60)).alias("spaced"))


@query("SELECT query_id, array_to_string(terms, ' ') AS terms FROM (SELECT item_id AS query_id, (SELECT list(w ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p) GROUP BY w)) AS terms FROM (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM benchmark))")
def query_tokens(spark, d):
    return t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(tx.tokens(tx.normalised(F.col("text"))), " ").alias("terms"))


@query(
    "SELECT query_id, (SELECT string_agg(w, ' ' ORDER BY p) FROM (SELECT w, min(p) AS p FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS p) GROUP BY w)) AS expanded FROM (SELECT query_id, flatten(list_transform(terms, lambda w: [w] || CASE w WHEN 'the' THEN ['der', 'le'] WHEN 'and' THEN ['und', 'et'] WHEN 'der' THEN ['el'] ELSE [] END)) AS ws FROM (SELECT item_id AS query_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS terms FROM benchmark))"
)
def synonym_expand(spark, d):
    return t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(tx.expanded(tx.tokens(F.col("text")), SYNONYMS), " ").alias("expanded"))
