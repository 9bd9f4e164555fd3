"""Queries over reviews of daily plans, applied to whole trees, over streamed turns, and over answers rewritten."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import decisions as dc
from tessera.operators import claims, planning, tree, turns
from tessera.operators import rewriting as rw
from tessera.plans.registry import ORACLES, query
from tessera.plans.tasks import ACTIVE, DAY, META, PAST
from tessera.sources import tables as t
from tessera.sources.storage import settled, stored


def new_id():
    return F.expr("todo_id * 100000 + datediff(plan_date, date'1990-01-01')")


def items(spark, d):
    """Items with a source and a lineage: every third one was carried over from the item of the week before."""
    return t.plan_items(spark, d).withColumn("source", F.lit("manual")).withColumn("carried_from_id", F.expr("case when id % 3 = 0 then id - 7 end"))


def state_of(spark, d):
    """Tasks with their chains, and items, each computed once: reviews, verdicts and moves all start from them."""
    return stored(tree.chains(t.todos(spark, d)), "todos"), stored(items(spark, d), "items")


ITEMS = "its AS (SELECT id, todo_id, plan_date, status, 'manual' AS source, CASE WHEN id % 3 = 0 THEN id - 7 END AS carried_from_id FROM plan_items)"


def urgent_reviews(todos, rows):
    """Reviews of all urgent candidates: of every user two requests; some users also decide what is no candidate, saw
    another tree, or decide a task twice."""
    seen = planning.urgent_candidates(todos, rows, DAY).select("id", "user_id")
    sized = seen.join(tree.metadata(todos).select("id", "descendants"), "id")
    own = sized.selectExpr("user_id * 2 + if(id % 5 = 4, 1, 0) as request_id", "user_id", "id as position", "id as todo_id", "if(id % 3 = 0, 'delete', 'keep') as decision", "descendants + if(user_id % 10 = 7, 1, 0) as expected")
    twice = seen.where("user_id % 10 = 8").selectExpr("user_id * 2 as request_id", "user_id", "id + 1000000000000 as position", "id as todo_id", "'keep' as decision", "cast(null as bigint) as expected")
    other = todos.where("user_id % 10 = 9 and not is_urgent").selectExpr("user_id * 2 as request_id", "user_id", "id + 2000000000000 as position", "id as todo_id", "'keep' as decision", "cast(null as bigint) as expected")
    return own.union(twice).union(other)


URGENT = (
    f"cand AS ({ORACLES['urgent_candidates']})",
    META,
    PAST,
    ACTIVE,
    ITEMS,
    """deci AS (SELECT c.user_id * 2 + CASE WHEN c.id % 5 = 4 THEN 1 ELSE 0 END AS request_id, c.user_id, c.id AS position, c.id AS todo_id, CASE WHEN c.id % 3 = 0 THEN 'delete' ELSE 'keep' END AS decision, descendants + CASE WHEN c.user_id % 10 = 7 THEN 1 ELSE 0 END AS expected FROM cand c JOIN meta USING (id)
 UNION ALL SELECT user_id * 2, user_id, id + 1000000000000, id, 'keep', NULL FROM cand WHERE user_id % 10 = 8
 UNION ALL SELECT user_id * 2, user_id, id + 2000000000000, id, 'keep', NULL FROM todos WHERE user_id % 10 = 9 AND NOT is_urgent)""",
    """flaw AS (SELECT request_id, CASE WHEN nth > 1 THEN 1 ELSE 2 END AS stage, position, CASE WHEN nth > 1 AND decision <> chosen THEN 'conflict' WHEN nth > 1 THEN 'duplicate' WHEN expected <> descendants THEN 'stale' WHEN cand_id IS NULL AND NOT (decision = 'keep' AND todo_id IN (SELECT todo_id FROM active)) THEN 'not_a_candidate' END AS code
 FROM (SELECT d.*, m.descendants, c.id AS cand_id, row_number() OVER w AS nth, first_value(decision) OVER w AS chosen FROM deci d JOIN meta m ON m.id = d.todo_id LEFT JOIN cand c ON c.id = d.todo_id WINDOW w AS (PARTITION BY request_id, d.todo_id ORDER BY position)))""",
    """verdict AS (SELECT request_id, user_id, CASE WHEN turn > 1 THEN 'deferred' ELSE coalesce(code, 'applied') END AS outcome FROM (SELECT request_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY request_id) AS turn FROM (SELECT DISTINCT request_id, user_id FROM deci))
 LEFT JOIN (SELECT request_id, arg_min(code, row(stage, position)) AS code FROM flaw WHERE code IS NOT NULL GROUP BY request_id) USING (request_id))""",
)


@query("SELECT request_id, user_id, outcome FROM verdict", *URGENT)
def urgent_review_outcomes(spark, d):
    todos, rows = state_of(spark, d)
    return dc.urgent_judged(todos, rows, urgent_reviews(todos, rows), DAY)


#: The new state of items from ``eff`` (todo_id, adds, continues, past), over the rows of ``base``.
MOVED = f"""SELECT p.id, p.todo_id, p.plan_date,
 CASE WHEN p.plan_date = DATE '{DAY}' AND adds THEN CASE WHEN is_done THEN 'completed' ELSE 'active' END WHEN p.plan_date < DATE '{DAY}' AND p.status = 'active' AND e.past IS NOT NULL THEN e.past ELSE p.status END AS status,
 CASE WHEN p.plan_date = DATE '{DAY}' AND adds AND p.status IN ('returned', 'carried') THEN 'rollover' ELSE p.source END AS source,
 CASE WHEN p.plan_date <> DATE '{DAY}' OR adds IS NOT TRUE THEN p.carried_from_id WHEN p.status IN ('returned', 'carried') THEN coalesce(before, p.carried_from_id) WHEN p.status = 'completed' AND is_done THEN p.carried_from_id ELSE coalesce(p.carried_from_id, before) END AS carried_from_id
FROM base p LEFT JOIN whole e ON e.todo_id = p.todo_id
UNION ALL SELECT todo_id * 100000 + (DATE '{DAY}' - DATE '1990-01-01'), todo_id, DATE '{DAY}', CASE WHEN is_done THEN 'completed' ELSE 'active' END, 'rollover', before FROM whole w WHERE adds AND NOT EXISTS (SELECT 1 FROM base b WHERE b.todo_id = w.todo_id AND b.plan_date = DATE '{DAY}')"""
WHOLE = "whole AS (SELECT e.*, t.is_done, CASE WHEN continues THEN p.item_id END AS before FROM eff e JOIN todos t ON t.id = e.todo_id LEFT JOIN past p ON p.todo_id = e.todo_id)"


@query(
    MOVED,
    *URGENT,
    "done_now AS (SELECT d.* FROM deci d JOIN verdict v ON v.request_id = d.request_id AND outcome = 'applied')",
    "gone AS (SELECT c.id FROM closure c JOIN done_now d ON d.todo_id = c.ancestor AND decision = 'delete')",
    "base AS (SELECT * FROM its WHERE todo_id NOT IN (SELECT id FROM gone))",
    "eff AS (SELECT DISTINCT c.id AS todo_id, true AS adds, true AS continues, 'carried' AS past FROM closure c JOIN done_now d ON d.todo_id = c.ancestor AND decision = 'keep' JOIN todos t ON t.id = c.id WHERE (c.id = c.ancestor OR NOT t.is_done) AND c.id NOT IN (SELECT id FROM gone))",
    WHOLE,
)
def urgent_review_applied(spark, d):
    todos, rows = state_of(spark, d)
    reviews = settled(urgent_reviews(todos, rows))
    judged = dc.urgent_judged(todos, rows, reviews, DAY)
    return dc.urgent_applied(todos, rows, reviews, judged, DAY, new_id)[1]


def past_reviews(todos, items):
    """Reviews of all open tasks with an active item in the past; two of three are selected. Some users saw other trees."""
    open_ = planning.latest_past_active(items, DAY).select(F.col("todo_id").alias("id"))
    rows = todos.join(open_, "id").join(tree.metadata(todos).select("id", "descendants"), "id")
    return rows.selectExpr("user_id as request_id", "user_id", "id as todo_id", "id % 3 <> 1 as selected", "descendants + if(user_id % 10 = 3 and id % 2 = 0, 1, 0) as expected")


PAST_REVIEW = (
    META,
    PAST,
    ACTIVE,
    ITEMS,
    f"urg AS ({ORACLES['urgent_candidates']})",
    f"roll AS ({ORACLES['rollover_candidates']})",
    "rev AS (SELECT t.user_id AS request_id, t.user_id, t.id AS todo_id, t.id % 3 <> 1 AS selected, descendants + CASE WHEN t.user_id % 10 = 3 AND t.id % 2 = 0 THEN 1 ELSE 0 END AS expected, descendants FROM todos t JOIN past p ON p.todo_id = t.id JOIN meta m ON m.id = t.id)",
    "ok AS (SELECT * FROM rev WHERE request_id NOT IN (SELECT request_id FROM rev WHERE expected <> descendants) AND todo_id NOT IN (SELECT c.id FROM closure c JOIN urg u ON u.id = c.ancestor))",
    "sure AS (SELECT todo_id FROM ok WHERE selected AND (todo_id IN (SELECT id FROM roll) OR todo_id IN (SELECT todo_id FROM active)))",
    "tak AS (SELECT * FROM ok WHERE NOT selected OR todo_id IN (SELECT todo_id FROM sure) OR todo_id IN (SELECT c.id FROM closure c JOIN sure s ON s.todo_id = c.ancestor AND c.ancestor < c.id JOIN todos t ON t.id = c.id AND NOT t.is_done))",
    "steps AS (SELECT k.todo_id AS root, c.id AS todo_id, selected FROM tak k JOIN closure c ON c.ancestor = k.todo_id JOIN todos t ON t.id = c.id WHERE NOT selected OR c.id = c.ancestor OR NOT t.is_done)",
    "firsts AS (SELECT todo_id, arg_min(selected, root) AS takes, bool_or(selected) AS adds, min(root) AS root FROM steps GROUP BY todo_id)",
)


def past_steps(spark, d):
    todos, rows = state_of(spark, d)
    reviewed = settled(past_reviews(todos, rows))
    return todos, rows, dc.rollover_steps(todos, rows, reviewed, dc.rollover_judged(todos, reviewed), DAY)


@query(MOVED, *PAST_REVIEW, "base AS (SELECT * FROM its)", "eff AS (SELECT todo_id, adds, takes AS continues, CASE WHEN takes THEN 'carried' ELSE 'returned' END AS past FROM firsts)", WHOLE)
def rollover_review_applied(spark, d):
    todos, rows, steps = past_steps(spark, d)
    return dc.rollover_applied(todos, rows, steps, DAY, new_id)


@query(
    "SELECT request_id, todo_id, CASE WHEN selected THEN 'added' WHEN todo_id IN (SELECT id FROM roll) OR todo_id IN (SELECT f.root FROM firsts f JOIN past p ON p.todo_id = f.todo_id) THEN 'returned' ELSE 'unchanged' END AS action FROM tak",
    *PAST_REVIEW,
)
def rollover_review_report(spark, d):
    todos, rows, steps = past_steps(spark, d)
    return dc.rollover_report(rows, steps, DAY)


#: A conversation as a request: a question opens a turn, an answer is as many deltas as it has parts of forty characters.
#: Some answers are checked after their references, end with an error, or never end.
TURN_EVENTS = """SELECT session_id AS request, turn AS at_, pos AS id, evs[pos] AS event FROM (SELECT *, unnest(range(1, len(evs) + 1)) AS pos FROM (SELECT session_id, turn,
 CASE WHEN role = 'user' THEN CASE WHEN session_id % 11 = 9 AND turn > 2 THEN ['meta', 'meta'] ELSE ['meta', 'status'] END
 ELSE CASE WHEN session_id % 4 = 1 THEN ['source_set', 'status'] ELSE [] END || CASE WHEN session_id % 13 = 4 THEN ['source_candidate', 'source_candidate'] ELSE list_transform(range((length(content) + 39) // 40), lambda x: 'text_delta') || CASE WHEN session_id % 11 = 3 THEN ['reference', 'status'] ELSE ['status', 'reference'] END END
  || CASE WHEN session_id % 11 = 5 AND turn > 2 THEN [] WHEN session_id % 11 = 7 THEN ['error'] ELSE ['done'] END END AS evs FROM messages WHERE role <> 'system'))"""
TURN = "MS*(E|D|C+[DE]|OS*E|(OS*)?T+([DE]|S[DE]|SR+[DE]|R+[DE]))"
OPEN_TURN = "MS*(C+|OS*|(OS*)?T+(SR*|R+)?)?"


@query(
    f"""SELECT request, events, ended, CASE WHEN regexp_full_match(line, '(E|{TURN})({TURN})*') THEN CASE WHEN line LIKE '%D' THEN 'done' ELSE 'error' END WHEN regexp_full_match(line, '((E|{TURN})({TURN})*)?{OPEN_TURN}') THEN 'open' ELSE 'invalid' END AS outcome
FROM (SELECT request, count(*) AS events, count(*) FILTER (event IN ('done', 'error')) AS ended, string_agg(CASE event WHEN 'meta' THEN 'M' WHEN 'status' THEN 'S' WHEN 'error' THEN 'E' WHEN 'done' THEN 'D' WHEN 'source_candidate' THEN 'C' WHEN 'source_set' THEN 'O' WHEN 'text_delta' THEN 'T' WHEN 'reference' THEN 'R' ELSE 'X' END, '' ORDER BY at_, id) AS line FROM ev GROUP BY request)""",
    f"ev AS ({TURN_EVENTS})",
)
def turn_outcomes(spark, d):
    """Turns told by the order of all their events (Q4)."""
    question = "if(session_id % 11 = 9 and turn > 2, array('meta', 'meta'), array('meta', 'status'))"
    sources = "if(session_id % 4 = 1, array('source_set', 'status'), cast(array() as array<string>))"
    text = "concat(array_repeat('text_delta', cast((length(content) + 39) div 40 as int)), if(session_id % 11 = 3, array('reference', 'status'), array('status', 'reference')))"
    end = "case when session_id % 11 = 5 and turn > 2 then cast(array() as array<string>) when session_id % 11 = 7 then array('error') else array('done') end"
    answer = f"concat({sources}, if(session_id % 13 = 4, array('source_candidate', 'source_candidate'), {text}), {end})"
    rows = t.messages(spark, d).where("role <> 'system'").selectExpr("session_id as request", "turn as at", f"posexplode(if(role = 'user', {question}, {answer})) as (id, event)")
    return turns.outcomes(rows)


#: Answers with a label, a citation in each form and an alias alone. Some find nothing, some show an internal field.
ANSWERED = """asked AS (SELECT session_id, turn, session_id % 6 + 1 AS k, CASE WHEN session_id % 9 = 0 AND turn > 2 THEN '__NO_RELEVANT_SOURCES__' || CASE WHEN turn > 4 THEN ' S1' ELSE '' END
 WHEN session_id % 9 = 8 THEN content ELSE CASE WHEN session_id % 9 = 1 THEN 'chunk_id=' || turn || ' ' ELSE '' END || '- **S' || (turn % 3 + 1) || '**：' || content || ' 〔S' || ((session_id + turn) % 5 + 1) || '〕 [S' || (session_id % 4 + 1) || '] 【 S' || (turn % 2 + 1) || ' 】' || CASE WHEN session_id % 3 = 0 THEN ' S' || (turn % 7 + 1) || '.' ELSE '' END END AS text FROM messages WHERE role = 'assistant')"""


@query(
    r"""SELECT session_id, turn, code, CASE WHEN code = 'ok' THEN CASE WHEN none THEN '' ELSE shown END END AS public, CASE WHEN code = 'ok' THEN CASE WHEN none THEN '' ELSE array_to_string(list_transform(u, lambda x: 'S' || x), ',') END END AS cited
FROM (SELECT *, CASE WHEN text = '' THEN 'empty' WHEN length(text) > 12000 THEN 'too_long' WHEN contains(text, 'chunk_id') THEN 'internal_field' WHEN none AND contains(text, ' S1') THEN 'mixed' WHEN none THEN 'ok' WHEN len(list_filter(u, lambda x: CAST(x AS INTEGER) > k)) > 0 THEN 'unknown_alias' WHEN len(u) = 0 THEN 'missing' WHEN alone THEN 'alias_format' ELSE 'ok' END AS code
 FROM (SELECT *, regexp_matches(regexp_replace(t4, '〔#[0-9]+〕', '', 'g'), '\bS[1-9][0-9]*\b') AS alone, regexp_replace(list_reduce(list_prepend(t4, u), lambda acc, x: replace(acc, '〔#' || x || '〕', '〔' || list_position(u, x) || '〕')), '^\s+|\s+$', '', 'g') AS shown
  FROM (SELECT *, list_filter(x, lambda v, i: list_position(x, v) = i) AS u FROM (SELECT *, regexp_extract_all(t4, '〔#([0-9]+)〕', 1) AS x, starts_with(text, '__NO') AS none FROM
   (SELECT *, regexp_replace(regexp_replace(t2, '〔S([0-9]+)〕', '〔#\1〕', 'g'), '\bS(' || ks || ')\b', '〔#\1〕', 'g') AS t4 FROM (SELECT *, regexp_replace(t1, '(?m)^(\s*[-*]\s*)(?:\*\*)?S(?:' || ks || ')(?:\*\*)?\s*[：:]\s*', '\1', 'g') AS t2
    FROM (SELECT *, array_to_string(range(1, k + 1), '|') AS ks, regexp_replace(text, '(?:\[|【|［)\s*(S[1-9][0-9]*)\s*(?:\]|】|］)', '〔\1〕', 'g') AS t1 FROM (SELECT * REPLACE (regexp_replace(text, '^\s+|\s+$', '', 'g') AS text) FROM asked)))))))) """,
    ANSWERED,
)
def rewritten_answers(spark, d):
    """Answers with public citation numbers, or why they are refused (F16)."""
    cite = "concat('- **S', turn % 3 + 1, '**：', content, ' 〔S', (session_id + turn) % 5 + 1, '〕 [S', session_id % 4 + 1, '] 【 S', turn % 2 + 1, ' 】', if(session_id % 3 = 0, concat(' S', turn % 7 + 1, '.'), ''))"
    text = f"case when session_id % 9 = 0 and turn > 2 then concat('__NO_RELEVANT_SOURCES__', if(turn > 4, ' S1', '')) when session_id % 9 = 8 then content else concat(if(session_id % 9 = 1, concat('chunk_id=', turn, ' '), ''), {cite}) end"
    rows = t.messages(spark, d).where("role = 'assistant'").selectExpr("session_id", "turn", f"{text} as answer", "transform(sequence(1, session_id % 6 + 1), x -> concat('S', x)) as allowed")
    return rw.renumbered(rows).select("session_id", "turn", "code", "public", F.array_join("cited", ",").alias("cited"))


@query(
    r"""SELECT session_id, turn, CASE WHEN body = '' THEN regexp_replace(raw, '^\s+|\s+$', '', 'g') ELSE body END AS text FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(plain, '^[\s，,、：:。]+', ''), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body
 FROM (SELECT session_id, turn, CASE session_id % 3 WHEN 0 THEN '根据检索结果，' WHEN 1 THEN '```json' || chr(10) ELSE '' END || content || chr(10) || '- source_id: ' || turn || chr(10) || 'entry_id=' || session_id || CASE WHEN session_id % 3 = 1 THEN chr(10) || '```' ELSE '' END AS raw, regexp_replace(content, '[ \t]{2,}', ' ', 'g') AS plain FROM messages WHERE role = 'assistant'))"""
)
def cleaned_answers(spark, d):
    """Answers without openings, fences and lines of internal fields."""
    text = "concat(case session_id % 3 when 0 then '根据检索结果，' when 1 then '```json\n' else '' end, content, '\n- source_id: ', turn, '\nentry_id=', session_id, if(session_id % 3 = 1, '\n```', ''))"
    return t.messages(spark, d).where("role = 'assistant'").select("session_id", "turn", rw.cleaned(F.expr(text)).alias("text"))


#: Every query is a case: its first six hits are cited, and of three hits each says something in words of its text.
CASES = (
    "hits AS (SELECT query_id AS case_id, idx, key, doc_id, text FROM rankings JOIN documents USING (doc_id) WHERE idx <= 9)",
    "refs AS (SELECT case_id, key, lower(text) AS body FROM hits WHERE idx <= 6 AND case_id % 8 <> 5)",
    "said AS (SELECT case_id, idx AS claim, case_id % 7 = 3 OR doc_id % 5 = 0 AS may, doc_id % 4 <> 0 AS worded, key AS named, CASE WHEN doc_id % 3 = 0 THEN key END AS wanted, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 8)[1:2]) AS terms FROM hits WHERE idx IN (2, 5, 8) AND case_id % 9 <> 2)",
    "told AS (SELECT case_id, claim, NOT may AS must, worded, (SELECT count(*) FROM unnest(terms) x(w) WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.case_id = s.case_id AND contains(body, w))) = 0 AND (wanted IS NULL OR EXISTS (SELECT 1 FROM refs r WHERE r.case_id = s.case_id AND r.key = wanted)) AS supported, EXISTS (SELECT 1 FROM refs r WHERE r.case_id = s.case_id AND r.key = named) AS linked FROM said s)",
    "sums AS (SELECT case_id, count(*) AS claims, count(*) FILTER (must) AS must, count(*) FILTER (must AND supported) AS supported, count(*) FILTER (worded) AS worded, count(*) FILTER (worded AND linked) AS linked FROM told GROUP BY case_id)",
    "used AS (SELECT case_id, count(*) AS cited, count(*) FILTER (EXISTS (SELECT 1 FROM said s WHERE s.case_id = c.case_id AND s.named = c.key)) AS justified FROM (SELECT DISTINCT case_id, key FROM refs) c GROUP BY case_id)",
    "every AS (SELECT c.case_id, c.case_id % 6 <> 4 AS answerable, c.case_id % 13 = 6 AS infra, c.case_id % 10 = 7 AS abstained, CASE WHEN c.case_id % 3 = 0 THEN c.case_id % 7 - 1.0 END AS manual, CASE WHEN c.case_id % 2 = 0 THEN 0.5 END AS judge, coalesce(claims, 0) AS claims, coalesce(must, 0) AS must, coalesce(supported, 0) AS supported, coalesce(worded, 0) AS worded, coalesce(linked, 0) AS linked, coalesce(cited, 0) AS cited, coalesce(justified, 0) AS justified FROM (SELECT DISTINCT case_id FROM hits) c LEFT JOIN sums USING (case_id) LEFT JOIN used USING (case_id))",
)


@query(
    """SELECT case_id, claims, must AS must_claims, supported, must - supported AS unsupported, round(CASE WHEN must > 0 THEN supported / must::DOUBLE WHEN manual IS NOT NULL THEN greatest(0, least(1, manual / CASE WHEN manual > 1 THEN 5.0 ELSE 1.0 END)) ELSE judge END::DOUBLE, 6) AS faithfulness,
 CASE WHEN must > 0 THEN 'scored' WHEN manual IS NOT NULL THEN 'manual' WHEN judge IS NOT NULL THEN 'llm_judge' ELSE 'unsupported' END AS status,
 round(CASE WHEN infra THEN NULL WHEN NOT answerable OR abstained THEN CASE WHEN cited = 0 THEN 1 ELSE 0 END WHEN cited = 0 THEN 0 ELSE justified / cited::DOUBLE END::DOUBLE, 6) AS citation_linkage, round(CASE WHEN worded > 0 THEN linked / worded::DOUBLE WHEN cited > 0 THEN 0 END::DOUBLE, 6) AS claim_linkage FROM every""",
    *CASES,
)
def claim_scores(spark, d):
    """Claims of each case against the texts of what it cites."""
    texts = t.entries(spark, d).select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    hits = t.rankings(spark, d).where("idx <= 9").select(F.col("query_id").alias("case_id"), "idx", "key", "doc_id").join(texts, "doc_id")
    refs = hits.where("idx <= 6 and case_id % 8 <> 5").select("case_id", "key", "text")
    words = "slice(filter(split(lower(text), '[^a-z]+'), w -> length(w) >= 8), 1, 2)"
    said = hits.where("idx in (2, 5, 8) and case_id % 9 <> 2").selectExpr("case_id", "idx as claim", "if(doc_id % 4 <> 0, 'said', ' ') as text", f"{words} as terms", "if(doc_id % 3 = 0, array(key), null) as required", "array(key) as keys", "not (case_id % 7 = 3 or doc_id % 5 = 0) as must")
    cases = hits.select("case_id").distinct().selectExpr("case_id", "case_id % 6 <> 4 as answerable", "case_id % 13 = 6 as infra", "case_id % 10 = 7 as abstained", "if(case_id % 3 = 0, case_id % 7 - 1.0D, null) as manual", "if(case_id % 2 = 0, 0.5D, null) as judge")
    rows = claims.scores(cases, said, refs)
    return rows.select(*[F.round(c, 6).alias(c) if c in ("faithfulness", "citation_linkage", "claim_linkage") else c for c in rows.columns])
