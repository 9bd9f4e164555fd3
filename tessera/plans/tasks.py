"""Queries over tasks and daily plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import planning, tree
from tessera.plans.registry import query
from tessera.sources import tables as t

DAY = t.TASK_DAY
ORDER = """is_done, CASE WHEN NOT is_done THEN NOT is_urgent END NULLS LAST, CASE WHEN NOT is_done THEN priority END NULLS LAST,
 CASE WHEN NOT is_done THEN due_date END NULLS LAST, CASE WHEN NOT is_done THEN created_on END DESC NULLS LAST,
 CASE WHEN is_done THEN coalesce(completed_on, DATE '1970-01-01') END DESC NULLS LAST"""
ROOTS = "rooted AS (SELECT id, arg_max(ancestor, distance) AS root, CAST(max(distance) AS BIGINT) AS depth FROM closure GROUP BY id)"
PAST = f"past AS (SELECT todo_id, max(plan_date) AS plan_date, arg_max(id, plan_date) AS item_id FROM plan_items WHERE plan_date < DATE '{DAY}' AND status = 'active' GROUP BY todo_id)"
ACTIVE = f"active AS (SELECT todo_id FROM plan_items WHERE plan_date = DATE '{DAY}' AND status = 'active')"
META = """meta AS (SELECT c.ancestor AS id, count(*) FILTER (c.distance = 1) AS children, count(*) FILTER (c.distance > 0) AS descendants,
 count(*) FILTER (c.distance > 0 AND NOT t.is_done) AS open_descendants FROM closure c JOIN todos t ON t.id = c.id GROUP BY c.ancestor)"""


@query(
    f"""SELECT user_id, position, todo_id, priority, is_urgent, due_date, depth, status, completed, roots, roots_completed,
 CASE WHEN roots = 0 THEN 0.0 ELSE round_even(CAST(roots_completed AS DOUBLE) / roots * 100, 1) END AS rate
FROM (SELECT t.user_id, row_number() OVER (PARTITION BY t.user_id ORDER BY {ORDER}, t.id) AS position, t.id AS todo_id, priority, is_urgent, due_date, depth, status,
 is_done OR status = 'completed' AS completed, count(*) FILTER (parent_id IS NULL) OVER (PARTITION BY t.user_id) AS roots,
 count(*) FILTER (parent_id IS NULL AND (is_done OR status = 'completed')) OVER (PARTITION BY t.user_id) AS roots_completed
 FROM todos t JOIN (SELECT todo_id, status FROM plan_items WHERE plan_date = DATE '{DAY}' AND status IN ('active', 'completed')) i ON i.todo_id = t.id JOIN rooted r ON r.id = t.id)""",
    ROOTS,
)
def today_plan(spark, d):
    return planning.today(t.todos(spark, d), t.plan_items(spark, d), DAY)


@query(f"SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY {ORDER}, id) AS position FROM todos")
def todo_list_sorted(spark, d):
    return tree.listed(t.todos(spark, d)).select("user_id", "id", "position")


@query("SELECT r.id, root, depth, children, descendants, open_descendants FROM rooted r JOIN meta m ON m.id = r.id", ROOTS, META)
def todo_tree_metadata(spark, d):
    return tree.metadata(t.todos(spark, d))


@query("SELECT m.id, open_descendants FROM meta m JOIN todos t ON t.id = m.id WHERE NOT t.is_done AND open_descendants > 0", META)
def todo_incomplete_gate(spark, d):
    return tree.blocked(t.todos(spark, d))


@query(
    "SELECT id, root, depth, row_number() OVER (PARTITION BY root ORDER BY path) AS position FROM (SELECT c.id, r.root, r.depth, string_agg(printf('%010d.%012d', CASE WHEN a.parent_id IS NULL THEN 0 ELSE coalesce(a.sort_order, 2147483648) END, a.id), '/' ORDER BY distance DESC) AS path FROM closure c JOIN todos a ON a.id = c.ancestor JOIN rooted r ON r.id = c.id GROUP BY c.id, r.root, r.depth)",
    ROOTS,
)
def todo_preorder(spark, d):
    return tree.preorder(t.todos(spark, d))


@query(f"SELECT id, row_number() OVER (PARTITION BY user_id, parent_id ORDER BY {ORDER}, id DESC) - 1 AS position FROM todos")
def todo_sibling_backfill(spark, d):
    return tree.sibling_positions(t.todos(spark, d)).select("id", "position")


@query("SELECT DISTINCT a.id FROM todos c JOIN closure x ON x.id = c.id AND x.distance > 0 JOIN todos a ON a.id = x.ancestor WHERE NOT c.is_done AND a.is_done")
def reopened_ancestors(spark, d):
    todos = t.todos(spark, d)
    return tree.reopened(todos, todos.where("not is_done"))


@query("SELECT t.id, t.user_id FROM todos t WHERE t.is_urgent AND NOT EXISTS (SELECT 1 FROM closure c JOIN todos a ON a.id = c.ancestor WHERE c.id = t.id AND c.distance > 0 AND a.is_urgent)")
def urgent_topmost(spark, d):
    todos = t.todos(spark, d)
    return tree.topmost(todos, todos.where("is_urgent").select("id", "user_id"))


@query(
    f"SELECT user_id, total, done, total - done AS pending, CASE WHEN total = 0 THEN 0.0 ELSE round_even(CAST(done AS DOUBLE) / total * 100, 1) END AS rate FROM (SELECT user_id, count(*) AS total, count(*) FILTER (is_done) AS done FROM todos WHERE parent_id IS NULL AND date_trunc('week', created_on) = date_trunc('week', DATE '{DAY}') GROUP BY user_id)"
)
def weekly_stats(spark, d):
    return planning.weekly(t.todos(spark, d), DAY)


@query("SELECT todo_id, plan_date, item_id FROM past", PAST)
def plan_latest_past_active(spark, d):
    return planning.latest_past_active(t.plan_items(spark, d), DAY)


@query(f"SELECT id, user_id, coalesce(due_date - DATE '{DAY}' BETWEEN 0 AND 3, false) AS expiring, coalesce(NOT is_done AND due_date < DATE '{DAY}', false) AS overdue, priority FROM todos")
def todo_flags(spark, d):
    return planning.flags(t.todos(spark, d), DAY)


@query(
    f"SELECT id, user_id, reasons FROM (SELECT t.id, t.user_id, concat_ws(',', CASE WHEN t.due_date < DATE '{DAY}' THEN 'overdue' END, CASE WHEN p.todo_id IS NOT NULL THEN 'past_active_plan' END) AS reasons FROM todos t LEFT JOIN past p ON p.todo_id = t.id WHERE NOT is_done AND is_urgent AND parent_id IS NULL AND t.id NOT IN (SELECT todo_id FROM active)) WHERE reasons <> ''",
    PAST,
    ACTIVE,
)
def urgent_candidates(spark, d):
    return planning.urgent_candidates(t.todos(spark, d), t.plan_items(spark, d), DAY)


@query("SELECT t.id, t.user_id, p.plan_date, p.item_id FROM todos t JOIN past p ON p.todo_id = t.id WHERE NOT is_done AND NOT is_urgent AND parent_id IS NULL AND t.id NOT IN (SELECT todo_id FROM active)", PAST, ACTIVE)
def rollover_candidates(spark, d):
    return planning.rollover_candidates(t.todos(spark, d), t.plan_items(spark, d), DAY)


@query(
    f"""SELECT todo_id, item_id, action, CASE WHEN asked THEN 'active' ELSE status END AS new_status, CASE WHEN action = 'created' THEN carried END AS carried_from_id
FROM (SELECT todo_id, n.id AS item_id, n.status, q.id IS NOT NULL AS asked, p.item_id AS carried, CASE WHEN q.id IS NOT NULL AND n.id IS NULL THEN 'created' WHEN q.id IS NOT NULL AND status <> 'active' THEN 'reactivated' WHEN q.id IS NOT NULL THEN 'unchanged' ELSE 'not_requested' END AS action
 FROM (SELECT * FROM plan_items WHERE plan_date = DATE '{DAY}') n FULL JOIN (SELECT id, id AS todo_id FROM todos WHERE is_urgent AND NOT is_done) q USING (todo_id) LEFT JOIN past p USING (todo_id))""",
    PAST,
)
def plan_transitions(spark, d):
    wanted = t.todos(spark, d).where("is_urgent and not is_done").select(F.col("id").alias("todo_id"))
    return planning.transitions(t.plan_items(spark, d), wanted, DAY)


@query(
    f"SELECT user_id, count(*) FILTER (EXISTS (SELECT 1 FROM plan_items p WHERE p.todo_id = t.id AND plan_date = DATE '{DAY}')) AS plan_unfinished, count(*) FILTER (is_urgent AND due_date < DATE '{DAY}') AS urgent_overdue FROM todos t WHERE parent_id IS NULL AND NOT is_done GROUP BY user_id"
)
def notification_counts(spark, d):
    return planning.notification_counts(t.todos(spark, d), t.plan_items(spark, d), DAY)


@query("SELECT c.id, string_agg(trim(a.content, ' '), ' / ' ORDER BY distance DESC) AS path FROM closure c JOIN todos a ON a.id = c.ancestor GROUP BY c.id")
def todo_paths(spark, d):
    return tree.paths(t.todos(spark, d))


@query(
    """SELECT id, kind || '：' || content || chr(10) || '状态：' || CASE WHEN is_done THEN '已完成' ELSE '未完成' END || CASE WHEN parent_id IS NULL THEN chr(10) || '优先级：' || priority || chr(10) || '紧急：' || CASE WHEN is_urgent THEN '是' ELSE '否' END || coalesce(chr(10) || '截止日期：' || CAST(due_date AS VARCHAR), '') ELSE '' END || coalesce(chr(10) || '完成时间：' || CAST(completed_on AS VARCHAR), '') AS text,
 sha256('{"completed_at":' || coalesce('"' || CAST(completed_on AS VARCHAR) || '"', 'null') || ',"content":"' || content || '","due_date":' || CASE WHEN parent_id IS NULL THEN coalesce('"' || CAST(due_date AS VARCHAR) || '"', 'null') ELSE 'null' END || ',"is_step":' || CASE WHEN parent_id IS NULL THEN 'false' ELSE 'true' END
  || ',"priority":' || CASE WHEN parent_id IS NULL THEN '"' || priority || '"' ELSE 'null' END || ',"status":"' || CASE WHEN is_done THEN 'completed' ELSE 'open' END || '","urgent":' || CASE WHEN parent_id IS NULL AND is_urgent THEN 'true' ELSE 'false' END || '}') AS content_hash
 FROM (SELECT *, CASE WHEN parent_id IS NULL THEN '小要事' ELSE '子任务步骤' END AS kind FROM todos)"""
)
def todo_index_texts(spark, d):
    return tree.index_texts(t.todos(spark, d))
