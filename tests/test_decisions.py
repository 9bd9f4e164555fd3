"""Decisions on daily plans beside a plain loop that changes one item after another."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import decisions as dc

DAY = dt.date(2024, 3, 10)
TODOS = "id long, user_id long, parent_id long, is_done boolean, is_urgent boolean, due_date date"
ITEMS = "id long, todo_id long, plan_date date, status string, source string, carried_from_id long"
URGENT = "request_id long, user_id long, position long, todo_id long, decision string, expected long"
REVIEW = "request_id long, user_id long, todo_id long, selected boolean, expected long"


def new_id():
    return F.expr("todo_id * 1000 + 999")


def made(seed, count=60):
    rng = random.Random(seed)
    todos, items, depth = {}, {}, {}
    for i in range(1, count + 1):
        above = [p for p in todos if todos[p][1] == i % 3 and depth[p] < 3]
        parent = rng.choice(above) if above and rng.random() < 0.6 else None
        depth[i] = depth[parent] + 1 if parent else 0
        todos[i] = [i, i % 3, parent, rng.random() < 0.25, rng.random() < 0.4, rng.choice([None, DAY - dt.timedelta(2), DAY + dt.timedelta(2)])]
        for k in range(4):
            if rng.random() < 0.5:
                items[i * 1000 + k] = [i * 1000 + k, i, DAY - dt.timedelta(k), rng.choice(["active", "active", "completed", "carried", "returned"]), "manual", rng.choice([None, 7])]
    return todos, items


def below(todos, i):
    return [i] + [x for c in todos if todos[c][2] == i for x in below(todos, c)]


def past(items, i):
    return sorted((r for r in items.values() if r[1] == i and r[2] < DAY and r[3] == "active"), key=lambda r: (r[2], r[0]))


def put(todos, items, i, source):
    for j in sorted(x for x in below(todos, i) if x == i or not todos[x][3]):
        last = past(items, j)[-1][0] if past(items, j) else None
        now = next((r for r in items.values() if r[1] == j and r[2] == DAY), None)
        if now is None:
            items[j * 1000 + 999] = [j * 1000 + 999, j, DAY, "completed" if todos[j][3] else "active", source, last]
        elif now[3] in ("returned", "carried"):
            now[3:] = ["completed" if todos[j][3] else "active", source, now[5] if last is None else last]
        elif not (now[3] == "completed" and todos[j][3]):
            now[3], now[5] = "completed" if todos[j][3] else "active", last if now[5] is None else now[5]
        for r in past(items, j):
            r[3] = "carried"


def active_now(items, i):
    return any(r[1] == i and r[2] == DAY and r[3] == "active" for r in items.values())


def urgent(todos, items):
    return {i for i, t in todos.items() if t[2] is None and not t[3] and t[4] and not active_now(items, i) and ((t[5] and t[5] < DAY) or past(items, i))}


def urgent_loop(todos, items, asked):
    out, candidates, then = {}, urgent(todos, items), []
    for user in {r[1] for r in asked}:
        first, *later = sorted({r[0] for r in asked if r[1] == user})
        out |= {x: "deferred" for x in later}
        rows, seen, code = sorted((r for r in asked if r[0] == first), key=lambda r: r[2]), {}, None
        for r in rows:
            if code is None:
                code = "action" if r[4] not in ("keep", "delete") else None if r[3] not in seen else "duplicate" if seen[r[3]][4] == r[4] else "conflict"
                seen.setdefault(r[3], r)
        for r in seen.values():
            if code is None and not (r[3] is not None and r[3] not in todos and r[4] == "delete"):
                if r[3] not in todos or todos[r[3]][1] != user:
                    code = "unknown"
                elif r[5] is not None and r[5] != len(below(todos, r[3])) - 1:
                    code = "stale"
                elif r[3] not in candidates and not (r[4] == "keep" and active_now(items, r[3])):
                    code = "not_a_candidate"
        out[first] = code or "applied"
        then += [] if code else list(seen.values())
    for r in then:
        if r[4] == "delete" and r[3] in todos:
            for x in below(todos, r[3]):
                del todos[x]
                for k in [k for k, i in items.items() if i[1] == x]:
                    del items[k]
    for r in then:
        if r[4] == "keep" and r[3] in todos:
            put(todos, items, r[3], "rollover")
    return out


def review_loop(todos, items, asked):
    out, report = {}, {}
    barred = {x for i in urgent(todos, items) for x in below(todos, i)}
    live = {i for i, t in todos.items() if t[2] is None and not t[3] and not t[4] and not active_now(items, i) and past(items, i)}
    for user in sorted({r[1] for r in asked}):
        rows = sorted((r for r in asked if r[1] == user and r[2] in todos and todos[r[2]][1] == user), key=lambda r: r[2])
        out[user] = "stale" if any(r[4] is not None and r[4] != len(below(todos, r[2])) - 1 for r in rows) else "applied"
        for r in rows if out[user] == "applied" else []:
            i = r[2]
            if i in barred:
                continue
            if r[3]:
                if i in live or active_now(items, i):
                    put(todos, items, i, "rollover")
                    report[i] = "added"
                continue
            changed = [p for x in below(todos, i) for p in past(items, x)]
            for p in changed:
                p[3] = "returned"
            report[i] = "returned" if changed or i in live else "unchanged"
    return out, report


def told(df, *columns):
    return dict(map(tuple, df.select(*columns).collect()))


def rows_of(items):
    return sorted(map(tuple, items.values() if isinstance(items, dict) else items.select("id", "todo_id", "plan_date", "status", "source", "carried_from_id").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_urgent_decisions_beside_a_loop(spark, seed):
    rng = random.Random(seed)
    todos, items = made(seed)
    asked = [(u, u, i, i, rng.choice(["keep", "delete"]), rng.choice([None, len(below(todos, i)) - 1])) for i in sorted(urgent(todos, items)) for u in [todos[i][1]]]
    asked += [(u, u, 100 + i, i, "keep", None) for i in todos for u in [todos[i][1]] if active_now(items, i)]
    # A refused request for each rule, one that is deferred, and what is gone already; all of other users.
    one = min(todos)
    extra = [("action", "fly", one, None), ("unknown", "keep", 999, None), ("unknown", "keep", one, None), ("unknown", "keep", None, None), ("action", None, one, None)]
    asked += [(50 + k, 50 + k, 1, i, what, n) for k, (_, what, i, n) in enumerate(extra)]
    asked += [(70, 70, 1, 999, "delete", None), (71, 70, 1, 999, "delete", None), (80, 80, 1, 998, "delete", 3), (80, 80, 2, 998, "keep", None), (81, 81, 1, 998, "delete", None), (81, 81, 2, 998, "delete", None)]
    some = next(i for i in sorted(todos) if i not in urgent(todos, items) and not active_now(items, i))
    t, p, d = (spark.createDataFrame(x, s) for x, s in ((list(todos.values()), TODOS), (list(items.values()), ITEMS), (asked, URGENT)))
    judged = dc.urgent_judged(t, p, d, str(DAY))
    left, after = dc.urgent_applied(t, p, d, judged, str(DAY), new_id)
    # The same requests against the new state change nothing more, and known requests are replayed.
    again = dc.urgent_judged(left, after, d, str(DAY), judged.where("outcome = 'applied'"))
    twice = dc.urgent_applied(left, after, d, dc.urgent_judged(left, after, d, str(DAY)), str(DAY), new_id)[1]
    want = urgent_loop(todos, items, asked)
    assert told(judged, "request_id", "outcome") == want
    assert {"applied", "deferred", "action", "unknown", "conflict", "duplicate"} <= set(want.values())
    assert rows_of(after) == rows_of(items) == rows_of(twice) and {r["id"] for r in left.collect()} == set(todos)
    assert {k for k, v in told(again, "request_id", "outcome").items() if v == "replayed"} == {k for k, v in want.items() if v == "applied"}
    wrong = [(1, todos[some][1], 1, some, "keep", None)] if some in todos else []
    assert [r["outcome"] for r in dc.urgent_judged(left, after, spark.createDataFrame(wrong, URGENT), str(DAY)).collect()] == ["not_a_candidate"] * len(wrong)


@pytest.mark.parametrize("seed", [3, 4])
def test_reviews_of_past_plans_beside_a_loop(spark, seed):
    rng = random.Random(seed)
    todos, items = made(seed)
    asked = [(u, u, i, rng.random() < 0.6, len(below(todos, i)) - 1 + (u == 2 and i == 2)) for i in todos for u in [todos[i][1]] if rng.random() < 0.8 or i == 2]
    asked += [(0, 0, 999, True, None), (0, 0, 1, True, None), (0, 0, None, None, None)]
    t, p, d = (spark.createDataFrame(x, s) for x, s in ((list(todos.values()), TODOS), (list(items.values()), ITEMS), (asked, REVIEW)))
    judged = dc.rollover_judged(t, d)
    steps = dc.rollover_steps(t, p, d, judged, str(DAY))
    after, report = dc.rollover_applied(t, p, steps, str(DAY), new_id), told(dc.rollover_report(p, steps, str(DAY)), "todo_id", "action")
    want, actions = review_loop(todos, items, asked)
    assert told(judged, "request_id", "outcome") == want and "stale" in want.values()
    assert report == actions and {"added", "returned"} <= set(actions.values())
    assert rows_of(after) == rows_of(items)


def test_nothing_asked_changes_nothing(spark):
    todos, items = made(5, 12)
    t, p = spark.createDataFrame(list(todos.values()), TODOS), spark.createDataFrame(list(items.values()), ITEMS)
    none = spark.createDataFrame([], URGENT)
    judged = dc.urgent_judged(t, p, none, str(DAY))
    assert judged.count() == 0 and rows_of(dc.urgent_applied(t, p, none, judged, str(DAY), new_id)[1]) == rows_of(items)
    empty = dc.urgent_applied(t.where("false"), p.where("false"), none, judged, str(DAY), new_id)
    assert empty[0].count() == 0 == empty[1].count()
