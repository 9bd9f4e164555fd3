"""Small fixtures for rules that depend on order, ties, edges and missing values."""

import random
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import admission, answers, catalog, evaluation, families, fusion, memory, planning, products, quality, queues, retrieval, scopes, tree
from tessera.streaming import events

TODO = "id long, parent_id long, user_id long, sort_order long, content string, priority string, is_urgent boolean, is_done boolean, due_date date, created_on date, completed_on date"
DAY = date(2024, 3, 13)


def todo(i, parent=None, priority="P2", urgent=False, done=False, due=None, completed=None, order=None):
    return (i, parent, 1, order, "task", priority, urgent, done, due, DAY, completed)


def test_task_order(spark):
    rows = [todo(1, priority="P2", due=date(2024, 3, 14)), todo(2, priority="P0"), todo(3, priority="P0", due=date(2024, 3, 15)), todo(4, priority="P1", done=True, completed=DAY), todo(5, priority="P4", urgent=True)]
    got = tree.listed(spark.createDataFrame(rows, TODO)).orderBy("position").collect()
    assert [r["id"] for r in got] == [5, 3, 2, 1, 4]


def test_unknown_priority_sorts_last(spark):
    rows = [todo(1, priority=None), todo(2, priority="P9"), todo(3, priority="p3")]
    got = tree.listed(spark.createDataFrame(rows, TODO)).orderBy("position").collect()
    assert got[0]["id"] == 3


def test_trees_with_cycles_gaps_and_depth(spark):
    rows = [todo(1), todo(2, 1), todo(3, 2), todo(4, 3), todo(5, 4), todo(6, 7), todo(7, 6), todo(8, 99)]
    got = {(r["id"], r["reason"]) for r in tree.corrupt(spark.createDataFrame(rows, TODO)).collect()}
    assert got == {(5, "too_deep"), (6, "cycle"), (7, "cycle"), (8, "missing_parent")}


def test_preorder_with_missing_orders(spark):
    rows = [todo(1), todo(2, 1, order=None), todo(3, 1, order=2), todo(4, 1, order=0), todo(5, 4, order=1)]
    got = tree.preorder(spark.createDataFrame(rows, TODO)).orderBy("position").collect()
    assert [r["id"] for r in got] == [1, 4, 5, 3, 2]


def test_completion_rounds_halves_to_even(spark):
    rows = spark.createDataFrame([(1, 3), (1, 8), (0, 0), (1, 16)], "a long, b long")
    assert [r[0] for r in rows.select(planning.share(F.col("a"), F.col("b"))).collect()] == [33.3, 12.5, 0.0, 6.2]


def test_plan_transitions(spark):
    items = spark.createDataFrame([(10, 1, date(2024, 3, 12), "active"), (11, 2, DAY, "returned"), (12, 3, DAY, "active"), (13, 4, DAY, "completed")], "id long, todo_id long, plan_date date, status string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "todo_id long")
    got = {r["todo_id"]: (r["action"], r["new_status"], r["carried_from_id"]) for r in planning.transitions(items, asked, "2024-03-13").collect()}
    assert got == {1: ("created", "active", 10), 2: ("reactivated", "active", None), 3: ("unchanged", "active", None), 4: ("not_requested", "completed", None)}


def test_fusion_repeats_ties_and_missing_weights(spark):
    rows = [(1, 0, 1, "a", 0.9), (1, 0, 2, "b", 0.8), (1, 1, 1, "b", 0.1), (1, 0, 3, "a", 0.95), (1, 9, 1, "c", 5.0)]
    got = {r["key"]: r for r in fusion.rrf(spark.createDataFrame(rows, "query_id long, list_idx int, rank long, key string, relevance double")).collect()}
    assert abs(got["a"]["rrf"] - (1 / 61 + 1 / 63)) < 1e-8 and abs(got["b"]["rrf"] - (1 / 62 + 0.9 / 61)) < 1e-8
    assert abs(got["c"]["rrf"] - 1 / 61) < 1e-8 and got["c"]["relevance"] == 5.0
    assert got["b"]["source_reason"] == "hybrid_rrf" and got["a"]["source_reason"] == "single"
    tie = [(1, 1, 1, "z", 0.0), (1, 0, 1, "y", 0.0)]
    same = fusion.rrf(spark.createDataFrame(tie, "query_id long, list_idx int, rank long, key string, relevance double"), weights=())
    assert [r["key"] for r in same.orderBy("rank").collect()] == ["y", "z"]


def test_malformed_keys_are_dropped_before_ranking(spark):
    rows = [(1, 0, 1, "bad"), (1, 0, 2, "note:chunk:7"), (1, 0, 3, "note:page:8"), (1, 0, 4, "note:entry:9")]
    got = fusion.rrf_keys(spark.createDataFrame(rows, "query_id long, list_idx int, rank long, key string")).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["note:chunk:7", "note:entry:9"] and abs(got[0]["rrf"] - 1 / 61) < 1e-8


def test_attachment_chunk_takes_its_mirrors_place(spark):
    rows = [(1, 1, "m", "o", "mirror"), (1, 2, "x", "p", "mirror"), (1, 3, "c", "o", "attachment_chunk")]
    got = {r["key"]: (r["position"], r["kept"], r["duplicate_of"]) for r in fusion.mirrors_merged(spark.createDataFrame(rows, "query_id long, rank long, key string, origin string, source_type string")).collect()}
    assert got == {"m": (1, False, "c"), "c": (1, True, None), "x": (2, True, None)}


def admit(spark, rows, **options):
    found = admission.admitted(spark.createDataFrame([(1, i, c, s) for i, (c, s) in enumerate(rows)], "query_id long, idx long, channel string, score double"), **options)
    return [r["idx"] for r in found.orderBy("idx").collect()]


def test_admission_gate(spark):
    assert admit(spark, [("lexical", 0.0)] * 10) == list(range(10))
    assert admit(spark, [("other", 0.9), ("lexical", 0.0), ("other", 0.9)]) == [0, 1, 2]
    rows = [("entry", 0.9), ("entry", 0.8999), *[("entry", 0.5)] * 3, *[("lexical", 0.0)] * 8, ("other", 1.0)]
    assert admit(spark, rows) == [0, 1, 2, *range(5, 13)]
    assert admit(spark, rows, use_floors=False) == [0, 1, *range(5, 13)]


def test_dense_vectors_without_length(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_tokens_and_terms(spark):
    df = spark.createDataFrame([("ＡＢＣ中文字x9 the-the", " ".join(f"word{i}" for i in range(20)))], "a string, b string")
    r = df.select(tx.tokens(F.col("a")).alias("t"), tx.keyword_terms(F.col("b")).alias("k"), tx.split_scripts(F.lit("中a中1")).alias("s"), tx.compatible(F.lit("ﬁ①")).alias("n")).first()
    assert r["t"] == ["abc", "中文字", "中文", "文字", "x9", "the"] and len(r["k"]) == 12 and r["s"] == "中 a 中 1" and r["n"] == "fi1"


def test_synonyms_are_one_level(spark):
    got = spark.range(1).select(tx.expanded(F.array(F.lit("a"), F.lit("b")), {"a": ["b", "c"], "c": ["d"]})).first()[0]
    assert got == ["a", "b", "c"]


def test_covered_share(spark):
    df = spark.createDataFrame([([0, 5, 8], 10), ([0], 0)], "s array<long>, n int")
    assert [r[0] for r in df.select(tx.covered(F.col("s"), F.col("n"), 4)).collect()] == [0.9, 0.0]


def test_quality_gates(spark):
    plain = "The plain words of a text that has vowels, and spaces between its words. "
    texts = ["", "中文内容测试文字", "if (a) {\n b[1] = c; } while (x) { y(); }", plain, "bcd fgh jkl mnp qrs tvw xz bcd fgh jkl mnp qrs", "abc�", plain + "Ã©", plain + "\u200b", plain * 2, "12 34", plain + "中文内容测试文字中文内容测试文字中文内容测试文字", None]
    sure = [None, None, None, None, None, None, None, None, 0.3, None, None, None]
    stats = quality.statistics(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    known = spark.createDataFrame([(i, c, "failed" if i == 10 else "succeeded") for i, c in enumerate(sure)], "id long, confidence double, run string")
    got = {r["id"]: r for r in quality.verdicts(stats.join(known, "id")).collect()}
    reasons = {i: r["reason"] for i, r in got.items()}
    assert reasons[0] == reasons[11] == "empty_text" and reasons[10] == "runtime_failed" and reasons[1] == reasons[2] == reasons[3] == "ok"
    assert reasons[4] == "unknown_latin_untrusted" and reasons[8] == "confidence_below_threshold" and reasons[9] == "unknown_needs_review"
    assert reasons[5] == reasons[6] == reasons[7] == "mojibake_or_disallowed_unicode"
    assert got[1]["profile"] == "cjk_primary" and got[2]["profile"] == "code_like" and got[3]["profile"] == "latin_primary" and got[10]["profile"] == "mixed"
    assert all(r["search_eligible"] == (r["status"] == "ok") and (r["score"] >= 0.55) == r["search_eligible"] for r in got.values())


def test_long_texts_are_measured_whole(spark):
    letters = "bcd fgh jklm npq rst vwx z"
    texts = [letters * n for n in (1, 40, 400)] + ["é" * 5000 + "ß" * 10 + "z", "Ａ ſ"]
    rows = quality.statistics(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id").collect()
    assert [r["unique_latin"] for r in rows] == [20, 20, 20, 3, 2] and [r["chars"] for r in rows] == [len(x) for x in texts]
    base = spark.createDataFrame([(0, "bcdfghjklmnpqrstvwxz " * n) for n in (2,)] + [(1, "bcdfghjklmnpqrstvwxz " * 300)], "id long, text string")
    stats = quality.statistics(base).withColumns({"confidence": F.lit(None).cast("double"), "run": F.lit("succeeded")})
    assert {r["reason"] for r in quality.verdicts(stats).collect()} == {"unknown_latin_untrusted"}


def test_classes_beside_single_characters(spark):
    text = "Aé中7{\u200b\t \u00a0ÃŽ\ufffd\x1c=Ω\n;"
    r = quality.statistics(spark.createDataFrame([(1, text)], "id long, text string")).collect()[0]
    assert (r.cjk, r.latin, r.digits, r.symbols, r.noise, r.broken, r.vowels, r.spaces, r.disallowed) == (1, 4, 1, 3, 3, 1, 3, 5, True)


def test_queries_beyond_one_block(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(30)], "id long, content_vector array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(25)] + [(99, [0.0, 0.0])], "query_id long, query_vector array<double>")
    whole = sorted(map(tuple, retrieval.dense(asked, rows).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, retrieval.dense(asked, rows).collect())) == whole and 99 not in {r[0] for r in whole}


def test_breadcrumbs_stop_at_cycles_and_missing_parents(spark):
    pages = spark.createDataFrame([(1, None, "A"), (2, 1, "B"), (3, 2, "C"), (4, 5, "X"), (5, 4, "Y"), (6, 77, "Z")], "id long, parent_id long, title string")
    got = {r["id"]: r["breadcrumb"] for r in catalog.breadcrumbs(pages).collect()}
    assert got == {1: "A", 2: "A / B", 3: "A / B / C", 4: "Y / X", 5: "X / Y", 6: "Z"}


def test_quiet_hours(spark):
    df = spark.createDataFrame([(60, 60, 60), (59, 60, 120), (60, 60, 120), (120, 60, 120), (5, 1380, 60), (1400, 1380, 60), (60, 1380, 60)], "m int, s int, e int")
    assert [r[0] for r in df.select(queues.quiet(F.col("m"), F.col("s"), F.col("e"))).collect()] == [False, False, True, False, True, True, False]


def test_metrics_edges(spark):
    ranked = spark.createDataFrame([(1, "r", 1, "a"), (1, "r", 2, " a "), (1, "r", 3, ""), (1, "r", 4, "b"), (2, "r", 1, "z")], "case_id long, retriever string, rank long, key string")
    qrels = spark.createDataFrame([(1, "b", 3), (1, "c", 1)], "case_id long, key string, relevance int")
    got = {r["case_id"]: r for r in evaluation.metrics(ranked, qrels, k=20).collect()}
    assert (got[1]["recall"], got[1]["precision"], got[1]["mrr"]) == (0.5, 0.5, 0.5)
    assert (got[2]["recall"], got[2]["ndcg"], got[2]["hit"]) == (0.0, 0.0, False)


def test_empty_runs_agree(spark):
    runs = spark.createDataFrame([(1, 0, []), (1, 1, []), (2, 0, ["a"]), (2, 1, ["a", "b"])], "case_id long, run int, keys array<string>")
    assert {r["case_id"]: (r["jaccard"], r["all_equal"]) for r in evaluation.agreement(runs).collect()} == {1: (1.0, True), 2: (0.5, False)}


def test_two_passes_and_a_third(spark):
    schema = "query_id long, key string, relevant boolean"
    a, b, c = (spark.createDataFrame(x, schema) for x in ([(1, "x", True), (1, "y", True), (1, "z", True)], [(1, "x", True), (1, "y", False)], [(1, "y", False)]))
    one = {r["key"]: r["relevant"] for r in admission.judgments_merged(a, b, c, list_all=False).collect()}
    every = {r["key"]: r["relevant"] for r in admission.judgments_merged(a, b, c, list_all=True).collect()}
    assert one == {"x": True, "y": False, "z": True} and every == {"x": True, "y": True, "z": True}


def test_memories_that_repeat_or_contradict(spark):
    rows = [(1, "I like green tea!"), (2, "i like GREEN tea"), (3, "Well, I like green tea a lot"), (4, "别 I like green tea"), (5, "coffee"), (6, "，。"), (7, "不要 I drink so much coffee"), (8, "I drink much coffee")]
    df = spark.createDataFrame([(1, "fact", i, t) for i, t in rows], "user_id int, type string, id int, content string")
    got = lambda i, **how: {(r["memory"], r["kind"], r["similarity"]) for r in memory.repeats(df.where(f"id = {i}"), df, **how).collect()}
    assert {(m, k) for m, k, _ in got(1)} == {(2, "possible_duplicate"), (3, "possible_duplicate"), (4, "possible_duplicate")}
    assert (2, "possible_duplicate", 1.0) in got(1) and len(got(1, most=1)) == 1
    assert {(m, k) for m, k, _ in got(7)} == {(8, "possible_conflict")} and got(6) == set() == got(5)


def alike(a, b):
    """Whether and how two memories repeat each other, by their definition."""
    strip = lambda t: re.sub(memory.PUNCTUATION, "", re.sub(r"\s+", " ", t).strip()[:2000].lower())
    bare = lambda t: re.sub("|".join(sorted(memory.NEGATIONS, key=len, reverse=True)), "", t)
    grams = lambda t: {t[i : i + 2] for i in range(max(1, len(t) - 1))} - {""}
    share = lambda x, y: len(grams(x) & grams(y)) / len(grams(x) | grams(y)) if grams(x) | grams(y) else 0.0
    inside = lambda x, y: min(len(x), len(y)) >= 8 and (x in y or y in x)
    s, o = strip(a), strip(b)
    if not s or not o:
        return None
    if s == o or inside(s, o) or share(s, o) >= 0.82:
        return "possible_duplicate"
    p, q = bare(s), bare(o)
    return "possible_conflict" if (s != p) != (o != q) and (inside(p, q) or share(p, q) >= 0.68) else None


def test_repeats_beside_all_pairs_and_few_are_compared(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    for i in range(0, 300, 5):  # copies, edits, parts, denials
        j, one = rng.randrange(300), texts[rng.randrange(300)]
        texts[j] = [one, one + "!", one + " " + rng.choice(words), " ".join(one.split()[1:]) or one, "不要 " + one, "别" + one[:-2]][i % 6]
    rows = [(i % 2, "fact" if i % 3 else "goal", i, t) for i, t in enumerate(texts)] + [(0, None, 900, texts[0]), (0, "fact", 901, None), (0, "fact", 902, "，。")]
    df = spark.createDataFrame(rows, "user_id int, type string, id int, content string")
    asked = df.where("id % 3 = 0 or id > 899")
    got = {}
    for r in memory.repeats(asked, df, most=1000).collect():
        got.setdefault(r["candidate"], {})[r["memory"]] = r["kind"]
    want = {}
    for u, k, i, t in rows:
        for v, m, j, o in rows:
            if (i % 3 == 0 or i > 899) and i != j and u == v and k is not None and k == m and t and o and (kind := alike(t, o)):
                want.setdefault(i, {})[j] = kind
    assert got == want and {k for d in got.values() for k in d.values()} == {"possible_duplicate", "possible_conflict"}
    (new, _), (old, _) = memory.classes_of(asked, 1), memory.classes_of(df, 6)
    group = {(u, k): sum(1 for r in rows if r[:2] == (u, k)) for u, k, _, _ in rows}
    assert memory.candidate_pairs(new, old, 0.82, 0.68, 8).count() < 0.2 * sum(group[r[:2]] for r in rows if r[2] % 3 == 0)
    assert memory.repeats(asked.where("false"), df).count() == 0 == memory.repeats(asked, df.where("false")).count()


def test_merged_memories_take_what_fills_the_text(spark):
    rows = [(1, "fact", i, f"{'Aa'[i % 2]}{i // 2}", i / 100) for i in range(80)] + [(1, "fact", -1, None, 0.9), (None, None, 1, "x", None), (2, "goal", 1, None, 0.5)]
    df = spark.createDataFrame(rows, "user_id int, type string, id int, content string, confidence double")
    got = {(r["user_id"], r["type"]): (r["content"], r["confidence"]) for r in memory.merged(df, chars=25).collect()}
    assert got == {(1, "fact"): ("; ".join(f"A{i}" for i in range(40))[:25], 0.9), (None, None): ("x", None), (2, "goal"): ("", 0.5)}


def test_failures_name_the_first_rule_that_holds(spark):
    cases = spark.createDataFrame([(i, i != 1, i != 2) for i in range(1, 10)], "case_id long, comparable boolean, answerable boolean")
    hit = {3: "", 4: "k", 5: "v", 6: "kv", 7: "kvh", 8: "kvh", 9: "kvh"}
    mrr = {(7, "h"): 0.5, (7, "v"): 0.5 + 1e-8, (9, "h"): 0.5, (9, "v"): 0.5 + 1e-10}
    names = {"k": "keyword", "v": "vector", "h": "hybrid"}
    per = [(c, names[r], r in on, mrr.get((c, r), 0.5 if r in on else 0.0)) for c, on in hit.items() for r in "kvh"]
    per_case = spark.createDataFrame(per, "case_id long, retriever string, hit boolean, mrr double")
    hybrid = spark.createDataFrame([(c, 1, "note:1") for c in (7, 8, 9)], "case_id long, rank long, key string")
    qrels = spark.createDataFrame([(8, "note:1", 1), (8, "page:2", 3), (9, "note:1", 2)], "case_id long, key string, relevance int")
    got = {r["case_id"]: r["failure"] for r in evaluation.failures(cases, per_case, hybrid, qrels).collect()}
    assert got == {1: "unsupported_comparison", 2: None, 3: "all_retrievers_missed", 4: "keyword_only_hit", 5: "vector_only_hit", 6: "fusion_regression", 7: "rank_regression", 8: "wrong_source", 9: None}


def test_setting_is_chosen_among_near_ties(spark):
    settings = evaluation.grid([10, 60], [(1.0, 0.0), (1.0, 0.5), (1.0, 0.9)])
    scores = [(0, 0.9, 0.9, 0.9, 0), (1, 0.700, 0.60, 0.8, 3), (2, 0.705, 0.60, 0.8, 3), (3, 0.9, 0.9, 0.9, 0), (4, 0.701, 0.595, 0.8, 3), (5, 0.2, 0.2, 0.8, 0)]
    frame = spark.createDataFrame(scores, "config int, mrr double, ndcg double, recall double, regressions long")
    vector = spark.createDataFrame([(0.7, 0.8)], "b_mrr double, b_recall double")
    got = {r["config"]: r for r in evaluation.chosen(frame, vector, settings).collect()}
    assert got[0]["reasons"] == got[3]["reasons"] == "degenerate_keyword_weight_zero" and got[5]["reasons"] == "mrr@10_below_vector_gate"
    assert [c for c, r in got.items() if r["selected"]] == [4] and got[2]["position"] == 1
    none = evaluation.chosen(frame.where("config in (0, 3)"), vector, settings).collect()
    assert not any(r["selected"] for r in none) and "missing_metrics" in {r["reasons"] for r in none}


def test_context_never_exceeds_a_cap(spark):
    rows = [(1, "dense", f"d{i}", i) for i in range(3)] + [(1, "keyword", f"k{i}", i) for i in range(9)] + [(1, "keyword", "d0", -1), (1, "other", "d1", 0), (1, "other", "o", 1)]
    got = scopes.context(spark.createDataFrame(rows, "query_id long, bucket string, key string, rank long"), {"dense": 14, "keyword": 4, "attachment": 8, "other": 18}).orderBy("position").collect()
    assert [r["key"] for r in got] == ["d0", "k0", "d1", "d2", "k1", "k2", "k3", "o"]


def test_snapshots_hold_root_tasks_in_their_order(spark):
    rows = [todo(1, priority="p0"), todo(2, priority="P1"), todo(3, 2, priority="P0"), todo(4, priority="P1", due=DAY), todo(5, urgent=True, priority="P4"), todo(6, done=True), todo(7, done=True, completed=DAY)]
    got = scopes.snapshot_lists(spark.createDataFrame(rows, TODO)).orderBy("is_done", "rank").collect()
    assert [r["id"] for r in got] == [4, 2, 1, 5, 7, 6]


def test_plans_filter_by_all_of_their_tags(spark):
    schema = "user_id int, n int, key string, provider string, kind string, title string, tags array<string>, breadcrumb string, todo_status string, at string, answerable boolean"
    row = lambda n, key="k", **k: tuple({"user_id": 1, "n": n, "key": key, "provider": "record", "kind": "record", "title": "A Title", "tags": ["Red", "BLUE"], "breadcrumb": "Home / Work", "todo_status": None, "at": "2024-01-05T10:00", "answerable": True, **k}.values())
    refs = spark.createDataFrame([row(1), row(2), row(3, "b", tags=["red"]), row(4, "c", kind="todo", todo_status="open", at=None), row(5, "", answerable=False), row(6, "")], schema)
    got = lambda **k: [r["n"] for r in catalog.filtered(refs, catalog.Plan(**k)).orderBy("n").collect()]
    assert got() == [1, 3, 4, 5, 6] and got(tags=("red", "Blue")) == [1, 4, 5, 6] and got(tags=("blue", "green")) == []
    assert got(start="2024-01-05", end="2024-01-05") == [1, 3, 5, 6] and got(end="2024-01-04") == []
    assert got(todo_status="open") == [4] and got(named_source="work") == [1, 3, 4, 5, 6] and got(breadcrumb="HOME", answer_context=True) == [1, 3, 4, 6]


def test_paths_and_subtrees_of_any_depth(spark):
    chain = [(i, i - 1 if i else None, 1, f"t{i}") for i in range(13)] + [(20, 21, 1, "a"), (21, 20, 1, "b"), (30, 99, 1, "lost"), (40, 12, 2, "other")]
    pages = spark.createDataFrame(chain, "id long, parent_id long, user_id long, title string")
    got = {r["id"]: r["breadcrumb"] for r in catalog.breadcrumbs(pages).collect()}
    assert got[12] == " / ".join(f"t{i}" for i in range(13)) and got[30] == "lost" and got[20] == "b / a" and len(got) == len(chain)
    below = catalog.owned_subtree(pages, pages.where("id in (0, 20)")).collect()
    assert {(r["start"], r["id"], r["distance"]) for r in below} == {(0, i, i) for i in range(13)} | {(20, 20, 0), (20, 21, 1)}


def test_rollup_leaves_connections_without_a_login_alone(spark):
    hosts = spark.createDataFrame([(h, "reauth_required" if h == "e" else "connected", "old") for h in "abcdef"], "host string, status string, sync_status string")
    states = {"a": ["failed"], "b": ["failed", "indexed", "deleted"], "c": ["permission_lost"], "d": ["deleted"], "e": ["failed"], "f": ["processing", "failed", "partial"]}
    pages = spark.createDataFrame([(h, s) for h, ss in states.items() for s in ss], "host string, sync_status string")
    got = {r["host"]: (r["sync_status"], r["pages"]) for r in catalog.sync_rollup(hosts, pages).collect()}
    assert got == {"a": ("failed", 1), "b": ("partial", 2), "c": ("partial", 1), "d": ("ready", 0), "e": ("old", 1), "f": ("syncing", 3)}


def test_record_families_are_as_deep_as_they_are(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, i - 1 if i else None, 1, at) for i in range(12)] + [(50, 0, 1, datetime(2023, 1, 1)), (51, 0, 2, at), (60, 61, 1, at), (61, 60, 1, at)]
    found = families.record_families(spark.createDataFrame(rows, "id long, parent_id long, user_id long, created_at timestamp_ntz")).collect()
    assert {r["id"]: (r["root"], r["depth"]) for r in found} == {**{i: (0, i) for i in range(12)}, 50: (0, 1), 51: (51, 0)}
    assert [r["id"] for r in sorted(found, key=lambda r: r["path"]) if r["root"] == 0] == [0, 50, *range(1, 12)]


def test_small_text_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.body(F.lit(" T \nbody T"))) == "body T" and one(tx.embedding_body(F.lit("T\nbody T x"))) == "body  x" and one(tx.body(F.lit(None).cast("string"))) == ""
    assert [one(tx.public_title(F.lit(x))) for x in ("", " a\n b ", "记录 #12", "x 记录#9")] == ["记录", "a b", "记录", "x 记录"]
    assert [one(tx.vector_from(F.lit(x))) for x in ("[1, 2]", '"[1, 2]"', '"\\"[1]\\""', "no", '{"a": 1}')] == [[1.0, 2.0], [1.0, 2.0], [1.0], None, None]
    assert [one(tx.json_in(F.lit(x))) for x in ('{"a":1}', "so ```json\n{}\n``` ok", 'is {"a": {"b": 2}} it', "none", "{bad")] == ['{"a":1}', "{}", '{"a": {"b": 2}}', None, None]
    assert one(tx.sentences(F.lit("One! Two？三。four\nfive"))) == ["One!", "Two？", "三。", "four", "five"]
    assert one(tx.shortened(F.lit("abcdef"), 4)) == "abc…" and one(tx.normalised(F.lit(" ＡＢｃ  ﬁ "))) == "abc fi"


def test_leases_and_jobs(spark):
    claimed = spark.createDataFrame([("a", "w1", "claimed"), ("b", "w1", "done"), ("c", "w1", "claimed"), ("c", "w1", "claimed")], "key string, owner string, status string")
    beats = spark.createDataFrame([("a", 1, "w1", datetime(2024, 1, 1)), ("a", 2, "w2", None), ("b", 3, "w1", None), ("c", 4, "w1", None), ("z", 5, "w1", None)], "key string, id int, owner string, at timestamp_ntz")
    got = {r["id"]: r["renewed"] for r in queues.renewals(beats, claimed).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}
    asked = spark.createDataFrame([(1, "e1", 1, "s", None), (2, "e1", 1, "t", None), (3, None, 1, "s", None), (4, None, 2, "s", 5), (5, "old", 3, "s", 1), (6, None, 9, "s", None)], "id int, event_id string, connection_id int, job_type string, page_id int")
    had = spark.createDataFrame([("old", 8, "x", None, "succeeded"), (None, 9, "s", None, "retry"), (None, 2, "s", 5, "failed")], "event_id string, connection_id int, job_type string, page_id int, status string")
    assert {r["id"] for r in queues.enqueued(asked, had).collect()} == {1, 4}


def test_fingerprints_keep_nulls_and_sort_keys(spark):
    a, b = (spark.range(1).select(memory.fingerprint(x)).first()[0] for x in ({"b": F.lit(None).cast("string"), "a": F.lit(1)}, {"a": F.lit(1), "b": F.lit(None).cast("string")}))
    c = spark.range(1).select(memory.fingerprint({"a": F.lit(1)})).first()[0]
    assert a == b != c


def write_events(spark, path, rows):
    spark.createDataFrame([(i, t, u, k, 1.0, "{}") for i, t, u, k in rows], events.EVENT_SCHEMA).coalesce(1).write.parquet(f"{path}/events.parquet")


def test_stream_windows_and_claims(spark, tmp_path):
    at = lambda h, m, s=0: datetime(2024, 1, 1, h, m, s)
    rows = [(1, at(0, 0), 1, "a"), (2, at(0, 0, 30), 1, "a"), (3, at(0, 5), 1, "a"), (4, at(3, 0), 2, "b"), (5, at(3, 0), 2, "b")]
    write_events(spark, str(tmp_path / "in"), rows)
    folder = str(tmp_path / "in" / "events.parquet")
    stream = lambda: spark.readStream.schema(events.EVENT_SCHEMA).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r["n"] for r in events.finished(events.tumbling(stream()), mode="complete").collect()} == {3, 2}
    assert events.finished(events.once(stream(), ["user_id"]).select("user_id")).count() == 2
    got = {r["event_id"]: r["outcome"] for r in events.finished(events.claimed(stream())).collect()}
    assert got == {1: "acquired", 2: "in_progress", 3: "take_over", 4: "acquired", 5: "in_progress"}


def test_a_layers_winner(spark):
    rows = [(1, "a", 3, 0.5), (1, "b", 3, 0.4), (2, "a", 3, 0.5), (2, "b", 3, 0.5 + 1e-13), (3, "a", 0, 0.9), (4, "a", 3, None), (4, "b", 3, 0.1)]
    got = {r["layer"]: tuple(r)[1:] for r in evaluation.winner(spark.createDataFrame(rows, "layer int, retriever string, denominator long, mrr double")).collect()}
    assert got == {1: ("ok", "a", "a"), 2: ("ok", None, "a,b"), 3: ("unavailable", None, ""), 4: ("unavailable", None, "")}


def test_filtered_answers_claim_no_completeness(spark):
    rows = [("这里是全部相关的记录。", "lookup_all", "budget_filtered"), (" ", "lookup_all", "budget_filtered"), ("列出所有 PROMPT", "lookup_all", "complete"), ("所有的Prompt", "lookup_all", "budget_filtered")]
    df = spark.createDataFrame(rows, "a string, i string, s string")
    got = [r[0] for r in df.select(answers.scoped(F.col("a"), F.col("i"), F.col("s"))).collect()]
    assert got == ["为你筛选到以下相关记录。\n这里是相关记录", "为你筛选到以下相关记录。", "列出所有 PROMPT", "为你筛选到以下相关记录。\n相关记录"]


def test_hashes_of_tasks_ignore_place_and_order(spark):
    rows = spark.createDataFrame([todo(1, order=1), todo(2, 1, order=2, urgent=True, due=DAY), todo(3, 1, order=9, priority="P0")], TODO)
    moved = spark.createDataFrame([todo(1, order=7), todo(2, 1, order=0), todo(3, 2, order=9)], TODO)
    hashes = lambda df: {r["id"]: r["content_hash"] for r in tree.index_texts(df).collect()}
    assert hashes(rows) == hashes(moved)
    assert tree.index_texts(rows).where("id = 2").first()["text"] == "子任务步骤：task\n状态：未完成"
    assert {r["id"]: r["path"] for r in tree.paths(moved).collect()} == {1: "task", 2: "task / task", 3: "task / task / task"}


def test_vectors_meet_queries_in_blocks(spark):
    """Odd vectors score as by the expressions; what blocks hand on is bounded by queries and k, however many copies tie."""
    rng = random.Random(5)
    some = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(40)] + [[1.0, 0.0, 0.0, 0.0]] * 300
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 0.0, 0.0]]
    pool = [*odd, *some]
    rows = spark.createDataFrame([(i, i % 3, v, pool[(i * 7 + 1) % len(pool)]) for i, v in enumerate(pool)], "id long, label int, content_vector array<double>, title_vector array<double>").repartition(3)
    asked = spark.createDataFrame([(100 + i, v, i % 3) for i, v in enumerate([*odd, *some[:8], *some[-2:]])], "query_id long, query_vector array<double>, query_label int")
    pairs = asked.crossJoin(rows)
    cos = lambda c: vx.cosine(F.col(c), F.col("query_vector"))
    plain = lambda df: sorted((tuple(str(v) for v in r) for r in df.collect()))
    found = pairs.where(vx.norm(F.col("query_vector")) > 0).select("query_id", "id", F.round(vx.dot(vx.unit(F.col("content_vector")), vx.unit(F.col("query_vector"))), 6).alias("score")).where("score >= 0.35")
    assert plain(retrieval.dense(asked, rows, k=9)) == plain(retrieval.best(found, 9, F.desc("score"), F.asc("id")).select("query_id", "rank", "id", "score"))
    whole = "size(query_vector) = 4 and not isnan(query_vector[0])"  # what is no number counts where sizes agree
    asked = asked.where(whole)
    both = pairs.where(whole).select("query_id", "id", F.round(0.3 * cos("title_vector") + 0.7 * cos("content_vector"), 6).alias("score"))
    first = {}
    for r in retrieval.best(both, 9, F.desc("score"), F.asc("id")).collect():
        first.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    kept = [(q, *h) for q, hits in first.items() for h in hits if h[2] != h[2] or h[2] >= 0.35 or all(x[2] < 0.35 for x in hits)]
    assert plain(retrieval.entry_dense_fallback(asked, rows, k=9)) == sorted(tuple(str(v) for v in r) for r in kept)
    handed = products.nearest(asked.selectExpr("query_id", "query_vector as q"), rows.selectExpr("id", "content_vector as v").where("size(v) = 4").coalesce(1), {"v": ("q", 1.0)}, k=5)
    assert max(r["count"] for r in handed.groupBy("query_id").count().collect()) <= 5 * 2  # one block of whole vectors, one with a null entry


def test_memories_hand_on_first_finds_whatever_their_bigrams(spark, monkeypatch):
    """Bigrams without columns of their own lead to the same finds; blocks hand on no more than are told of a candidate."""
    rng = random.Random(8)
    said = ["".join(rng.choices("abcdefghij文字", k=rng.choice([3, 9, 14]))) for _ in range(60)]
    rows = [(i, "u", "t", one[:7] + rng.choice(["", "不"]) + one[7 : rng.choice([8, 20])]) for i in range(240) for one in [rng.choice(said)]]
    df = spark.createDataFrame(rows, "id long, user_id string, type string, content string")
    asked = df.where("id % 4 = 0")
    found = lambda: sorted(tuple(r) for r in memory.repeats(asked, df, most=4).collect())
    whole = found()
    monkeypatch.setattr(memory, "OWN", 5)
    assert whole == found() and {r[2] for r in whole} == {"possible_duplicate", "possible_conflict"}
    (new, _), (old, _) = memory.classes_of(asked, 1), memory.classes_of(df, 5)
    handed = memory.compared(new, old.coalesce(1), 0.1, 0.1, 8, 5).groupBy("candidate").count()
    assert max(r["count"] for r in handed.collect()) <= 5 * 4 * spark.sparkContext.defaultParallelism
