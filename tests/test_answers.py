"""Folds against plain loops, files, snapshots, and small fixtures of evidence."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import answers, sync
from tessera.plans.catalogue import QUERIES
from tessera.sources import tables

D = "/root/testdata/sf0.001"


def ranked(spark):
    rows = tables.rankings(spark, D).selectExpr("query_id", "idx", "doc_id", "doc_id * 17 % 1500 as size", "channel = 'lexical' as reserved").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["query_id"]].append(r)
    return by


def test_groups_follow_a_plain_loop(spark):
    want = set()
    for q, rows in ranked(spark).items():
        group = used = 0
        for r in sorted(rows, key=lambda r: r["idx"]):
            need = r["size"] + 16
            if used and used + need > 6000:
                group, used = group + 1, 0
            used += need
            want.add((q, r["doc_id"], group))
    assert {tuple(r) for r in QUERIES["packed_groups"](spark, D).collect()} == want


def test_budget_skips_what_does_not_fit(spark):
    want = set()
    for q, rows in ranked(spark).items():
        used = count = 0
        for r in sorted(rows, key=lambda r: (not r["reserved"], r["idx"])):
            if used + r["size"] <= 16_000 and count < 20:
                used, count = used + r["size"], count + 1
                want.add((q, r["doc_id"]))
    assert {(r["query_id"], r["id"]) for r in QUERIES["context_budget"](spark, D).collect()} == want
    big = spark.createDataFrame([(1, 1, 1, 90, False), (1, 2, 2, 20, False), (1, 3, 3, 10, False)], "query_id long, rank long, id long, size long, reserved boolean")
    assert [r["id"] for r in answers.skipping_budget(big, most=100).orderBy("rank").collect()] == [1, 3]


def test_versions_follow_a_plain_loop(spark):
    rows = tables.jobs(spark, D).select("user_id", "created_at", "id").collect()
    now, want = defaultdict(int), set()
    for r in sorted(rows, key=lambda r: (r["created_at"], r["id"])):
        ok = r["id"] % 3 == now[r["user_id"]]
        now[r["user_id"]] += ok
        want.add((r["user_id"], r["id"], "confirmed" if ok else "conflict", now[r["user_id"]]))
    assert {tuple(r) for r in QUERIES["source_set_versions"](spark, D).collect()} == want


def test_page_text_without_private_parts(spark):
    page = "<p>Mail me@example.com or see https://x.example/a?b now</p><script>var a = 'x';</script> 0123abcd-0000-1111-2222-333344445555 end"
    r = sync.page_texts(spark.createDataFrame([(1, page), (2, "<p>abcdef</p>")], "id long, html string"), most=30).orderBy("id").collect()
    clean = re.sub(r"\s+", " ", "Mail  or see  now  end").strip()
    assert (r[0]["chars"], r[0]["content_hash"], r[0]["partial"]) == (len(clean), hashlib.sha256(clean.encode()).hexdigest(), False)
    assert sync.page_texts(spark.createDataFrame([(2, "<p>abcdef</p>")], "id long, html string"), most=3).first()["partial"]


def test_uploaded_files(spark, tmp_path):
    for name, data in (("a.txt", b"hello"), ("b.exe", b"x"), ("c.md", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: (r["content_hash"], r["refused"]) for r in sync.files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == (hashlib.sha256(b"hello").hexdigest(), "") and got["b.exe"][1] == "type" and "c.md" not in got


def test_snapshots_of_another_model_are_absent(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7, [1.0]), (2, 8, [2.0])], "id long, user_id long, v array<double>")
    sync.snapshot(rows, str(tmp_path / "s"), "model-1")
    assert sync.restored(spark, str(tmp_path / "s"), "model-1").count() == 2
    assert sync.restored(spark, str(tmp_path / "s"), "model-2").count() == 0


def windows_of(text, terms, around=10, most=3):
    """The rule as a loop: all places of the terms in order, windows that don't overlap."""
    places = sorted(m.start() for t in terms for m in re.finditer(re.escape(t), text.lower()))
    if not places:
        return [text[: 2 * around]] if text else []
    found, used = [], []
    for p in places:
        start, end = max(0, p - around), min(len(text), p + around)
        if all(end <= a or start >= b for a, b in used):
            used.append((start, end))
            found.append(text[start:end])
    return found[:most]


def test_windows_follow_a_plain_loop(spark):
    texts = ["x" * 300 + "Needle" + "y" * 300, "none here", "", "needle thread needle", "a needle " * 20 + "thread", "thread" + "." * 25 + "Needle" + "." * 19 + "thread" + "." * 30 + "needle" + "." * 40 + "thread"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(answers.hit_windows(F.col("t"), ["needle", "thread"], 10)).collect()]
    assert got == [windows_of(t, ["needle", "thread"]) for t in texts]


def test_windows_of_terms_that_overlap_themselves(spark):
    texts = ["aaaaaaa", "xaa" * 40, "abababab" + "." * 30 + "ababab", "\ue000aa \ue000", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for terms in (["aa"], ["abab", "ba"], ["aa", "x"]):
        got = [r[0] for r in df.select(answers.hit_windows(F.col("t"), terms, 4)).collect()]
        assert got[:-1] == [windows_of(t, terms, 4) for t in texts[:-1]], terms
        own = [r[0] for r in df.withColumn("ts", F.array(*map(F.lit, terms))).select(answers.hit_windows(F.col("t"), F.col("ts"), 4)).collect()]
        assert own == got


def test_plans_of_evidence_grow_with_terms_no_faster_than_they_do(spark):
    rows = spark.createDataFrame([(1, "t", "text", True)], "id long, title string, text string, dense boolean")
    size = lambda n, most=3: len(answers.judge_evidence(rows, [f"term{i}" for i in range(n)], most=most)._jdf.queryExecution().optimizedPlan().toString())
    assert size(24) < 3 * size(12) and size(3, most=12) < 1.1 * size(3)


def test_evidence_modes_and_budget(spark):
    long = "word, " * 400
    rows = [(1, "T", "short text", True), (2, "T", long, True), (3, "T", long, False), (4, "Needle", long + "needle " * 3, True), (5, None, None, True), (6, "  记录 # 12 ", "", False)]
    got = {r["id"]: r for r in answers.judge_evidence(spark.createDataFrame(rows, "id long, title string, text string, dense boolean"), ["needle", "x"]).collect()}
    assert [got[i]["mode"] for i in range(1, 7)] == ["short_full_body", "dense_stratified_segments", "title_opening_windows", "title_opening_windows", "title_opening_windows", "title_opening_windows"]
    assert got[1]["evidence"] == "short text" and all(len(r["evidence"]) <= 1400 for r in got.values())
    assert (got[4]["title_hits"], got[4]["body_hits"], got[4]["term_hits"]) == (1, 1, 4) and got[2]["term_hits"] == 0
    assert got[5]["evidence"] == "记录" == got[6]["evidence"]


def test_attempts_with_ties(spark):
    row = lambda **k: {"eligible": True, "quality": "ok", "score": 0.5, "confidence": 0.5, "chars": 10} | k
    pairs = [(1, row(), row()), (2, row(eligible=False), row()), (3, row(), row(score=0.5 + 1e-12, chars=11)), (4, row(confidence=0.0), row(confidence=None)), (5, row(quality="low"), row(quality="strange"))]
    schema = "eligible:boolean,quality:string,score:double,confidence:double,chars:int"
    got = {r["id"]: r["chosen"] for r in answers.best_attempts(spark.createDataFrame(pairs, f"id int, p struct<{schema}>, f struct<{schema}>")).collect()}
    assert got == {1: "primary", 2: "fallback", 3: "fallback", 4: "primary", 5: "primary"}
