"""The n-gram index beside plain search, and pools at their edges."""

import random

import pytest

from tessera.operators import pools, postings, retrieval


def pairs_of(queries, texts):
    return {(q, i) for q, terms in queries for i, text in texts if text is not None and any(t and t in text for t in terms or [])}


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_candidates_hold_all_hits_and_few_others(spark, monkeypatch, sent):
    monkeypatch.setattr(postings, "SENT", sent)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé中😀 ") for _ in range(rng.randrange(0, 40)))
    texts = [(i, word()) for i in range(300)] + [(300, None), (301, ""), (302, "ab"), (303, "a"), (5, "abc again")]
    queries = [(1, ["abc", "é中"]), (2, ["a"]), (3, ["zzz", "ab"]), (4, []), (5, None), (6, ["", "😀", "cdéab"]), (7, ["not there at all"]), (8, ["abc", "abc"])]
    asked = spark.createDataFrame(queries, "query_id int, terms array<string>")
    rows = spark.createDataFrame(texts, "id long, hay string")
    got = {tuple(r) for r in postings.candidates(asked, rows).collect()}
    want = pairs_of(queries, texts)
    assert want <= got and {q for q, _ in got} <= {1, 2, 3, 6, 8}

    assert all(any(any(t[j : j + 3] in dict(texts)[i] or t in dict(texts)[i] for j in range(max(len(t) - 2, 1))) for t in dict(queries)[q] if t) for q, i in got if i != 5)
    assert postings.candidates(asked.where("false"), rows).count() == 0 == postings.candidates(asked, rows.where("false")).count()


def test_rarest_gram_is_taken(spark):
    texts = spark.createDataFrame([(i, "the common words") for i in range(50)] + [(99, "the cozy words")], "id long, hay string")
    asked = spark.createDataFrame([(1, ["cozy words"])], "query_id int, terms array<string>")
    assert [tuple(r) for r in postings.candidates(asked, texts).collect()] == [(1, 99)]


def test_scan_budget_is_probed(spark):
    entries = spark.createDataFrame([(i, f"word {i}\nword body" if i % 2 else "none") for i in range(20)] + [(50, None)], "id long, content string")
    asked = spark.createDataFrame([(1, ["word"]), (2, ["word 19"]), (3, ["absent"])], "query_id int, terms array<string>")
    got = {b: retrieval.lexical(asked, entries, k=None, budget=b).collect() for b in (3, 10, 11)}
    assert {r["id"] for r in got[3] if r["query_id"] == 1} == {1, 3, 5} and all(r["cut"] for r in got[3] if r["query_id"] == 1)
    assert not any(r["cut"] for r in got[10]) and len(got[10]) == len(got[11]) == 11
    assert [(r["id"], r["title_hits"]) for r in got[3] if r["query_id"] == 2] == [(19, 1)]


def test_page_snippets(spark):
    long = "x" * 100 + " Needle " + "y" * 300
    pages = spark.createDataFrame([(1, "needle", "h", "en", "<p>" + long + "</p>"), (2, "needle", "h", "en", "z" * 500), (3, None, None, None, None), (4, "t", "h", "en", "needle thread")], "id long, title string, host string, lang string, html string")
    asked = spark.createDataFrame([(1, ["thread", "needle"])], "query_id int, terms array<string>")
    got = {r["id"]: (r["rank"], r["score"], r["snippet"]) for r in retrieval.page_lexical(asked, pages).collect()}
    text = " " + long + " "
    place = text.lower().find("needle")
    assert got == {4: (1, 2, "needle thread"), 1: (2, 1, text[place - 40 : place + 200]), 2: (3, 1, "z" * 420)}


def chosen(rows, cap):
    """The selection as loops over a query's candidates."""
    key = lambda r, ranks=None: (0 if r["title_hits"] else 1, -r["title_hits"], -r["body_hits"], ranks[r["key"]] if ranks else 0, r["key"])
    if len(rows) <= cap:
        return [r["key"] for r in sorted(rows, key=key)], set()
    ranks = {}
    for channel in {r["channel"] for r in rows}:
        mine = sorted((r for r in rows if r["channel"] == channel), key=lambda r: (r["given"] or 10**9, -r["score"], r["key"]))
        ranks |= {r["key"]: r["given"] or i for i, r in enumerate(mine, 1)}
    ordered = sorted(rows, key=lambda r: key(r, ranks))
    seats = [next(r for r in ordered if r["channel"] == c) for c in pools.DENSE if any(r["channel"] == c for r in rows)]
    taken = ordered[: max(0, cap - len(seats))]
    for r in [*seats, *ordered]:
        if len(taken) < cap and r not in taken:
            taken.append(r)
    return [r["key"] for r in sorted(taken, key=lambda r: key(r, ranks))], {r["key"] for r in seats}


def test_selection_follows_a_plain_loop(spark):
    rng = random.Random(8)
    rows = []
    for q, n in ((1, 40), (2, 12), (3, 1), (4, 13)):
        for i in range(n):
            channel = rng.choice(["lexical_title", "lexical_body", *pools.DENSE])
            rows.append({"query_id": q, "key": f"k{i}", "channel": channel, "title_hits": rng.randrange(3) if channel.startswith("lex") else 0, "body_hits": rng.randrange(3), "given": i + 1 if channel == "entry_dense" else None, "score": rng.randrange(4) / 4})
    df = spark.createDataFrame(rows, "query_id int, key string, channel string, title_hits int, body_hits int, given long, score double")
    got = pools.within_budget(df, cap=12).orderBy("query_id", "position").collect()
    for q in (1, 2, 3, 4):
        keys, seats = chosen([r for r in rows if r["query_id"] == q], 12)
        mine = [r for r in got if r["query_id"] == q]
        assert [r["key"] for r in mine] == keys and {r["key"] for r in mine if r["reserved"]} == seats
        assert {r["scope"] for r in mine} == {"budget_filtered" if q in (1, 4) else "exhaustive"}


def test_joined_channels_keep_the_first_place(spark):
    rows = [(1, 0, 1, "entry:1", "e1", "entry"), (1, 0, 2, "entry:2", "e2", "entry"), (1, 1, 1, "entry:1", "e1", "entry"), (1, 2, 1, "attachment:9", "e2", "attachment_chunk"), (1, 2, 2, "attachment:8", "e7", "attachment_chunk")]
    got = pools.joined(spark.createDataFrame(rows, "query_id int, part int, rank long, key string, origin string, source_type string")).orderBy("place").collect()
    assert [(r["key"], r["place"]) for r in got] == [("entry:1", 1), ("attachment:9", 2), ("attachment:8", 5)]


def test_hybrid_lists_go_on_and_tail_is_new(spark):
    kind = "query_id int, part int, rank long, key string, origin string, source_type string, score double"
    hits = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], kind)
    dense = hits((0, 1, "chunk:1", "e1", "knowledge_source", 0.9), (1, 1, "entry:1", "e1", "entry", 0.8), (1, 2, "entry:5", "e5", "entry", 0.7))
    words = hits((0, 1, "entry:5", "e5", "entry", 1.0), (1, 1, "todo:3", "t3", "todo", 1.0), (2, 1, "page:2", "p2", "page", 3.0))
    files = hits((0, 1, "attachment:4", "e5", "attachment_chunk", 0.5))
    visual = spark.createDataFrame([(1, "attachment:4", "e5", 0.9), (1, "attachment:6", "e3", 0.4), (1, "attachment:7", "e6", 0.1)], "query_id int, key string, origin string, score double")
    got = pools.hybrid(dense, words, files, visual).orderBy("position").collect()
    assert [r["key"] for r in got] == ["attachment:4", "chunk:1", "todo:3", "page:2", "attachment:6"]
    assert [r["source_reason"] for r in got][-1] == "visual" and got[2]["rrf"] == round(0.9 / 62, 9)
    assert pools.hybrid(dense.where("false"), words.where("false"), files.where("false")).count() == 0


def test_lookup_attaches_evidence_before_it_selects(spark):
    channels = spark.createDataFrame([(1, 0, 1, "entry:1", "e1", "entry", 1.0, "lexical", None), (1, 1, 1, "entry:2", "e2", "entry", 0.5, "entry_dense", 1), (2, 1, 1, "entry:3", "e3", "entry", 0.5, "entry_dense", 1)], "query_id int, part int, rank long, key string, origin string, source_type string, score double, channel string, given long")
    texts = spark.createDataFrame([("entry:1", "a title", "body with needle"), ("entry:2", "needle title", "w " * 500)], "key string, title string, text string")
    terms = spark.createDataFrame([(1, ["needle"])], "query_id int, terms array<string>")
    parents = spark.createDataFrame([("entry:2", "entry:9")], "key string, parent string")
    got = pools.lookup(channels, texts, terms, parents, cap=120).orderBy("query_id", "position").collect()
    assert [(r["key"], r["channel"], r["mode"], r["parent"]) for r in got] == [("entry:2", "entry_dense", "title_opening_windows", "entry:9"), ("entry:1", "lexical_body", "short_full_body", None), ("entry:3", "entry_dense", "title_opening_windows", None)]
    assert got[0]["evidence"].startswith("w w")
