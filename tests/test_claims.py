"""Claims against references: each branch by a case written by hand."""

from tessera.operators import claims

CASES = "case_id long, answerable boolean, infra boolean, abstained boolean, manual double, judge double"
CLAIMS = "case_id long, claim long, text string, terms array<string>, required array<string>, keys array<string>, must boolean"
REFS = "case_id long, key string, text string"


def test_claims_by_hand(spark):
    cases = [(i, i != 6, i == 5, i == 7, {2: 4.0, 3: -1.0, 8: 0.7}.get(i), 0.25 if i in (3, 4) else None) for i in range(1, 11)]
    said = [
        (1, 1, "a", ["Green", "TEA"], None, ["n:3", "n:1"], None),
        (1, 2, "b", ["green", "coffee"], ["n:9"], ["n:7"], True),
        (1, 3, " ", [" ", None], ["n:9", "n:2"], [], True),
        (1, 4, "c", ["nowhere"], None, None, False),
        (2, 1, "x", ["nowhere"], None, None, False),
        (6, 1, "x", [], None, ["n:1"], True),
        (9, 1, None, None, None, [" n:1 "], None),
        (None, 1, "x", ["x"], None, None, None),
    ]
    refs = [(1, "n:1", "Green leaves"), (1, "n:2", "black tea"), (1, " ", "coffee of no key"), (2, "n:1", None), (5, "n:1", "x"), (6, "n:1", "x"), (7, "n:1", "x"), (9, "n:1", "x"), (9, "n:1", "again")]
    c, s, r = (spark.createDataFrame(x, k) for x, k in ((cases, CASES), (said, CLAIMS), (refs, REFS)))
    got = {x["case_id"]: tuple(x)[1:] for x in claims.scores(c, s, r).select("case_id", "claims", "must_claims", "supported", "unsupported", "faithfulness", "status", "citation_linkage", "claim_linkage").collect()}
    assert got == {
        1: (4, 3, 2, 1, 2 / 3, "scored", 0.5, 1 / 3),
        2: (1, 0, 0, 0, 0.8, "manual", 0.0, 0.0),
        3: (0, 0, 0, 0, 0.0, "manual", 0.0, None),
        4: (0, 0, 0, 0, 0.25, "llm_judge", 0.0, None),
        5: (0, 0, 0, 0, None, "unsupported", None, 0.0),
        6: (1, 1, 1, 0, 1.0, "scored", 0.0, 1.0),
        7: (0, 0, 0, 0, None, "unsupported", 0.0, 0.0),
        8: (0, 0, 0, 0, 0.7, "manual", 0.0, None),
        9: (1, 1, 1, 0, 1.0, "scored", 1.0, 0.0),
        10: (0, 0, 0, 0, None, "unsupported", 0.0, None),
    }
    reasons = {(x["case_id"], x["claim"]): x["reasons"] for x in claims.judged(s, r).collect()}
    assert reasons[1, 2] == "required_reference_key_missing" and reasons[1, 4] == "missing_support_terms" and reasons[1, 3] == ""
    assert claims.scores(c.where("false"), s, r).count() == 0 and claims.scores(c, s.where("false"), r.where("false")).count() == 10


def test_keys_that_end_in_their_place_are_whole(spark):
    said = [(1, 1, "x", None, None, ["n:0", "n:11", "n:21"], None), (1, 2, "x", None, None, ["n:10"], None)]
    refs = [(1, "n:10", "x"), (1, "n:11", "x"), (1, "n:1", "x")]
    got = {r["claim"]: r["linked"] for r in claims.judged(spark.createDataFrame(said, CLAIMS), spark.createDataFrame(refs, REFS)).collect()}
    assert got == {1: True, 2: True}
