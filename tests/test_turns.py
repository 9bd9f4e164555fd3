"""Turns beside a plain automaton, however their events are cut."""

import random

from tessera.operators import turns

SCHEMA = "request string, at int, id long, event string"


def walked(events):
    state = "start"
    for e in events:
        state = turns.FOLLOWS[state].get(e, "invalid")
    return state if state in ("done", "error", "invalid") else "open"


def test_turns_by_example(spark):
    lines = {
        "answered": ("meta status source_set status text_delta text_delta status reference reference done", "done"),
        "offered": ("meta status source_candidate source_candidate done", "done"),
        "replayed": ("meta status text_delta done meta text_delta reference done", "done"),
        "refused": ("error", "error"),
        "broken": ("meta source_set status error", "error"),
        "cut": ("meta text_delta", "open"),
        "late": ("meta text_delta reference text_delta done", "invalid"),
        "twice": ("meta text_delta done done", "invalid"),
        "unopened": ("text_delta done", "invalid"),
        "mixed": ("meta source_candidate text_delta done", "invalid"),
        "unknown": ("meta hello done", "invalid"),
    }
    rows = [(k, 0, i, e) for k, (line, _) in lines.items() for i, e in enumerate(line.split())] + [(None, 0, 0, "meta"), ("null", 0, 0, None)]
    got = {r["request"]: r["outcome"] for r in turns.outcomes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: want for k, (_, want) in lines.items()} | {None: "open", "null": "invalid"}
    assert turns.outcomes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_request_is_folded_in_parts(spark):
    rng = random.Random(2)
    whole = ["meta", "status", *["text_delta"] * 20_000, "status", *["reference"] * 300, "done"]
    rows = [("hot", i // 7, i, e) for i, e in enumerate(whole)] + [("bad", i // 7, i, e) for i, e in enumerate(whole[:9000] + ["reference"] + whole[9000:])]
    for k in range(400):
        line = [rng.choice(["meta", "status", "text_delta", "reference", "done", "error"]) for _ in range(rng.randrange(1, 7))]
        rows += [(f"r{k}", i // 2, i, e) for i, e in enumerate(["meta"] * rng.randrange(2) + line)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, SCHEMA)
    by = {}
    for request, at, i, event in sorted(rows):
        by.setdefault(request, []).append(event)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = {r["request"]: r["n"] for r in turns.parts(events).groupBy("request").count().withColumnRenamed("count", "n").collect()}
        got = {r["request"]: (r["events"], r["outcome"]) for r in turns.outcomes(events).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: (len(v), walked(v)) for k, v in by.items()}
    assert got["hot"][1] == "done" and got["bad"][1] == "invalid"
    assert 1 < cut["hot"] <= 4 and sum(cut.values()) <= len(by) + 3
