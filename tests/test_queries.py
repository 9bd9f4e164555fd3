"""Every query with SQL agrees with it on the smallest tables; the others are compared with plain loops."""

import sys

import duckdb
import pandas as pd
import pytest
from harness import compare, connection
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import queues
from tessera.plans.catalogue import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(D)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert compare(QUERIES[name](spark, D), ORACLES[name], con) == ""


def packed(text, size=900, overlap=120, most=1350):
    chunks, held = [], ""
    for part in (p.strip(" ") for p in text.split("\n")):
        if not part:
            continue
        if not held:
            held = part
        elif len(held) + len(part) + 1 <= size:
            held += "\n" + part
        else:
            chunks.append(held)
            held = held[-overlap:] + "\n" + part
    if held:
        chunks.append(held)
    out = []
    for c in chunks:
        if len(c) <= most:
            out.append(c)
            continue
        at = 0
        while True:
            out.append(c[at : at + size])
            if at + size >= len(c):
                break
            at += size - overlap
    return out


def test_packed_chunks_follow_a_plain_loop(spark):
    rows = {r["id"]: r["content"] for r in spark.read.parquet(f"{D}/documents.parquet").selectExpr("doc_id as id", "text as content").collect()}
    found = {}
    for r in QUERIES["split_entry_content"](spark, D).orderBy("id", "chunk").collect():
        found.setdefault(r["id"], []).append(r["text"])
    assert found == {i: p for i, c in rows.items() if (p := packed(c))}


def test_chunk_windows_at_their_edges(spark):
    texts = ["", "a" * 800, "a" * 801, "a" * 1500, "a" * 1501, " \n x \n\n y "]
    got = [r["w"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.windows(F.col("t")).alias("w")).collect()]
    assert [len(w) for w in got] == [0, 1, 2, 2, 3, 1] and got[5] == ["x\ny"]


def outcomes(requests, lease=120):
    state, out = {}, {}
    for key, at, i, kind, fails, seconds in sorted(requests):
        s = state.get(key)
        if s is None:
            out[i] = "acquired"
        elif s["kind"] != kind:
            out[i] = "conflict"
        elif s["ready"] <= at:
            out[i] = "take_over" if s["fails"] else "replay"
        else:
            out[i] = "in_progress" if at < s["until"] else "take_over"
        if out[i] in ("acquired", "take_over"):
            state[key] = {"kind": kind, "ready": at + seconds, "until": at + lease, "fails": fails}
    return out


def test_claims_follow_a_plain_loop(spark):
    base = [("a", 0, 1, "x", False, 60), ("a", 30, 2, "x", False, 9), ("a", 70, 3, "x", False, 9), ("a", 80, 4, "y", False, 9), ("b", 0, 5, "x", True, 10), ("b", 5, 6, "x", False, 5), ("b", 20, 7, "x", False, 500), ("b", 100, 8, "x", False, 1), ("b", 300, 9, "x", False, 1)]
    rows = spark.createDataFrame(base, "key string, at int, id long, hash string, fails boolean, seconds int").withColumn("at", F.expr("timestampadd(SECOND, at, timestamp_ntz'2024-01-01 00:00:00')"))
    got = {r["id"]: r["outcome"] for r in queues.claims(rows).collect()}
    assert got == outcomes(base)
    assert set(got.values()) == {"acquired", "in_progress", "replay", "conflict", "take_over"}


def test_windows_of_a_long_text_are_not_those_of_the_next(spark, tmp_path):
    """Window 100 of entry 1 had the number of the first one of entry 2, which has a vector."""
    texts = [(0, "short"), (1, "word " * 16_000), (2, "also short"), (3, " \n ")]
    spark.createDataFrame([(i, said, "en", f"src{i}", len(said)) for i, said in texts], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(4)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("customer", "supplier", "part", "orders", "lineitem", "events", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{D}/{name}.parquet").limit(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert compare(QUERIES["chunk_vector_rows"](spark, str(tmp_path)), ORACLES["chunk_vector_rows"], connection(str(tmp_path))) == ""


def agrees_on(spark, folder, name, texts):
    """Empty if a query agrees with its SQL on documents of these texts, else what differs first."""
    rows = [(i, said, "en", f"src{i % 3}", len(said or "")) for i, said in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    for other in ("customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{D}/{other}.parquet").limit(1).write.parquet(str(folder / f"{other}.parquet"))
    return compare(QUERIES[name](spark, str(folder)), ORACLES[name], connection(str(folder)))


def test_texts_without_words_are_one_window_each(spark, tmp_path):
    assert agrees_on(spark, tmp_path, "chunk_text", [None, "", " ", " \n \n ", "\t", "a", "x" * 800, "é" * 801, " a \n" * 900]) == ""


def test_lower_case_is_that_of_sql_for_each_character(spark):
    """In Spark's own, İ becomes two characters, Σ goes by its neighbours, and the table is of a later standard."""
    texts = [f"a{chr(c)}" for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF] + ["ΟΔΟΣ ΑΣ.", "İSTANBUL", "Plain Text", "", None]
    rows = spark.createDataFrame(pd.DataFrame({"t": texts})).select("t", tx.lower(F.col("t")).alias("low")).toPandas()
    want = duckdb.sql("SELECT t, low, lower(t) AS want FROM rows WHERE low IS DISTINCT FROM lower(t)").fetchall()
    assert want == []


def test_merged_summaries_without_words_and_in_other_scripts(spark, tmp_path):
    texts = [None, "", "  ", "İstanbul istanbul ISTANBUL", "ΑΣ ας ασ", "A a B", "ΟΔΟΣ οδος οδοσ", "\ua7cc \ua7cd \ua7da \ua7db", "\U00010400 \U00010428", " ".join(f"w{i}" for i in range(40))]
    assert agrees_on(spark, tmp_path, "summary_merge", texts) == ""


def test_windows_around_terms_where_lower_case_has_another_length(spark, tmp_path):
    texts = [None, "", " ", "İ" * 200 + "the" + "x" * 400 + "NICHT", "x" * 170 + "İİthe" + "y" * 357 + "pour", "NİCHT", "Σ the Σ", "\U00010400" * 300 + "THE" + "é" * 361 + "Nicht"]
    texts += ["x" * 200 + "the" + "İ" * n + "pour" + "z" * 9 for n in (176, 177, 178, 356, 357, 358)]
    assert agrees_on(spark, tmp_path, "term_windows", texts) == ""
