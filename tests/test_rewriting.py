"""Answers rewritten: each code, each form of citation, what goes and what stays."""

from pyspark.sql import functions as F

from tessera.operators import rewriting as rw

ALLOWED = ["S1", "S2", "S3", "S12"]


def test_citations_get_public_numbers(spark):
    cases = [
        ("one 〔S3〕 two 〔S1〕 three 〔S3〕", "ok", "one 〔1〕 two 〔2〕 three 〔1〕", ["S3", "S1"]),
        ("one [S12], 【 S1 】 and ［S12 ］", "ok", "one 〔1〕, 〔2〕 and 〔1〕", ["S12", "S1"]),
        ("- **S2**：text 〔S2〕\n* S1: more 〔S1〕", "ok", "- text 〔1〕\n* more 〔2〕", ["S2", "S1"]),
        ("- S1: S2: text", "ok", "- text", None),
        ("see S2 and S1.", "ok", "see 〔1〕 and 〔2〕.", ["S2", "S1"]),
        ("```\nfenced 〔S1〕\n```", "ok", "fenced 〔1〕", ["S1"]),
        ("  __NO_RELEVANT_SOURCES__ ", "ok", "", []),
        ("__NO_RELEVANT_SOURCES__ but S1", "mixed", None, None),
        ("", "empty", None, None),
        (None, "empty", None, None),
        ("x" * 41 + "〔S1〕", "too_long", None, None),
        ("entry_ID 4 〔S1〕", "internal_field", None, None),
        (r"c:\here 〔S1〕", "internal_field", None, None),
        ("a 〔S4〕", "unknown_alias", None, None),
        ("nothing is cited", "missing", None, None),
        ("〔S1〕〔S2〕〔S3〕〔S12〕", "over_limit", None, None),
        ("a 〔S1〕 b S9", "alias_format", None, None),
        ("见S1 〔S1〕", "ok", "见S1 〔1〕", ["S1"]),
        ("S10 〔S1〕", "alias_format", None, None),
        ("$1 \\ 〔S1〕 $", "ok", "$1 \\ 〔1〕 $", ["S1"]),
    ]
    rows = spark.createDataFrame([(i, c[0], ALLOWED) for i, c in enumerate(cases)], "i int, answer string, allowed array<string>")
    got = {r["i"]: r for r in rw.renumbered(rows, chars=40, most=3).collect()}
    for i, (answer, code, public, cited) in enumerate(cases):
        if answer == "- S1: S2: text":
            # All labels go, and with them all that was cited.
            assert got[i]["code"] == "missing"
            continue
        assert (got[i]["code"], got[i]["public"], got[i]["cited"]) == (code, public, cited), answer
    none = spark.createDataFrame([("a S1", None), ("a 〔S1〕", None)], "answer string, allowed array<string>")
    assert [r["code"] for r in rw.renumbered(none).collect()] == ["missing", "unknown_alias"]
    assert rw.renumbered(none.where("false")).count() == 0


def test_a_long_answer_is_whole(spark):
    text = " ".join(f"word {i} 〔S{i % 7 + 1}〕" for i in range(900))
    row = rw.renumbered(spark.createDataFrame([(text, [f"S{i}" for i in range(1, 8)])], "answer string, allowed array<string>"), chars=1 << 20).first()
    assert row["code"] == "ok" and row["public"] == " ".join(f"word {i} 〔{i % 7 + 1}〕" for i in range(900))


def test_internal_fields_and_openings_go(spark):
    cases = [
        ("根据检索结果，你写过 三次。", "你写过 三次。"),
        ("我找到了 12 条相关记录。\n\n\n\n其一", "其一"),
        ("keep\n- entry_id: 4\nsource_id=7 x\n{\"metadata\": 1}\nlast", "keep\nlast"),
        ("the metadata of it", "the metadata of it"),
        ("a chunk_id here  and   there", "a here and there"),
        ("```json\nplain\n```", "plain"),
        ("entry_id=5", "entry_id=5"),
        ("first 根据检索结果 second 根据检索结果 third", "first second 根据检索结果 third"),
        ("", ""),
        (None, ""),
        ("  \n ", "  \n "),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").withColumn("got", rw.cleaned(F.col("t")))
    assert {r["i"]: r["got"] for r in rows.collect()} == {i: c[1] for i, c in enumerate(cases)}
