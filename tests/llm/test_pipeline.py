import base64
import hashlib
import math
import re
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from test_near_dup import brute as brute_links
from test_text_models import brute_counts, brute_language, brute_score

import corpus_pipeline
from tessera.llm import quality, registry

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on the rows that its predecessor kept, beside a plain computation of its rule."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mixing", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, D).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = before.collect()
        if name != "byte_bpe":
            assert out.columns == columns
        if name == "language_id":
            verdicts = brute_language([(r["lang"], r["text"]) for r in rows], [r["text"] for r in rows])
            find = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
            learned = {w for r in rows if r["lang"] is not None for w in find(r["text"])}
            share = lambda r: sum(w in learned for w in find(r["text"])) / max(1, len(find(r["text"])))  # noqa: B023, E731
            want = Counter(tuple(r) for r, (lang, score, _) in zip(rows, verdicts, strict=True) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE and share(r) >= corpus_pipeline.LEAST_KNOWN)
            assert rows_of(out) == want
        if name == "quality_rules":
            stats = quality.counted(before, ("doc_id",))
            forest = quality.fitted(stats, spark.read.parquet(f"{D}/labels.parquet"))
            score = {r["doc_id"]: brute_score(forest, r["features"]) for r in stats.collect()}
            want = Counter()
            for r in rows:
                n, _, _, _, repeats = brute_counts(r["text"])
                if n >= 10 and 100 * repeats <= 20 * n and score[r["doc_id"]] < forest.threshold:
                    want[tuple(r)] += 1
            assert rows_of(out) == want and 0 < sum(want.values()) < len(rows)
        if name == "near_dedup":
            first = {i for i, (_, _, kept) in brute_links([(r["doc_id"], r["text"]) for r in rows], 5).items() if kept}
            assert rows_of(out) == Counter(tuple(r) for r in rows if r["doc_id"] in first) and len(first) < len(rows)
        if name == "mixing":
            size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
            assert set(rows_of(out)) <= {tuple(r) for r in rows} and max(rows_of(out).values()) <= 2
            got, whole = Counter(), Counter()
            for r in out.collect():
                got[r["source"]] += size[r["doc_id"]]
            for r in rows:
                whole[r["source"]] += size[r["doc_id"]]
            order = sorted(whole, key=lambda s: (s is None, s))
            share = brute_shares({s: whole[s] for s in order})
            longest = max(size.values())
            assert all(abs(got[s] - share[s]) <= max(longest, 0.25 * share[s]) for s in order)
        if name == "byte_bpe":
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANK_FILE), "rb"))}
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = Counter()
            for r in rows:
                ids = library.encode_ordinary(r["text"])
                digests = (hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), r["text"].encode()))
                want[r["doc_id"], tuple(ids), len(ids), *digests] += 1
            assert Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()) == want
        before = out
    assert corpus_pipeline.run(spark, D).count() == before.count()


def brute_shares(sizes):
    """Targets: weights 5, 2, 1 share one and a half times all words, none more than twice its own."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sizes)}
    full = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        spread = sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and rest * weight[s] / spread > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else rest * weight[s] / spread for s in sizes}
        full |= over


def test_mix_keeps_the_order_of_its_slots(spark, tmp_path):
    """The files, read in order, hold every source throughout and not one after another."""
    docs = spark.createDataFrame([(i, f"{'abc'[i % 3]}{i} " + "word " * 400, "en", "abc"[i % 3], 5) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mixing(spark, docs, D).write.parquet(str(tmp_path / "mix"))
    files = sorted((tmp_path / "mix").glob("*.parquet"))
    found = [r["source"] for f in files for r in spark.read.parquet(str(f)).collect()]
    share = {s: found.count(s) / len(found) for s in "abc"}
    for n in range(60, len(found), 20):
        assert all(abs(found[:n].count(s) / n - share[s]) < 0.12 for s in "abc")
    assert math.isclose(sum(share.values()), 1)


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows(spark, empty):
    """Nulls, repeats, ties, clashing columns and no rows at all pass through every stage."""
    text = "Is and retitioning the of and nterti thorreou ndernt ores inthe whst by for threea anly re that was here"
    rows = [] if empty else [(1, text, "en", "a", 5, "x", 1), (1, text, "en", "a", 5, "x", 1), (None, text, None, None, None, None, None), (None, None, None, None, None, None, None), (3, "", "en", "a", 0, "y", 2), (4, "12 34 56", "en", "b", 3, "y", 3), (5, "other " + text[::-1] + " plainly", "en", None, 9, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score int")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, D), name)
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids == (set() if empty else {1, None, 5})


def test_ids_that_stand_on_other_texts(spark):
    """A near copy goes although its id stands on a text that stays."""
    one, other = ("the words of a text that has enough of them to be told apart from all " + w for w in ("others here today", "strangers"))
    third = "something else that nobody has said before in this place or in any other of these"
    rows = [(1, one), (2, one), (2, third), (3, third), (None, one), (4, other), (4, other), (1, third)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, D).collect()), key=repr)
    assert got == sorted([(1, one), (1, third), (4, other), (None, one)], key=repr)


def test_languages_that_were_not_learned_go(spark):
    own = "the words of a language that was learned stay here and are said again in this text"
    mixed = "the words of a language und etwas mehr"
    foreign = "слова другого языка которого никто не учил"
    rows = [(1, own, "en"), (2, own, None), (3, foreign, None), (4, mixed, None), (5, "Wörter einer zweiten Sprache stehen hier und etwas", "de")]
    docs = spark.createDataFrame([(i, t, g, "a", 1) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, D).collect()} == {1, 2, 4, 5}


def test_each_operator_has_one_query():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
