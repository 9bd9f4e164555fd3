import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, kneser_ney, langid, quality

D = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, " \t\r\n"), (4, "x" * 40_000), (5, "日本語 text 😀 é \x85\x1c"), (5, "日本語 text 😀 é \x85\x1c"), (None, "<|endoftext|> it's 12 ½"), (6, "1234 --- !!!")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def odd(spark, more=()):
    """Odd rows, with columns that clash with results' names."""
    rows = [(*r, "en", "s", i) for i, r in enumerate([*ODD, *more])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, score int")


def test_bpe_is_the_rank_files_library(spark, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*documents.select("doc_id", "text").collect(), *odd(spark).select("doc_id", "text").collect()]
    got = Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for d in (documents, odd(spark)) for r in bpe.encoded(d, RANKS, public_tokenizers.PATTERN).collect())
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"], tuple(ids), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encoded(documents.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_splits_any_code_points_as_the_library():
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "the ", " ", "1", "ß", "\n", "'s", chr(rng.randrange(0x20, 0xD7FF)), chr(rng.randrange(0xE000, 0x110000)), "\u0558", "\U00011de3"]) for _ in range(12))
        assert own.encode(text) == library.encode_ordinary(text)


def test_codec_remembers_no_more_than_its_bound(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"word{i} the" for i in range(50))
    assert own.encode(text) == own.encode(text) and own.decode(own.encode(text)) == text.encode()
    assert own.encode("other words") and len(own.ids) <= 5  # and never more than what one group of texts needs
    assert own.digests(own.known([text])[0])[1] == hashlib.sha256(",".join(map(str, own.encode(text))).encode()).hexdigest()
    assert [len(g) for g in bpe.grouped(["a" * 300_000, "b", "", "c" * 600_000, "d"])] == [3, 1, 1]


def test_language_on_held_out_documents(spark, documents):
    held = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    model = langid.fitted(documents.where(f"not {held}"))
    rows = langid.predicted(documents.where(held), model, keep=("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predicted(odd(spark), model).collect()}
    assert got[1] == got[2] == got[3] == got[6] == "und" and got[4] in model.langs


def brute_language(train, texts):
    """The method by its definition: every learned word, else the mean over the longest learned n-grams."""
    find = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    counts, totals = defaultdict(lambda: defaultdict(Counter)), defaultdict(Counter)
    for lang, text in train:
        for w in find(text) if lang is not None else []:
            for kind, parts in ((0, [w]), *((n, langid.grams(w, n)) for n in langid.ORDERS)):
                for part in parts:
                    counts[kind][part][lang] += 1
                    totals[kind][lang] += 1
    langs = sorted(totals[0])
    vector = lambda kind, part: [math.log((counts[kind][part][lang] or 0.5) / (totals[kind][lang] + 1)) for lang in langs]

    def of(w):
        if w in counts[0]:
            return vector(0, w)
        for n in langid.ORDERS:
            if hit := [vector(n, g) for g in langid.grams(w, n) if g in counts[n]]:
                return [sum(c) / len(hit) for c in zip(*hit, strict=True)]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        words = find(text)
        if not words or not langs:
            out.append(("und", 0.0, []))
            continue
        sums = [sum(c) for c in zip(*map(of, words), strict=True)]
        best = max(sums)
        out.append((langs[sums.index(best)], 1 / sum(math.exp(s - best) for s in sums), sums))
    return out


@pytest.mark.parametrize("table_words", [300, 0])
def test_language_against_brute_force(spark, documents, table_words):
    """All words and n-grams count, whatever the size of the table that workers hold."""
    train = [(r["lang"], r["text"]) for r in documents.where("doc_id % 3 = 0").collect()]
    more = [("en", "naïve naïve coöperate"), ("hi", "नमस्ते दुनिया नमस्ते"), (None, "unlabelled words"), ("zz", None)]
    learned = spark.createDataFrame([*train, *more], "lang string, text string")
    model = langid.fitted(learned, table_words=table_words)
    assert len(model.table) <= table_words
    texts = [r["text"] for r in documents.collect()] + ["½ ² ①", "नमस्ते", "दुनि", "qqqqq zzzz", "日本", "", None, "12 ½ x", "𐐀𐐁 Ⅷ", "a\u0301a"]
    rows = langid.predicted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    want = brute_language([*train, *more], texts)
    assert len(rows) == len(texts)
    for r in rows:
        lang, score, sums = want[r["doc_id"]]
        close = sum(abs(s - max(sums)) < 1e-4 * (1 + abs(s)) for s in sums) > 1 if sums else False
        assert (r["lang_pred"] == lang or close) and abs(r["score"] - score) < 1e-3 + (0.5 if close else 0)
    assert {r["doc_id"]: r["lang_pred"] for r in rows}[len(documents.collect())] == "und"


def test_language_words_are_letters_with_marks():
    assert langid.words_of("½ ² ① 12_x ⅷ") == ["x"] and langid.words_of("नमस्ते दुनिया") == ["नमस्ते", "दुनिया"]
    assert langid.words_of("A1b É\u0301c 日本x 𐐀𐐁") == ["a", "b", "é\u0301c", "日本x", "𐐨𐐩"]
    for text in ("Die größte Straße, naïve l'été 3e ½ x²y", "abc déf", "١٢ عربى"):
        assert langid.words_of(text) == regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())


def test_language_of_nothing_learned(spark):
    train = spark.createDataFrame([("aa", "zuvoz zuvoz kaka"), ("bb", "mirim mirim lolo"), (None, "mirim"), ("cc", None)], "lang string, text string")
    model = langid.fitted(train)
    assert model.langs == ["aa", "bb"]
    of = lambda m, *texts: [r["lang_pred"] for r in langid.predicted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), m).orderBy("doc_id").collect()]
    assert of(model, "zuvot", "imiri", "ZUVOZ") == ["aa", "bb", "aa"]
    assert of(langid.fitted(train.limit(0)), "any") == ["und"]
    assert langid.predicted(train.select(F.lit(1).alias("doc_id"), "text").limit(0), model).collect() == []


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(lines[i] in lines[:i] for i in range(len(lines))), len(covered))


def test_quality_counts_and_verdicts(spark, documents):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    rows = quality.measured(documents, labels, ("doc_id", "text")).collect()
    assert len(rows) == documents.count()
    for r in rows:
        want = brute_counts(r["text"])
        assert tuple(r[c] for c in quality.COUNTS) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    passing = [r for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert sum(r["kept"] for r in passing) >= 0.97 * len(passing)
    forest = quality.fitted(quality.counted(documents, ("doc_id",)), labels)
    brute = [brute_score(forest, x) for x in quality.counted(documents, ("doc_id",)).orderBy("doc_id").select("features").toArrow()["features"].to_pylist()]
    got = sorted(rows, key=lambda r: r["doc_id"])
    assert all(abs(r["anomaly"] - b) < 1e-9 and r["kept"] == (not r["base_failed"] and b < forest.threshold) for r, b in zip(got, brute, strict=True))
    clash = odd(spark)
    for r in quality.judged(quality.counted(clash.drop("kept"), ("doc_id", "text")), forest).collect():
        assert tuple(r[c] for c in quality.COUNTS) == brute_counts(r["text"])
    assert quality.measured(clash, labels).count() == clash.count()
    assert all(r["kept"] != r["base_failed"] for r in quality.measured(documents, labels.limit(0)).collect())
    assert quality.measured(documents.limit(0), labels).collect() == []


def brute_score(forest, x):
    """The score by its definition: a walk down each tree, then two to the power of minus the mean path over its norm."""
    paths = []
    for feature, value in zip(forest.feature, forest.value, strict=True):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + 1 + (x[feature[node]] >= value[node])
        paths.append(value[node])
    return 2 ** (-sum(paths) / len(paths) / forest.norm)


def test_threshold_against_every_other(spark, documents):
    """No other score that loses as few good rows tells more poor rows from good ones."""
    rng = random.Random(2)
    for _ in range(50):
        cells = [(round(rng.random(), 2), rng.random() < 0.8, rng.randint(1, 9)) for _ in range(40)]
        cells = [(s, int(q), n) for s, q, n in cells]
        good, poor = (sum(n for _, q, n in cells if q == k) for k in (1, 0))
        share = lambda at, k, whole: sum(n for s, q, n in cells if q == k and s >= at) / whole  # noqa: B023, E731
        gains = {at: share(at, 0, poor) - share(at, 1, good) for at, _, _ in cells if share(at, 1, good) <= 0.1}
        found = quality.calibrated(cells, 0.1)
        assert max([0, *gains.values()]) <= (gains[found] if found < math.inf else 0) + 1e-12


def test_repeats_without_overflow(monkeypatch):
    words = [str(i).encode() for i in range(9000)]
    assert quality.repeat_words(words + words)[0] == 18000
    assert quality.repeat_words([b"a"] * 6) == (6, 5) and quality.repeat_words([b"a"] * 5) == (0, 4)


def test_forest_scores_isolated_points_higher():
    rng = quality.np.random.default_rng(1)
    x = rng.normal(0, 0.01, (2000, 3))
    x[:5] += 1
    scores = quality.grown(x).scores(x)
    assert scores[:5].min() > quality.np.quantile(scores[5:], 0.99)
    assert quality.calibrated([(0.9, 0, 5), (0.5, 1, 995), (0.95, 1, 5)]) == 0.9
    assert quality.calibrated([(0.9, 1, 5)]) == math.inf


def brute_model(texts):
    tokens = [[b"<s>", *(t or "").encode().lower().split(), b"</s>"] for t in texts]
    count = Counter(w for t in tokens for w in t[1:])
    pairs = Counter(p for t in tokens for p in zip(t, t[1:], strict=False))
    total, before, follow = Counter(), Counter(), defaultdict(list)
    for (v, w), n in pairs.items():
        total[v] += n
        before[w] += 1
        follow[v].append(n)
    of = lambda values: [sum(v == j for v in values) for j in (1, 2, 3, 4)]
    d2, d1 = ([0, *kneser_ney.discounts(of(x.values()))] for x in (pairs, before))
    types, vocabulary, n_all = len(pairs), len(count), sum(count.values())
    spare = sum(d1[min(k, 3)] for k in before.values()) / types if types else 1
    lower = lambda w: ((before[w] - d1[min(before[w], 3)]) / types if types else 0) + spare / (vocabulary + 1)

    def p(v, w):
        if not total[v]:
            return lower(w)
        return (pairs[v, w] - d2[min(pairs[v, w], 3)]) / total[v] + sum(d2[min(n, 3)] for n in follow[v]) / total[v] * lower(w)

    def score(text):
        t = [b"<s>", *(text or "").encode().lower().split(), b"</s>"]
        return len(t) - 1, sum(count[w] > 0 for w in t[1:]), n_all, sum(math.log10((count[w] + 0.5) / (n_all + 0.5 * (vocabulary + 1))) for w in t[1:]), sum(math.log10(p(v, w)) for v, w in zip(t, t[1:], strict=False))

    return p, count, score


@pytest.mark.parametrize("chunk", [4_000_000, 3_000])
def test_kneser_ney_against_brute_force(spark, documents, monkeypatch, chunk):
    monkeypatch.setattr(kneser_ney, "CHUNK", chunk)
    rows = documents.collect()
    train = [r["text"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
    p, count, score = brute_model(train)
    assert abs(sum(p(b"the", w) for w in count) + p(b"the", b"<unseen>") - 1) < 1e-9
    own = documents.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1").alias("learn"))
    more = odd(spark).select((F.col("doc_id") + 10**9).alias("doc_id"), "text", F.lit(None).cast("boolean").alias("learn"))
    whole = own.union(more)
    by_id = {r["doc_id"]: r["text"] for r in whole.collect()}
    got = kneser_ney.scored(whole.withColumn("score", F.lit("clash")), F.col("learn"), shards=5).collect()
    assert len(got) == whole.count()
    for r in got:
        want = score(by_id[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert abs(r["base_score"] - want[3]) < 1e-6 and abs(r["score"] - want[4]) < 1e-6


def test_kneser_ney_without_training_rows(spark, documents):
    rows = kneser_ney.scored(documents.limit(5), F.lit(False)).collect()
    assert len(rows) == 5 and all(r["score"] == 0 and r["n_known"] == 0 for r in rows)
    assert kneser_ney.scored(documents.limit(0), F.lit(True)).collect() == []


def test_large_counts_are_exceptions(spark):
    rows = spark.createDataFrame([("a b " * 400,), ("c d",)], "text string")
    _, _, score = brute_model(["a b " * 400, "c d"])
    for r in kneser_ney.scored(rows, F.lit(True), keep=("text",), shards=3).collect():
        assert abs(r["score"] - score(r["text"])[4]) < 1e-6


def test_kneser_ney_refuses_other_rows_than_it_answered():
    texts = [kneser_ney.tokens_of("a b c", kneser_ney.WordHashes())]
    chunk = kneser_ney.chunk_of(texts, [True], 2, kneser_ney.np.empty(0, kneser_ney.U))
    numbers = kneser_ney.numbers_of([0] * 4, [0] * 8)
    with pytest.raises(ValueError, match="another order"):
        kneser_ney.scores_of(chunk, numbers, kneser_ney.np.zeros(3, int), kneser_ney.np.zeros((5, len(chunk.names)), int))
