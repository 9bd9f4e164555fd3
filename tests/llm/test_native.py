import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import hilbert, mixture, winnow
from tessera.llm.common import running

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [(1, None, "a", None), (2, "", None, "en"), (3, "one", "b", "de"), (3, "one", "b", "de"), (None, "two words", "Ä", "en"), (7, "w " * 9000, "a", "en"), (8, "x\ty\n z", "z", None), (9, "same text", "a", "en"), (10, "same text", "a", "en")]


def odd(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, source string, lang string, shard string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def test_running_sums_follow_a_global_order(spark):
    rows = [(i * 7919 % 1000, i % 3, i % 5) for i in range(3000)]
    got = running(spark.createDataFrame(rows, "k long, g long, v long"), ["k", "v"], {"before": "v"}, by=["g"]).collect()
    for g in range(3):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine)))
        assert [(r["k"], r["v"]) for r in mine] == sorted((k, v) for k, h, v in rows if h == g)
        so_far = 0
        for r in mine:
            assert r["before"] == so_far
            so_far += r["v"]


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3)])
def test_curve_visits_every_cell_step_by_step(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(*[F.expr(f"cast(shiftright(id, {bits * i}) & {(1 << bits) - 1} as int)").alias(f"x{i}") for i in range(n)])
    got = sorted((r["h"], *(r[f"x{i}"] for i in range(n))) for r in cells.withColumn("h", hilbert.curve_index([F.col(f"x{i}") for i in range(n)], bits)).collect())
    assert [r[0] for r in got] == list(range(len(got)))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(got, got[1:], strict=False))


def test_shards_are_gapless_and_near_equal(spark, documents):
    rows = hilbert.sharded(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    for s in range(8):
        mine = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert [r["curve"] for r in mine] == sorted(r["curve"] for r in mine)


def test_sharding_odd_rows(spark):
    rows = hilbert.sharded(odd(spark)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["shard"] < 8 for r in rows)
    assert [(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 1] == [(1, 0)]
    assert hilbert.sharded(odd(spark).limit(0)).collect() == []


def test_strings_are_placed_by_their_whole_order(spark):
    """Values that share any prefix lie in cells of their own; cells follow the middle of a value's rows."""
    values = [None] * 4 + ["https://a"] * 10 + ["https://z"] * 10 + ["forum_de"] * 3 + ["forum_dx"] * 9 + ["x" * 500 + "1"] * 7 + ["x" * 500 + "2"] * 7 + ["é"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
    got = {r["v"]: r["c"] for r in rows.select("v", hilbert.string_cells(rows, "v", 32).alias("c")).distinct().collect()}
    before, want = 0, {None: 0}
    for v in sorted({v for v in values if v is not None}, key=lambda v: v.encode()):
        n = values.count(v)
        want[v] = (before + (n - 1) // 2) * 32 // len(values)
        before += n
    assert got == want and got["https://a"] != got["https://z"] and got["forum_de"] != got["forum_dx"]


def test_shards_prune(spark, documents):
    """A file is read for a value if it lies in the file's range: fewer files than if rows were dealt at random."""
    metadata = {r["doc_id"]: r for r in documents.collect()}
    shard = {r["doc_id"]: r["shard"] for r in hilbert.sharded(documents).collect()}
    dealt = {i: zlib.crc32(str(i).encode()) % 8 for i in shard}

    def read(of, key):
        ranges = {}
        for i, s in of.items():
            v = key(metadata[i])
            low, high = ranges.get(s, (v, v))
            ranges[s] = min(low, v), max(high, v)
        return sum(low <= key(r) <= high for r in metadata.values() for low, high in ranges.values()) / len(metadata)

    keys = (lambda r: r["source"] or "", lambda r: r["lang"] or "", lambda r: len((r["text"] or "").encode()))
    own, random = ([read(of, key) for key in keys] for of in (shard, dealt))
    assert all(a < b for a, b in zip(own, random, strict=True)) and sum(own) < 0.75 * sum(random)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, left = set(), 1.5 * sum(sizes.values())
    while True:
        rest = left - sum(2 * sizes[s] for s in full)
        spread = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / spread > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else rest * weight[s] / spread for s in order}
        full |= over


@pytest.mark.parametrize("block", [64, 1])
def test_mix_meets_targets(spark, documents, block):
    for docs in (documents.limit(40) if block == 1 else documents, odd(spark)):
        texts = docs.collect()
        sizes = {}
        for r in texts:
            sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
        want = brute_targets(sizes)
        rows = mixture.spans(docs, block=block).collect()
        taken, of_row = dict.fromkeys(sizes, 0), {}
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
            assert r["slot"] is None or 0 <= r["begin"] and r["begin"] + r["words"] <= r["size"]
            taken[r["source"]] += r["words"]
            of_row[r["sid"], r["rank"]] = of_row.get((r["sid"], r["rank"]), 0) + r["words"]
            assert of_row[r["sid"], r["rank"]] <= 2 * r["size"]
        assert len(of_row) == len(texts) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        # A slot holds one block of one source: its spans don't overlap and aren't longer than a block.
        slots = {}
        for r in rows:
            if r["slot"] is not None:
                slots.setdefault(r["slot"], []).append(r)
        assert all(len({r["source"] for r in own}) == 1 and sum(r["words"] for r in own) <= block for own in slots.values())
        got = mixture.mixed(docs, block=block).collect()
        assert sorted(r["taken"] for r in got) == sorted(of_row.values())
        key = lambda rows: sorted(map(str, rows))
        assert key(got) == key(mixture.mixed(docs.repartition(3), block=block).collect())
        # Copies: as many as the words make, each where its turn begins.
        size = {(r["sid"], r["rank"]): r["size"] for r in rows}
        assert mixture.copies(docs, block=block).count() == sum(math.floor(n / size[k] + 0.5) for k, n in of_row.items() if size[k])


def test_mix_is_interleaved(spark, documents):
    """In each stretch of the schedule every source has its share: the slots' order matters, not just their numbers."""
    rows = sorted((r["slot"], r["source"], r["words"]) for r in mixture.spans(documents, block=256).collect() if r["slot"] is not None)
    whole, total = {}, sum(r[2] for r in rows)
    for _, s, n in rows:
        whole[s] = whole.get(s, 0) + n
    so_far, seen = {}, 0
    for _, s, n in rows:
        so_far[s], seen = so_far.get(s, 0) + n, seen + n
        assert all(abs(so_far.get(x, 0) / total - whole[x] / total * seen / total) < 0.05 for x in whole)


def test_schedule_is_spread_evenly(spark):
    sources = spark.createDataFrame([("a", 4000, 0, 5, 4000.0), ("b", 1000, 1, 2, 1000.0)], "source string, source_size long, sid long, weight long, target double")
    slots = sorted(mixture.schedule(sources, block=10).collect())
    assert len(slots) == 500
    for n in range(20, 501, 20):
        assert abs(sum(r["sid"] for r in slots[:n]) - n / 5) <= 3
    assert sorted(r["block"] for r in slots if r["sid"] == 1) == list(range(100))


def test_mix_of_nothing(spark):
    assert mixture.mixed(odd(spark).limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixture.mixed(blank).collect()] == [0, 0]


UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def brute_tokens(text):
    return [t for w in WORD.findall(text) for t in (list(w) if len(w) > 32 or UNSPACED.search(w) else [w])]


def brute_print(spark, texts, k=5, w=8):
    """Winnowing by its definition: every k-gram hashed anew from its tokens' hashes, every window searched."""
    tokens = {t: brute_tokens(t) for t in texts}
    every = sorted({x for ts in tokens.values() for x in ts})
    of = {r["t"]: r["h"] for r in spark.createDataFrame([(x,) for x in every], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(winnow.PRIME)).alias("h")).collect()}
    value = lambda gram: sum(of[x] * pow(winnow.BASE, len(gram) - 1 - i) for i, x in enumerate(gram)) % winnow.PRIME
    out = {}
    for t, ws in tokens.items():
        hs = [value(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
        picked = []
        for i in range(max(1, len(hs) - w + 1)) if hs else []:
            window = range(i, min(i + w, len(hs)))
            best = max(window, key=lambda j: (-hs[j], j))
            if best not in picked:
                picked.append(best)
        out[t] = " ".join(f"{hs[j]:x}@{j}" for j in picked), {hs[j] for j in picked}
    return out


def test_winnowing_against_brute_force(spark, documents):
    for docs in (documents.limit(60), odd(spark)):
        texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
        edited = []
        for i, (_, text) in enumerate(texts):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + texts[(i + 1) % len(texts)][1][:half])
        prints = brute_print(spark, {t for _, t in texts} | set(edited))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        want = sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t][0], prints[e][0], round(like(prints[t][1], prints[e][1]), 9), round(like(prints[t][1], prints[texts[(j + 1) % len(texts)][1]][1]), 9)) for j, ((i, t), e) in enumerate(zip(texts, edited, strict=True)))
        got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in winnow.fingerprinted(docs).collect())
        assert got == want
    assert winnow.fingerprinted(odd(spark).limit(0)).collect() == []


@pytest.mark.parametrize(("k", "w"), [(5, 8), (3, 5), (1, 1), (2, 6)])
def test_prints_of_all_scripts_and_sizes(spark, k, w):
    texts = ["", "one", "𠀀𠀁 rare", "日本語の文章には空白がありません。" * 9, "ภาษาไทย " * 30, "x" * 400, "mixed 日本 words and " + "ab" * 40, "a a a a a a a a a a a a", *(" ".join(f"w{i % 37}" for i in range(n)) for n in (1, 4, 5, 6, 11, 12, 13, 67, 68, 69, 133, 500))]
    want = brute_print(spark, set(texts), k, w)
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in rows.select("text", winnow.written(winnow.chosen(F.col("text"), k, w)).alias("p")).collect():
        assert r["p"] == want[r["text"]][0], r["text"][:40]


def test_neighbours_across_buckets(spark, monkeypatch):
    """Ids that repeat, that are null, and many of them: each row is followed by the next, the last by the first."""
    monkeypatch.setattr(winnow, "BUCKET_BYTES", 40)
    rng = random.Random(3)
    rows = [(rng.choice([None, 5, 5, 5, rng.randrange(-50, 50)]), f"t{i}") for i in range(300)]
    for part in (rows, rows[:1], [(None, "a"), (None, "b")], [(7, "a")] * 5):
        df = spark.createDataFrame(part, "i long, t string").repartition(3)
        tie = {r["t"]: r["h"] for r in df.select("t", F.xxhash64("t").alias("h")).collect()}
        order = sorted(part, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]], r[1]), reverse=True)
        want = sorted((str(a[0]), a[1], order[(j + 1) % len(order)][1]) for j, a in enumerate(order))
        got = sorted((str(r["i"]), r["t"], r["next_x"]) for r in winnow.followed(df, {"x": F.col("t")}, "i", "t").collect())
        assert got == want
        assert len(part) < 100 or winnow.bucketed(df, "i", "t").where("i = 5").select("_bucket").distinct().count() > 3


def test_shared_passages_are_found(spark):
    passage = " ".join(f"p{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1))
    docs = spark.createDataFrame([(i, f"{' '.join(f'{i}x{j}' for j in range(30))} {passage} tail{i}") for i in range(2)], "doc_id long, text string")
    a, b = (set(r["h"]) for r in docs.select(winnow.hashes_of(winnow.chosen(F.col("text"))).alias("h")).collect())
    assert a & b
