import hashlib
import random
from collections import Counter, defaultdict

from tessera.llm import near_dup
from tessera.llm.components import components


def brute(docs, k=4):
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    holders = defaultdict(list)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        met = Counter(j for s in own for j in holders[s])
        for j, both in met.items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(i)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def same(spark, docs, schema="doc_id long, text string"):
    rows = near_dup.linked(spark.createDataFrame(docs, schema), shingle=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == brute(docs)


def test_families_against_brute_force(spark):
    """A family of edited copies, none of which need be similar to the least id, besides texts that share passages."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(40)]
    docs = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            own[rng.randrange(len(own))] = word()
        docs.append((i, " ".join(own)))
    docs += [(1000 + i, " ".join([*passage, *(word() for _ in range(rng.choice([2, 6, 60])))])) for i in range(80)]
    docs += [(2000 + i, docs[i][1].upper().replace(" ", "\n")) for i in range(20)]
    rng.shuffle(docs)
    same(spark, docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two  three"), (8, "É a b c"), (9, "é a b c"), (10, "x " * 5000)]
    same(spark, docs)


def test_repeated_rows_null_ids_and_other_columns(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "y"), (2, "a b c d e", None), (None, "a b c d e", "z"), (None, None, None)]
    got = near_dup.linked(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_five_words_unless_another_number_is_asked_for(spark):
    words = [f"w{i}" for i in range(40)]
    edited = [*words[:20], "other", *words[21:]]  # 33 of 41 shingles of four words are shared, 31 of 41 of five
    rows = [(1, " ".join(words)), (2, " ".join(edited))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda **how: {r["doc_id"]: (r["n_shingles"], r["kept"]) for r in near_dup.linked(docs, **how).collect()}
    assert of(shingle=4) == {1: (37, True), 2: (37, False)}
    assert of() == {1: (36, True), 2: (36, True)}


def test_empty_table(spark):
    assert near_dup.linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_lose_no_pair_at_the_threshold():
    """Pairs at exactly 0.8, of many sizes: all pass both sketches and share a band."""
    rng = near_dup.np.random.default_rng(4)
    lost = 0
    for n in (9, 18, 45, 90, 180, 450, 900):
        for _ in range(150):
            whole = rng.integers(0, 2**64, n * 10 // 9, dtype=near_dup.U)
            shared, rest = whole[: n * 8 // 9], whole[n * 8 // 9 :]
            a, b = (near_dup.np.unique(near_dup.np.concatenate([shared, part])) for part in (rest[: len(rest) // 2], rest[len(rest) // 2 :]))
            both = len(near_dup.np.intersect1d(a, b))
            if 100 * both < near_dup.PERCENT * (len(a) + len(b) - both):
                continue
            (bands_a, sketch_a), (bands_b, sketch_b) = near_dup.signature(a), near_dup.signature(b)
            flips = int(near_dup.np.bitwise_count(sketch_a ^ sketch_b).sum())
            whole_flips = int(near_dup.np.bitwise_count(near_dup.parity(a) ^ near_dup.parity(b)).sum())
            lost += not (flips <= near_dup.most_flips() and whole_flips <= near_dup.most_whole_flips(near_dup.np.array(len(a) + len(b))) and (bands_a == bands_b).any())
    assert lost == 0


def test_hard_buckets_against_brute_force(spark, monkeypatch):
    """Clusters whose members are near the threshold of one another, in blocks of a few members: hubs leave several
    components, and some pairs that pass the sketches fail."""
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 900)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(90)]
    docs = []
    for i in range(220):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            own[rng.randrange(len(own))] = word()
        docs.append((i, " ".join(own)))
    same(spark, docs)


def test_sketch_estimates_high_similarity():
    hashes = near_dup.WordHashes()
    text = [f"w{i}" for i in range(600)]
    a = near_dup.shingles_of(" ".join(text), hashes)
    text[300] = "other"
    b = near_dup.shingles_of(" ".join(text), hashes)
    flips = int(near_dup.np.bitwise_count(near_dup.signature(a)[1] ^ near_dup.signature(b)[1]).sum())
    true = len(near_dup.np.intersect1d(a, b)) / len(near_dup.np.union1d(a, b))
    assert abs(near_dup.estimated(flips) - true) < 0.05


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_components_of_chains_with_names_in_no_order(spark):
    """Lower labels must not have to walk along a chain: union-find is the judge."""
    rng = random.Random(11)
    numbers = rng.sample(range(10**9), 3000)
    digests = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    for names, kind in ((numbers, "long"), (digests, "binary")):
        # One chain of two thousand nodes, one of a thousand, and a tree over some of the second.
        pairs = [*zip(names[:2000], names[1:2000]), *zip(names[2000:], names[2001:]), *((names[2000 + i], names[2000 + i // 3]) for i in range(1, 900, 7))]
        parent = {n: n for n in names}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in pairs:
            low, high = sorted((find(x), find(y)))
            parent[high] = low
        rng.shuffle(pairs)
        got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, f"a {kind}, b {kind}")).collect()}
        assert {bytes(n) if kind == "binary" else n: bytes(v) if kind == "binary" else v for n, v in got.items()} == {n: find(n) for n in names}


def test_components_of_no_edges_and_null_ends(spark):
    edges = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")
    assert components(edges).collect() == []
    assert components(edges.union(spark.createDataFrame([(9, 4), (4, 9), (7, 9)], edges.schema))).orderBy("node").collect() == [(4, 4), (7, 4), (9, 4)]
