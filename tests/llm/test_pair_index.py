"""BPE over pair occurrences beside the file's library."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import pair_index

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = pair_index.codec(PATH)
ODD = ["", " ", "\t\n\x0b\x1c\x85 ", "a", "aaaaaaaaab", "It's we'LL DON'T 's", "<|endoftext|>a<|startoftext|><|END", "<|endoftext|>", "Σας İstanbul ǅ ﬁ", "é ẛ̣", "中文字 한국어 \U0001f600\U0001f468‍\U0001f469", "12345 ½ ²", "՘֋ \U0001e6c0x", "x" * 3000, "힣가"]


@pytest.mark.parametrize("text", ODD)
def test_ids_and_text_of_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == want
    assert CODEC.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcABC'stl <|>dé́Σσς\n12"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert CODEC.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def plain(pairs: list[tuple[str, str]], word: str) -> list[str]:
    """The lowest rank first, from the left, again and again."""
    parts = [*word[:-1], word[-1] + "$"]
    while True:
        found = [(pairs.index(p), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=12), max_size=8), st.randoms(use_true_random=False))
def test_merges_of_all_words_beside_one_by_one(words, random):
    tokens, pairs = ["a", "b", "a$", "b$"], []
    for _ in range(6):  # merges in the order that a trainer would make them
        left, right = random.choice([t for t in tokens if not t.endswith("$")]), random.choice(tokens)
        if left + right not in tokens:
            pairs.append((left, right))
            tokens.append(left + right)
    merges = pair_index.Merges({t: i for i, t in enumerate(tokens)}, pairs, "$")
    got = merges.apply([merges.symbols(w) for w in words])
    assert [[tokens[i] for i in ids] for ids in got] == [plain(pairs, w) for w in words]


def test_ranks_that_come_too_late_are_refused():
    vocab = {t: i for i, t in enumerate(["a", "b", "ab", "aab"])}
    with pytest.raises(ValueError):
        pair_index.Merges(vocab, [("a", "ab"), ("a", "b")], "")


def test_memory_that_is_full_changes_nothing(monkeypatch):
    monkeypatch.setattr(pair_index, "REMEMBERED", 3)
    own = pair_index.Codec(PATH)
    texts = [f"word{i} other{i % 2} the" for i in range(20)]
    assert [own.encode(t) for t in texts] == [CODEC.encode(t) for t in texts]


def test_rows_of_a_table(spark):
    texts = [None, *ODD, "hello <|endoftext|> again", "hello <|endoftext|> again"]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")
    rows = pair_index.encoded(docs, PATH)
    got = sorted(rows.collect(), key=repr)
    want = []
    for i, text in enumerate(texts):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        said = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((None if i == 3 else i, ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    back = {(r.doc_id, r.text) for r in pair_index.decoded(rows, PATH).collect()}
    assert back == {(w[0], LIBRARY.decode(w[1], skip_special_tokens=False)) for w in want}
    assert pair_index.encoded(docs.where("false"), PATH).collect() == []
    assert pair_index.encoded(docs, PATH, keep=("ids",), with_ids=False).columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
