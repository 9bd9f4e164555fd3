"""BPE with word ends over an index of pair occurrences, and decoding.

A worker splits a group of texts into words, and the words that it doesn't remember are laid out as symbols one after
another. An index maps every pair that has a rank to all its positions in the layout. The active ranks are applied in
ascending order, each at all its positions from left to right; the pairs that a merge makes enter their lists, and a
position whose pair is gone is passed over when its list's turn comes. As every token is made by a lower rank than any pair that holds it, a merge never activates a rank
below its own, so one pass over the ranks finishes all words.

The file's special tokens are cut out of the text as it stands; what lies between is normalised and split by the file's
rules. Nulls and empty texts have no ids and decode to nothing. Rows are independent: repeated rows and null ids give
repeated results. Surplus columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tessera.llm.bpe import NEITHER, YOUNG, grouped
from tessera.llm.common import bounded_batches

#: Words that a worker remembers, and their characters in all; the memory is emptied when full.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8_000_000
#: Ends a word in the layout; no token has this id.
GAP = -1


class Merges:
    """Tokens and merges of a file; merge r makes ``made[r]`` of the pair of tokens ``pairs[r]``."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.vocab, self.word_end = vocab, word_end
        self.pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        #: A pair's key is left * width + right, which no pair with a GAP shares.
        self.width = max(vocab.values(), default=0) + 2
        self.ranks = {a * self.width + b: r for r, (a, b) in enumerate(self.pairs)}
        made_by = {token: r for r, token in enumerate(self.made)}
        if len(made_by) < len(self.made) or any(made_by.get(part, -1) >= r for r, pair in enumerate(self.pairs) for part in pair):
            raise ValueError("a token is made twice, or by a higher rank than a pair that holds it")

    def symbols(self, word: str) -> list[int]:
        """The ids of a word's characters, the last with the mark of a word's end."""
        return [*(self.vocab[c] for c in word[:-1]), self.vocab[word[-1] + self.word_end]] if word else []

    def apply(self, words: list[list[int]]) -> list[list[int]]:
        """The words' symbols after all merges."""
        layout, starts = [GAP], []
        for word in words:
            starts.append(len(layout))
            layout += word
            layout.append(GAP)
        before, after = list(range(-1, len(layout) - 1)), list(range(1, len(layout) + 1))
        ranks, places, width = self.ranks, {}, self.width
        for at, (left, right) in enumerate(pairwise(layout)):
            rank = ranks.get(left * width + right)
            if rank is not None:
                if rank in places:
                    places[rank].append(at)
                else:
                    places[rank] = [at]
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            (left, right), made = self.pairs[rank], self.made[rank]
            for at in sorted(places.pop(rank)):
                gone = after[at]
                if layout[at] != left or layout[gone] != right:  # another merge has taken a part since
                    continue
                first, last = before[at], after[gone]
                layout[at], layout[gone] = made, GAP
                after[at], before[last] = last, at
                for place, new in ((first, layout[first] * width + made), (at, made * width + layout[last])):
                    now = ranks.get(new)
                    if now is not None:
                        if now in places:
                            places[now].append(place)
                        else:
                            places[now] = [place]
                            heapq.heappush(active, now)
        found = []
        for start in starts:
            ids, at = [], start
            while layout[at] != GAP:
                ids.append(layout[at])
                at = after[at]
            found.append(ids)
        return found


class Codec:
    """Encodes and decodes whole texts; made once in each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as text:
            said = json.load(text)
        model, kinds = said["model"], said["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or [k["type"] for k in kinds] != ["Split", "ByteLevel"] or said["decoder"] or said["post_processor"] or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"]):
            raise ValueError("not a file of BPE with word ends")
        self.merges = Merges(model["vocab"], [tuple(pair) for pair in model["merges"]], model["end_of_word_suffix"] or "")
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.pattern = regex.compile(kinds[0]["pattern"]["Regex"])
        ends = [[int(x, 16) for x in part.split("-")] for part in YOUNG.split()]
        self.young = regex.compile("[" + "".join(f"{chr(e[0])}-{chr(e[-1])}" for e in ends) + "]")
        self.late = re.compile(f"[{chr(min(ends)[0])}-{chr(0x10FFFF)}]")  # quicker, and most texts end here
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: token for token, i in chain(model["vocab"].items(), self.special.items())}
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        #: The character that stands for each byte; a bytes string decoded as Latin-1 and translated is its visible form.
        self.visible = {b: alphabet.pre_tokenize_str(bytes([b]).decode("latin-1"))[0][0][-1] for b in range(128)} | self.high(alphabet)
        #: Of each remembered word its ids as text, and its tokens as decoded text.
        self.texts: dict[str, str] = {}
        self.plain: dict[str, str] = {}
        self.size = 0

    @staticmethod
    def high(alphabet: ByteLevel) -> dict[int, str]:
        """Bytes above 127 stand in no text alone: their characters are read off letters that hold them."""
        found = {}
        for code in [*range(0x80, 0x800, 0x20), *range(0x80, 0xC0), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x10000)]:
            if not 0xD800 <= code < 0xE000:
                found |= dict(zip(chr(code).encode(), alphabet.pre_tokenize_str(chr(code))[0][0], strict=True))
        return found

    def learn(self, words: set[str]) -> None:
        order = [w for w in words if w not in self.special]
        shown = [w.encode().decode("latin-1").translate(self.visible) for w in order]
        found = self.merges.apply([self.merges.symbols(w) for w in shown])
        for word, ids in chain(zip(order, found, strict=True), ((w, [self.special[w]]) for w in words if w in self.special)):
            self.texts[word] = " ".join(map(str, ids))
            self.plain[word] = " ".join(map(self.tokens.__getitem__, ids))
        self.size += sum(map(len, words))

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens. Letters that the file's library doesn't know as such are no letters."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        text = self.normal(text)
        if not self.late.search(text) or not self.young.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.young.sub(NEITHER, text))]

    def words(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.split(text)
        # Words are lower case and hold no letter beside a sign, so none equals a special token.
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.split(part))]

    def known(self, texts: list[str]) -> list[list[str]]:
        """The texts' words, all of them remembered. The memory is emptied when full, but never of these."""
        words = list(map(self.words, texts))
        needed = set().union(*words)
        if fresh := needed.difference(self.texts):
            if len(self.texts) + len(fresh) > REMEMBERED or self.size > REMEMBERED_CHARS:
                for memory in (self.texts, self.plain):
                    memory.clear()
                self.size, fresh = 0, needed
            self.learn(fresh)
        return words

    def ids_of(self, words: list[str]) -> list[int]:
        return [int(i) for word in words for i in self.texts[word].split(" ")]

    def encode(self, text: str) -> list[int]:
        return self.ids_of(self.known([text])[0])

    def digests(self, words: list[str]) -> tuple[int, str, str]:
        """How many ids, the digest of their decimals joined by spaces, and that of the text decoded from them. Both are
        put together from what each word's ids are as text and as tokens."""
        ids = " ".join(map(self.texts.__getitem__, words))
        plain = " ".join(map(self.plain.__getitem__, words))
        return ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        """The tokens, joined by spaces, as the file names no decoder; an id without a token is left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """One row for each row of docs: the id, the columns of ``keep``, ``ids`` (unless with_ids is false), ``n_tokens``
    and two digests: of the decimal ids joined by spaces, and of the text decoded from the ids."""
    bounded_batches(docs.sparkSession)
    columns = list(dict.fromkeys([id_col, *keep]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    schema = kinds + (", ids array<int>" if with_ids else "") + ", n_tokens long, ids_sha256 string, decoded_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            found, every = [], []
            for texts in grouped([t or "" for t in batch.column("_text").to_pylist()]):
                for words in own.known(texts):
                    found.append(own.digests(words))
                    if with_ids:
                        every.append(pa.array(own.ids_of(words), pa.int32()))
            n, ids_sha, plain_sha = ([row[i] for row in found] for i in range(3))
            arrays = [batch.column(c) for c in columns]
            if with_ids:
                offsets = pa.array([0, *accumulate(n)], pa.int32())
                arrays.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(every) if every else pa.array([], pa.int32())))
            arrays += [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(plain_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*columns, docs[text_col].alias("_text")).mapInArrow(work, schema)


def decoded(rows: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ``text``: the tokens of ``ids`` joined by spaces; no ids give an empty text."""
    bounded_batches(rows.sparkSession)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.select(id_col, rows[ids_col].alias("_ids")).mapInArrow(work, schema)
