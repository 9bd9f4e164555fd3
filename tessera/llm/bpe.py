"""Byte-level BPE by a sentencepiece model that is serialised from a rank file, and its exact inverse.

Every byte becomes one code point, every rank a piece whose score is the negative rank, and the normaliser is
the identity, so that sentencepiece merges the same pairs in the same order as the rank file asks for.
Texts are split into pre-tokens first; each is encoded apart and its pieces are the ids.

Nulls and empty texts have no ids and decode to no bytes. Rows are independent: repeated rows and null ids
give repeated results. Surplus columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from tessera.llm.common import bounded_batches

#: Pre-tokens that a worker remembers, and their characters in all; the memory is emptied when full.
REMEMBERED, REMEMBERED_CHARS = 200_000, 4_000_000
#: Characters of the texts that are encoded together.
GROUP_CHARS = 500_000
#: First code point of the 256 that stand for bytes: letters without special meaning to the library.
FIRST = 0x4E00
#: Bytes to their code points; a bytes string decoded as Latin-1 and translated is its mapped form.
MAPPED = {b: FIRST + b for b in range(256)}

# Letters and digits younger than Unicode 16, which the rank file's library doesn't know as such.
YOUNG = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F "
    "12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)


#: A code point that is no letter, digit or space in any version of Unicode.
NEITHER = "\uFDD0"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(MAPPED)


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece i is the token of rank i, and the last piece is the unknown one."""
    by_rank = {rank: token for token, rank in ranks.items()}
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    model = sentencepiece_model_pb2.ModelProto()
    last = max(by_rank, default=-1)
    for rank in range(last + 1):
        token = by_rank.get(rank)
        # A rank without a token keeps its place by a piece that no byte-mapped text can hold.
        model.pieces.add(piece=mapped(token) if token is not None else f"<{rank}>", score=-float(rank), type=kinds.NORMAL if token is not None else kinds.UNUSED)
    model.pieces.add(piece="<unk>", score=0.0, type=kinds.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_id = sentencepiece_model_pb2.TrainerSpec.BPE, last + 2, last + 1
    spec.bos_id = spec.eos_id = spec.pad_id = -1
    norm = model.normalizer_spec
    norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encodes and decodes whole texts; made once in each worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.ranks))
        self.pattern = regex.compile(pattern)
        ends = [[int(x, 16) for x in part.split("-")] for part in YOUNG.split()]
        self.young = regex.compile("[" + "".join(f"{chr(e[0])}-{chr(e[-1])}" for e in ends) + "]")
        #: Of each remembered pre-token its ids, the same as text, and the bytes that they stand for.
        self.ids: dict[str, list[int]] = {}
        self.texts: dict[str, str] = {}
        self.plain: dict[str, bytes] = {}
        self.size = 0

    def learn(self, parts: set[str]) -> None:
        """Remembers distinct pre-tokens. One that is a token itself is that token, as in the rank file's library."""
        rest = []
        for part in parts:
            rank = self.ranks.get(part.encode())
            if rank is None:
                rest.append(part)
            else:
                self.ids[part], self.texts[part], self.plain[part] = [rank], str(rank), self.tokens[rank]
        if rest:
            found = self.pieces.encode([p.encode().decode("latin-1").translate(MAPPED) for p in rest], out_type=int, num_threads=1)
            for part, ids in zip(rest, found, strict=True):
                self.ids[part], self.texts[part] = ids, ",".join(map(str, ids))
                self.plain[part] = b"".join(map(self.tokens.__getitem__, ids))
        self.size += sum(map(len, parts))

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.young.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.young.sub(NEITHER, text))]

    def known(self, texts: list[str]) -> list[list[str]]:
        """The texts' pre-tokens, all of them remembered. The memory is emptied when full, but never of these. The library
        takes long for a call and little for a pre-token, so many texts are looked at before it is called."""
        parts = list(map(self.split, texts))
        needed = set().union(*parts)
        if fresh := needed.difference(self.ids):
            if len(self.ids) + len(fresh) > REMEMBERED or self.size > REMEMBERED_CHARS:
                for memory in (self.ids, self.texts, self.plain):
                    memory.clear()
                self.size, fresh = 0, needed
            self.learn(fresh)
        return parts

    def ids_of(self, parts: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, parts)))

    def encode(self, text: str) -> list[int]:
        return self.ids_of(self.known([text])[0])

    def digests(self, parts: list[str]) -> tuple[int, str, str]:
        """How many ids, the digest of their decimals joined by commas, and that of the bytes decoded from them. Both are
        put together from what each pre-token's ids are as text and as bytes."""
        ids = ",".join(map(self.texts.__getitem__, parts))
        plain = b"".join(map(self.plain.__getitem__, parts))
        return ids.count(",") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain).hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of GROUP_CHARS characters or one text."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """One row for each row of docs: the id, the columns of ``keep``, ``ids`` (unless with_ids is false),
    ``n_tokens`` and two digests: of the decimal ids joined by commas, and of the bytes decoded from the ids."""
    bounded_batches(docs.sparkSession)
    columns = list(dict.fromkeys([id_col, *keep]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    schema = kinds + (", ids array<int>" if with_ids else "") + ", n_tokens long, ids_sha256 string, decoded_sha256 string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, shas, plain, every = [], [], [], []
            for texts in grouped([t or "" for t in batch.column("_text").to_pylist()]):
                for parts in own.known(texts):
                    count, sha, decoded = own.digests(parts)
                    n.append(count)
                    shas.append(sha)
                    plain.append(decoded)
                    if with_ids:
                        every.append(pa.array(own.ids_of(parts), pa.int32()))
            arrays = [batch.column(c) for c in columns]
            if with_ids:
                offsets = pa.array([0, *accumulate(n)], pa.int32())
                arrays.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(every) if every else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(plain, pa.string())], names=[*columns, *(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*columns, docs[text_col].alias("_text")).mapInArrow(work, schema)
