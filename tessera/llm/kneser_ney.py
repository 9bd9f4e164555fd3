"""Interpolated modified Kneser-Ney bigrams, counted by Spark and kept as sorted hash arrays.

Tasks cut their texts into chunks of bounded size and send the distinct bigrams of each, with their counts in training
texts, to shards by hash. A shard merges what it gets, writes one file of sorted 64-bit bigram hashes and counts, maps
it into memory, and answers each chunk's bigrams from it. What it knows of single words goes on to word shards:
counts, distinct predecessors (the lower order's continuation counts), and how many followers were seen once, twice,
and more often (the back-off weights). Word shards write sorted files too and answer each chunk's words from them.
The answers to a chunk become two small files, in the order of the chunk's sorted hashes. Tasks then read the texts
once more, chunk by chunk, map the two files of the chunk, and score its texts. So a task opens the files of one shard
or of one chunk, whatever the size of the model, and the driver gets two rows of global numbers.

Every word of the text and one end are predicted; the first is preceded by a start. The lower order is
interpolated with the uniform distribution over the vocabulary and one unknown word, so every text has a score.

The table is read twice and must give the same rows in the same order both times, as files and checkpoints do; if the
answers don't fit a chunk, the task fails. Null, empty and blank texts are the end alone. Rows whose training flag is
null are scored and don't train. Repeated rows count again. Without training rows all probabilities are 1. Surplus
columns are ignored.
"""

from __future__ import annotations

import contextlib
import math
import os
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fresh_path, removed, settled, shuffle_partitions, stored

U = np.uint64
#: Tokens of a chunk that a task counts or scores at a time.
CHUNK = 3_000_000
REMEMBERED = 100_000
#: A word that makes more than one in so many tokens of a shard's share has its bigrams spread over at least so many
#: shards, and over one shard in so many. Which words do is told from some rows: it places rows and changes no result.
HEAVY_ONE_IN, SPREAD, SPREAD_ONE_IN = 8, 8, 8
HEAVY_ROWS, HEAVY_WORDS = 1_000, 4_096
#: Bytes of text for each shard, so that a shard fits in a task at any size of the corpus.
SHARD_BYTES = 64 << 20
#: Counts below this take one byte in a file; larger ones lie in a list of exceptions.
ESCAPE = 255
STEP, SALT = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
START, END = U(xxhash.xxh64_intdigest(b"start", 1)), U(xxhash.xxh64_intdigest(b"end", 2))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * STEP + mixed(word ^ SALT))


def pair_shard(before: np.ndarray, word: np.ndarray, shards: int, heavy: np.ndarray) -> np.ndarray:
    """By the first word, so that it is sent once for all that follow it; heavy words, sorted, by the second too."""
    home = mixed(before) % U(shards)
    many = found_in(heavy, before)[1]
    places = max(SPREAD, shards // SPREAD_ONE_IN)
    spread = mixed(word[many] ^ STEP) % U(places) * U(max(1, shards // places))
    home[many] = (home[many] + spread) % U(shards)
    return home.astype(np.int64)


def word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(word ^ SALT) % U(shards)).astype(np.int64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def tokens_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of start, words and end. bytes.lower() and bytes.split() know ASCII only, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 2, U)
    out[0], out[-1] = START, END
    out[1:-1] = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    return out


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    return (keys[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values])


def split(part: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has rows, with the rows' places."""
    order = np.argsort(part, kind="stable")
    for shard, own in slices(part[order]):
        yield shard, order[own]


#: Packed rows on their way. ``to`` is a shard, or a chunk where answers go. Kinds: PAIRS a chunk's bigrams; WORDS a
#: chunk's words; SEEN, FOLLOWED what a shard of bigrams knows of words; PAIR_ANSWERS, WORD_ANSWERS a shard's answers
#: to a chunk; PAIR_FACTS, WORD_FACTS sums for the global numbers; DONE a file that was written.
PAIRS, WORDS, SEEN, FOLLOWED, PAIR_ANSWERS, WORD_ANSWERS, PAIR_FACTS, WORD_FACTS, DONE = range(9)
SENT = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("source", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("facts", pa.list_(pa.int64()))])
SENT_SQL = "kind int, to long, source long, keys binary, values binary, facts array<long>"
#: Chunks that a task may have.
TASK_CHUNKS = 1 << 24


def sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(SENT.names, r, strict=True)) for r in rows], SENT)


def bytes_of(counts: np.ndarray) -> bytes:
    """Counts, mostly small: a byte each, and the places and values of large ones."""
    large = np.flatnonzero(counts >= ESCAPE)
    return np.int64(len(large)).tobytes() + large.astype(np.int64).tobytes() + counts[large].astype(np.int64).tobytes() + np.minimum(counts, ESCAPE).astype(np.uint8).tobytes()


def counts_in(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    large, values = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
    counts = np.frombuffer(raw, np.uint8, -1, 8 + 16 * n).astype(np.int64)
    counts[large] = values
    return counts


@dataclass
class Chunk:
    """The distinct bigrams and words of some texts, in an order that only depends on the texts and the shards."""

    lengths: np.ndarray  # tokens of each text
    before: np.ndarray  # of each distinct bigram, in the order in which shards get them
    word: np.ndarray
    count: np.ndarray  # in training texts
    pair_at: np.ndarray  # of each token its bigram
    pair_slices: list[tuple[int, slice]]
    names: np.ndarray  # distinct words, in the order in which word shards get them
    name_slices: list[tuple[int, slice]]


def chunk_of(texts: list[np.ndarray], trains: list[bool], shards: int, heavy: np.ndarray) -> Chunk:
    lengths = np.array([len(t) - 1 for t in texts])
    before, word = np.concatenate([t[:-1] for t in texts]), np.concatenate([t[1:] for t in texts])
    texts.clear()  # what was read is copied: a chunk's memory counts
    key = pair_hash(before, word)
    order = np.argsort(key)
    key = key[order]
    at = runs(key)
    run_of = np.empty(len(key), np.int32)  # a chunk has fewer tokens than that
    run_of[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.r_[at, len(key)]))
    del key
    count = np.add.reduceat(np.repeat(np.array(trains, bool), lengths)[order].astype(np.int64), at)
    first = order[at]
    del order
    before, word = before[first], word[first]
    part = pair_shard(before, word, shards, heavy)
    place = np.lexsort((before, part))  # equal words before pack well
    back = np.empty(len(place), np.int32)
    back[place] = np.arange(len(place), dtype=np.int32)
    names = np.unique(np.concatenate([before, word]))
    home = word_shard(names, shards)
    by_home = np.argsort(home, kind="stable")
    return Chunk(lengths, before[place], word[place], count[place], back[run_of], slices(part[place]), names[by_home], slices(home[by_home]))


def slices(part: np.ndarray) -> list[tuple[int, slice]]:
    """Each shard of a sorted list, with its slice."""
    at = runs(part)
    return [(int(part[i]), slice(i, j)) for i, j in zip(at, [*at[1:], len(part)][: len(at)], strict=True)]


def chunks_in(batches: Iterator[pa.RecordBatch], keep: Sequence[str], shards: int, heavy: np.ndarray) -> Iterator[tuple[int, list[pa.RecordBatch], Chunk]]:
    """The chunks of a task's texts: number, columns of ``keep``, and content. Only rows and their order decide."""
    number, hashes = TaskContext.get().partitionId() * TASK_CHUNKS, WordHashes()
    rows, texts, trains, size = [], [], [], 0
    for batch in batches:
        start, columns = 0, batch.select(list(keep))
        for i, (text, train) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_train").to_pylist(), strict=True)):
            texts.append(tokens_of(text, hashes))
            trains.append(bool(train))
            size += len(texts[-1])
            if size >= CHUNK:
                rows.append(columns.slice(start, i + 1 - start))
                yield number, rows, chunk_of(texts, trains, shards, heavy)
                rows, texts, trains, size, start, number = [], [], [], 0, i + 1, number + 1
        if start < batch.num_rows:
            rows.append(columns.slice(start))
    if texts:
        yield number, rows, chunk_of(texts, trains, shards, heavy)


def heavy_words(docs: DataFrame, shards: int) -> np.ndarray:
    """Sorted hashes of words that are too frequent for one shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for text in batch.column("_text").to_pylist():
                word, n = np.unique(tokens_of(text, hashes)[:-1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    counts = settled(docs.select("_text").limit(HEAVY_ROWS).mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.col("n") * HEAVY_ONE_IN * shards > whole).orderBy(F.desc("n"), "word").limit(HEAVY_WORDS).toArrow()
    return np.sort(rows["word"].to_numpy().astype(np.int64).view(U))


def asked(docs: DataFrame, shards: int, heavy: np.ndarray) -> DataFrame:
    """Packed bigrams and words of each chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, chunk in chunks_in(batches, (), shards, heavy):
            rows = []
            for shard, own in chunk.pair_slices:
                before, word, count = chunk.before[own], chunk.word[own], chunk.count[own]
                at = runs(before)
                keys = np.int64(len(at)).tobytes() + before[at].tobytes() + np.diff(np.r_[at, len(before)]).astype(np.uint32).tobytes() + word.tobytes()
                rows.append((PAIRS, shard, number, keys, bytes_of(count), None))
            rows += [(WORDS, shard, number, chunk.names[own].tobytes(), None, None) for shard, own in chunk.name_slices]
            del chunk
            yield sent(rows)

    return docs.mapInArrow(work, SENT_SQL)


@lru_cache(maxsize=8)
def opened(base: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(base) if urlsplit(base).scheme else (pyarrow.fs.LocalFileSystem(), base)


def saved(base: str, name: str, parts: Sequence[np.ndarray | bytes]) -> None:
    """Writes parts one after another. Every attempt writes the same, under a name of its own until it is whole."""
    files, root = opened(base)
    files.create_dir(root, recursive=True)
    own = posixpath.join(root, f"{name}-{uuid.uuid4().hex}")
    with files.open_output_stream(own) as out:
        for p in parts:
            out.write(p if isinstance(p, bytes) else np.ascontiguousarray(p).data.cast("B") if p.size else b"")
    files.move(own, posixpath.join(root, name))


def mapped(base: str, name: str) -> np.ndarray:
    """A file mapped into memory. From storage that is no folder it is fetched first, to a file without a name."""
    files, root = opened(base)
    path = posixpath.join(root, name)
    if isinstance(files, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
    with tempfile.NamedTemporaryFile() as own, files.open_input_stream(path) as source:
        while part := source.read(1 << 20):
            own.write(part)
        own.flush()
        return np.memmap(own.name, np.uint8, "r") if os.path.getsize(own.name) else np.empty(0, np.uint8)


def dropped(base: str, name: str) -> None:
    """Deletes a file, which stays readable where it is mapped; another attempt may have done so."""
    files, root = opened(base)
    with contextlib.suppress(FileNotFoundError):
        files.delete_file(posixpath.join(root, name))


def cut(raw: np.ndarray, *parts: tuple[type, int]) -> list[np.ndarray]:
    found, at = [], 0
    for kind, n in parts:
        size = np.dtype(kind).itemsize * n
        found.append(raw[at : at + size].view(kind))
        at += size
    return found


def pairs_in(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    befores, times = np.frombuffer(raw, U, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
    return np.repeat(befores, times), np.frombuffer(raw, U, -1, 8 + 12 * n)


def found_in(keys: np.ndarray, needles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of needles among sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(needles), np.int64), np.zeros(len(needles), bool)
    place = np.minimum(np.searchsorted(keys, needles), len(keys) - 1)
    return place, keys[place] == needles


def pair_shard_work(base: str, shards: int, kept: bool) -> Callable[[pa.Table], pa.Table]:
    """Merges a shard's bigrams, writes them, answers the chunks, and passes on what it knows of words."""

    def work(group: pa.Table) -> pa.Table:
        if group["kind"][0].as_py() != PAIRS:
            return group.select(SENT.names)
        shard = group["to"][0].as_py()
        keys, befores, words, counts = [], [], [], []
        for raw, values in zip(group["keys"], group["values"], strict=True):
            before, word = pairs_in(raw.as_py())
            count = counts_in(values.as_py())
            learned = count > 0  # others only ask
            befores.append(before[learned])
            words.append(word[learned])
            counts.append(count[learned])
        before, word, count = map(np.concatenate, (befores, words, counts))
        del befores, words, counts
        key = pair_hash(before, word)
        order = np.argsort(key)
        at = runs(key[order])
        total = np.add.reduceat(count[order], at) if len(at) else count
        key, before, word = key[order[at]], before[order[at]], word[order[at]]
        del order
        large = np.flatnonzero(total >= ESCAPE)
        saved(base, f"pairs-{shard}", [key, large.astype(np.int64), total[large], np.minimum(total, ESCAPE).astype(np.uint8)])
        keys, large, values, small = cut(mapped(base, f"pairs-{shard}"), (U, len(key)), (np.int64, len(large)), (np.int64, len(large)), (np.uint8, len(key)))
        del key
        rows = [(PAIR_FACTS, shard, None, None, None, [int((total == j).sum()) for j in (1, 2, 3, 4)])]
        for raw, chunk in zip(group["keys"], group["source"], strict=True):
            place, hit = found_in(keys, pair_hash(*pairs_in(raw.as_py())))
            answer = np.where(hit, small[place], 0).astype(np.int64) if len(keys) else np.zeros(len(place), np.int64)
            if (many := answer == ESCAPE).any():
                answer[many] = values[np.searchsorted(large, place[many])]
            rows.append((PAIR_ANSWERS, chunk.as_py(), shard, None, bytes_of(answer), None))
        if not kept:  # all that is asked of the shard is answered
            dropped(base, f"pairs-{shard}")
        names, *stats = summed(word, total, np.ones(len(word), np.int64))
        rows += knowledge(SEEN, names, stats, shards)
        names, *stats = summed(before, *[(total == 1).astype(np.int64), (total == 2).astype(np.int64), (total >= 3).astype(np.int64)])
        rows += knowledge(FOLLOWED, names, stats, shards)
        return pa.Table.from_batches([sent(rows)])

    return work


def knowledge(kind: int, names: np.ndarray, stats: list[np.ndarray], shards: int) -> list[tuple]:
    rows, stats = [], np.stack(stats)
    for to, own in split(word_shard(names, shards), shards):
        values = stats[:, own]
        rows.append((kind, to, None, names[own].tobytes(), values.astype(np.int64 if values.max() >= 2**31 else np.int32).tobytes(), None))
    return rows


#: What word shards know of a word: count, predecessors, followers seen once, twice, and more often.
STATS = {SEEN: (0, 1), FOLLOWED: (2, 3, 4)}


def word_shard_work(base: str, kept: bool) -> Callable[[pa.Table], pa.Table]:
    """Merges a shard's words, writes them and answers the chunks. Answers of the other shards, that are to one chunk,
    become its file; sums pass through."""

    def work(group: pa.Table) -> pa.Table:
        kind = group["kind"][0].as_py()
        if kind == PAIR_ANSWERS:
            return answered(base, "p", group)
        if kind == PAIR_FACTS:
            return group.select(SENT.names)
        shard = group["to"][0].as_py()
        keys, values = [np.empty(0, U)], [np.empty((5, 0), np.int64)]
        for kind, raw, packed in zip(group["kind"].to_pylist(), group["keys"], group["values"], strict=True):
            if kind in STATS:
                keys.append(np.frombuffer(raw.as_py(), U))
                n, width = len(keys[-1]), len(STATS[kind])
                values.append(np.zeros((5, n), np.int64))
                values[-1][STATS[kind], :] = np.frombuffer(packed.as_py(), np.int32 if len(packed.as_py()) == 4 * n * width else np.int64).reshape(width, n)
        key, *stats = summed(np.concatenate(keys), *np.concatenate(values, axis=1))
        del keys, values
        count, predecessors = stats[:2]
        facts = [int(count.sum()), int((count > 0).sum()), int(predecessors.sum()), *[int((predecessors == j).sum()) for j in (1, 2, 3, 4)], 0]
        saved(base, f"words-{shard}", [key, *stats])
        own, *stats = cut(mapped(base, f"words-{shard}"), (U, len(key)), *[(np.int64, len(key))] * 5)
        place, hit = found_in(own, np.array([END]))
        facts[-1] = int(stats[0][place[0]]) if hit[0] else 0  # each text that was learned has one end
        rows = [(WORD_FACTS, shard, None, None, None, facts)]
        for kind, raw, chunk in zip(group["kind"].to_pylist(), group["keys"], group["source"], strict=True):
            if kind == WORDS:
                place, hit = found_in(own, np.frombuffer(raw.as_py(), U))
                answer = [np.where(hit, s[place], 0) if len(own) else np.zeros(len(place), np.int64) for s in stats]
                packed = list(map(bytes_of, answer))
                rows.append((WORD_ANSWERS, chunk.as_py(), shard, None, np.array([len(x) for x in packed], np.int64).tobytes() + b"".join(packed), None))
        if not kept:
            dropped(base, f"words-{shard}")
        return pa.Table.from_batches([sent(rows)])

    return work


def answered(base: str, label: str, group: pa.Table) -> pa.Table:
    """Writes the answers to a chunk, in the order of the shards that they are from."""
    chunk, order = group["to"][0].as_py(), np.argsort(group["source"].to_numpy())
    answers = [group["values"][int(i)].as_py() for i in order]
    saved(base, f"{label}-{chunk}", [np.array([len(answers), *map(len, answers)], np.int64), *answers])
    return pa.Table.from_batches([sent([(DONE, chunk, None, None, None, None)])])


def answers_in(base: str, label: str, chunk: int) -> list[bytes]:
    raw = mapped(base, f"{label}-{chunk}")
    n = int(raw[:8].view(np.int64)[0])
    ends = np.cumsum(raw[8 : 8 + 8 * n].view(np.int64)) + 8 * (n + 1)
    return [raw[i:j].tobytes() for i, j in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def answers_work(base: str) -> Callable[[pa.Table], pa.Table]:
    def work(group: pa.Table) -> pa.Table:
        return answered(base, "w", group) if group["kind"][0].as_py() == WORD_ANSWERS else group.select(SENT.names)

    return work


@dataclass
class Numbers:
    """The global numbers of the model."""

    tokens: int
    vocabulary: int
    types: int
    starts: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_backoff: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The modified discounts from counts of counts 1 to 4; where these are too few to tell, 0.5, 1 and 1.5."""
    if not all(n):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.0), float(j)) for j in (1, 2, 3))


def numbers_of(pair_facts: list[int], word_facts: list[int]) -> Numbers:
    tokens, vocabulary, types, *n, starts = word_facts
    three = discounts(n)
    spare = three[0] * n[0] + three[1] * n[1] + three[2] * (vocabulary - n[0] - n[1])
    return Numbers(tokens, vocabulary, types, starts, discounts(pair_facts), three, spare / types if types else 1.0)


def answered_chunks(docs: DataFrame, shards: int, heavy: np.ndarray, kept: bool) -> tuple[str, Numbers]:
    """Counts the training rows and answers every chunk; returns the folder of the files and the global numbers."""
    spark = docs.sparkSession
    base = fresh_path(spark, "kneser-ney")
    whole = lambda kind: F.when(F.col("kind").isin(SEEN, FOLLOWED), F.lit(WORDS)).otherwise(F.col(kind))
    pairs = asked(docs, shards, heavy).groupBy("kind", "to").applyInArrow(pair_shard_work(base, shards, kept), SENT_SQL)
    words = pairs.withColumn("goes", whole("kind")).groupBy("goes", "to").applyInArrow(lambda g: word_shard_work(base, kept)(g.drop_columns(["goes"])), SENT_SQL)
    done = words.groupBy("kind", "to").applyInArrow(answers_work(base), SENT_SQL)
    # Written once, and with it the files; each is named by what it holds, so repeated attempts change nothing.
    listed = stored(done.select("kind", "facts"), "kneser-ney-facts")
    sums = {r["kind"]: [r[f"f{i}"] for i in range(8)] for r in listed.where("facts is not null").groupBy("kind").agg(*[F.sum(F.get("facts", F.lit(i))).alias(f"f{i}") for i in range(8)]).collect()}
    removed(listed)
    return base, numbers_of(sums.get(PAIR_FACTS, [0] * 8)[:4], sums.get(WORD_FACTS, [0] * 8))


def scores_of(chunk: Chunk, m: Numbers, pair: np.ndarray, stats: np.ndarray) -> list[np.ndarray]:
    """Of each text of a chunk its tokens, known tokens, base score and score. pair: counts of the chunk's bigrams;
    stats: rows as in STATS, a column for each of the chunk's words."""
    if len(pair) != len(chunk.before) or stats.shape[1] != len(chunk.names):
        raise ValueError("the table gave other rows, or in another order, when it was read again")
    order = np.argsort(chunk.names)
    count, predecessors, once, twice, more = stats[:, order]
    names = chunk.names[order]
    of_before, of_word = np.searchsorted(names, chunk.before), np.searchsorted(names, chunk.word)
    d = np.array([0.0, *m.pair_discounts])
    e = np.array([0.0, *m.word_discounts])
    uniform = 1 / (m.vocabulary + 1)
    lower = (predecessors - e[np.minimum(predecessors, 3)]) / m.types + m.word_backoff * uniform if m.types else np.full(len(names), uniform)
    weight = d[1] * once + d[2] * twice + d[3] * more
    # A start is never predicted and so has no count of its own: it precedes one token of each text.
    total = np.maximum(np.where(names == START, m.starts, count), 1)
    seen = (once + twice + more)[of_before] > 0
    p = np.where(seen, (pair - d[np.minimum(pair, 3)] + weight[of_before] * lower[of_word]) / total[of_before], lower[of_word])
    base = np.log10((count[of_word] + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
    starts = np.r_[0, np.cumsum(chunk.lengths)[:-1]]
    per_token = ((count[of_word] > 0).astype(np.int64), base, np.log10(p))
    return [chunk.lengths, *[np.add.reduceat(x[chunk.pair_at], starts) for x in per_token]]


def scored(docs: DataFrame, train: Column, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", shards: int | None = None, keep_model: bool = False) -> DataFrame:
    """The columns of ``keep``, then n_tokens, n_known, train_tokens, base_score, score and perplexity of each row of
    ``docs``, by the model of those rows for which ``train`` is true. keep_model leaves the shards' files in their folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    if not shards:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
        shards = max(8, shuffle_partitions(spark), math.ceil(size / SHARD_BYTES))
    rows = docs.select(*keep, docs[text_col].alias("_text"), train.alias("_train"))
    heavy = heavy_words(rows, shards)
    base, numbers = answered_chunks(rows, shards, heavy, keep_model)
    named = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, kept, chunk in chunks_in(batches, keep, shards, heavy):
            pair = np.concatenate([counts_in(raw) for raw in answers_in(base, "p", number)])
            parts = []
            for raw in answers_in(base, "w", number):
                ends = np.cumsum(np.frombuffer(raw, np.int64, 5)) + 40
                parts.append(np.stack([counts_in(raw[i:j]) for i, j in zip([40, *ends[:-1]], ends, strict=True)]))
            n, known, base_score, score = scores_of(chunk, numbers, pair, np.concatenate(parts, axis=1))
            own = pa.Table.from_batches(kept) if keep else None
            columns = [pa.array(n), pa.array(known), pa.array(np.full(len(n), numbers.tokens)), pa.array(base_score), pa.array(score), pa.array(10.0 ** np.minimum(-score / n, 300))]
            yield from pa.table([*[own[c] for c in keep], *columns], names=[*keep, *named]).to_batches()

    return rows.mapInArrow(work, f"{kinds}n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
