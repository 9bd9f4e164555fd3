"""Remembered facts: repeats, conflicts, merging, fingerprints.

Repeats and conflicts are a set-similarity join. Copies are one class. Bigrams are few and common, so that texts of a
language share their rarest ones, too: blocks of candidates meet blocks of memories of their group, a product of matrices
counts the bigrams that two texts share, and what it finds is compared exactly. Only the first finds are handed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.postings import coded
from tessera.sources.storage import bounded_batches, stored

# What negates a memory, and what doesn't count when two are compared.
NEGATIONS = ("不", "不要", "不能", "避免", "禁止", "不再", "无需", "别")
PUNCTUATION = r"[\s，。！？、；：,.!?;:'\"“”‘’（）()【】\[\]{}<>《》\-_/\\|`~]+"


def stripped(text: Column, most: int = 2000) -> Column:
    """A memory without blanks, punctuation and case, from its first so many characters."""
    clean = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, most)
    return F.regexp_replace(F.lower(clean), PUNCTUATION, "")


def plain(text: Column) -> Column:
    """A stripped memory without its negations."""
    return F.regexp_replace(text, "|".join(sorted(NEGATIONS, key=len, reverse=True)), "")


def bigrams(text: str) -> np.ndarray:
    """The distinct pairs of neighbouring characters as numbers, sorted; of one character, itself."""
    return np.unique(coded(text, min(len(text), 2) or 1))


GROUP = ["user_id", "type"]


#: Bigrams with a column of their own, and columns that all others share.
OWN, REST = 1536, 512
#: Candidates that are broadcast at a time, and texts of a block of them and of memories.
CANDIDATES, BLOCK, CHUNK = 10_000, 512, 1024


def classes_of(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts by the least id, (user_id, type, id, s, p), p being null where s has no negation, and the
    first ids of each, (id, member)."""
    own = rows.select(*GROUP, "id", stripped(F.col("content")).alias("s")).where("s <> ''")
    whole = Window.partitionBy(*GROUP, "s")
    first = own.withColumns({"nth": F.row_number().over(whole.orderBy("id")), "least": F.min("id").over(whole)}).where(F.col("nth") <= most)
    kept = stored(first, "memory-members")
    bare = plain(F.col("s"))
    one = kept.where("nth = 1").select(*GROUP, "id", "s", F.when(bare != F.col("s"), bare).alias("p"))
    return one, kept.select(F.col("least").alias("id"), F.col("id").alias("member"))


def blocked(rows: DataFrame, name: str, most: int) -> DataFrame:
    """(user_id, type, name: so many rows of a group, in the order of ids) of all classes. Rows are dealt by ranges of group
    and id, so a large group is in many blocks and tasks."""
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, told = 0, ("id", "s", "p")
            for key, run in groupby(zip(*(batch.column(c).to_pylist() for c in GROUP), strict=True)):
                end = at + len(list(run))
                for start in range(at, end, most):
                    some = batch.slice(start, min(most, end - start))
                    # A copy, as a slice would be sent with its whole batch.
                    one = pa.concat_arrays([pa.StructArray.from_arrays([some.column(c) for c in told], names=list(told))])
                    yield pa.RecordBatch.from_arrays([*[pa.array([k], batch.schema.field(c).type) for c, k in zip(GROUP, key, strict=True)], pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one)], names=[*GROUP, name])
                at = end

    bounded_batches(rows.sparkSession)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in GROUP)
    dealt = rows.repartitionByRange(parts, *GROUP, "id").sortWithinPartitions(*GROUP, "id")
    return dealt.mapInArrow(work, f"{kinds}, {name} array<struct<id: {rows.schema['id'].dataType.simpleString()}, s: string, p: string>>")


def frequent(rows: DataFrame) -> np.ndarray:
    """The bigrams that most of the texts have, sorted; so many at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bigrams(said) for said in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))], names=["gram"])

    counts = rows.select("s").mapInArrow(work, "gram long").groupBy("gram").count()
    return np.sort(counts.orderBy(F.desc("count"), "gram").limit(OWN).toArrow().column("gram").to_numpy())


class Texts:
    """Texts of a block with their bigrams as rows of a matrix: counts by column. A product of two rows is what both sets
    share where one has own columns only, and never less."""

    def __init__(self, texts: list[str], known: np.ndarray):
        self.texts, self.sets = texts, [bigrams(said) for said in texts]
        self.lengths = np.array([len(said) for said in texts], dtype=np.int64)
        self.sizes = np.array([len(g) for g in self.sets], dtype=np.int64)
        flat = np.concatenate([*self.sets, np.zeros(0, dtype=np.int64)])
        row, at = np.repeat(np.arange(len(texts)), self.sizes), np.searchsorted(known, flat)
        own = known[np.minimum(at, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), dtype=bool)
        column = np.where(own, at, OWN + (flat * 0x9E3779B1 >> 7) % REST)
        self.counts = np.bincount(row * (OWN + REST) + column, minlength=len(texts) * (OWN + REST)).reshape(-1, OWN + REST).astype(np.float32)
        self.exact = np.bincount(row[~own], minlength=len(texts)) == 0

    def some(self, at: np.ndarray) -> Texts:
        found = object.__new__(Texts)
        found.texts, found.sets = [self.texts[i] for i in at], [self.sets[i] for i in at]
        found.lengths, found.sizes, found.counts, found.exact = self.lengths[at], self.sizes[at], self.counts[at], self.exact[at]
        return found


def likeness(one: Texts, other: Texts, least: float, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair whether one text is in the other, if both have so many characters, and the share of their bigrams that
    both have; it is exact where it is at least so much, or one text may be in the other, and too high nowhere else."""
    both = (one.counts @ other.counts.T).astype(np.float64)
    size, smaller = one.sizes[:, None] + other.sizes[None, :], np.minimum(one.sizes[:, None], other.sizes[None, :])
    within = (np.minimum(one.lengths[:, None], other.lengths[None, :]) >= chars) & (both >= smaller)
    for i, j in zip(*np.nonzero(~(one.exact[:, None] | other.exact[None, :]) & (within | (both >= least / (1 + least) * size - 1e-3))), strict=True):
        both[i, j] = len(np.intersect1d(one.sets[i], other.sets[j], assume_unique=True))
    inside = np.zeros(both.shape, dtype=bool)
    for i, j in zip(*np.nonzero(within & (both >= smaller)), strict=True):
        a, b = one.texts[i], other.texts[j]
        inside[i, j] = a in b or b in a
    return inside, np.divide(both, size - both, out=np.zeros(both.shape), where=size > both)


def compared(new: DataFrame, old: DataFrame, least: float, conflict: float, chars: int, most: int) -> DataFrame:
    """(candidate, memory, kind, similarity) of classes of one group: of each block of memories the first so many that a
    candidate repeats or contradicts. Candidates are broadcast; if they are many, a block after the other."""
    known = frequent(new)
    blocks = max(-(-new.count() // CANDIDATES), 1)
    of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    chunks = blocked(old, "held", CHUNK)
    told = f"candidate {new.schema['id'].dataType.simpleString()}, memory {old.schema['id'].dataType.simpleString()}, kind string, similarity double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, dict] = {"asked": {}, "held": {}}

        def sides(name: str, keep: int, rows: pa.StructArray) -> tuple[Texts, Texts, np.ndarray]:
            """The texts, the texts without their negations, and which have any."""
            first, seen = rows.field("id")[0].as_py(), ready[name]
            if first not in seen:
                while len(seen) >= keep:
                    seen.pop(next(iter(seen)))
                bare = rows.field("p")
                turned = np.flatnonzero(bare.is_valid().to_numpy(zero_copy_only=False))
                seen[first] = Texts(rows.field("s").to_pylist(), known), Texts(bare.take(pa.array(turned)).to_pylist(), known), turned
            return seen[first]

        for batch in batches:
            for i in range(batch.num_rows):
                asked, held = (batch.column(c)[i].values for c in ("asked", "held"))
                (one, one_bare, one_turned), (other, other_bare, other_turned) = sides("asked", 8, asked), sides("held", 1, held)
                inside, similar = likeness(one, other, least, chars)
                repeat = inside | (similar >= least)
                kind, value = repeat.astype(np.int8), similar.copy()
                places: dict[str, list[int]] = {}
                for j, said in enumerate(other.texts):
                    places.setdefault(said, []).append(j)
                for a, said in enumerate(one.texts):
                    kind[a, places.get(said, [])], value[a, places.get(said, [])] = 1, 1.0
                without = [np.setdiff1d(np.arange(n), t) for n, t in ((len(one.texts), one_turned), (len(other.texts), other_turned))]
                for mine, at, theirs, to in ((one_bare, one_turned, other.some(without[1]), without[1]), (one.some(without[0]), without[0], other_bare, other_turned)):
                    if len(at) and len(to):
                        bare_inside, bare_similar = likeness(mine, theirs, conflict, chars)
                        part = np.ix_(at, to)
                        turned = (kind[part] == 0) & (bare_inside | (bare_similar >= conflict))
                        kind[part] = np.where(turned, 2, kind[part])
                        value[part] = np.where(turned, bare_similar, value[part])
                # Rows of a block are in the order of ids.
                row, column = np.nonzero((kind > 0) & (np.cumsum(kind > 0, axis=1) <= most))
                names = pa.array(["possible_duplicate", "possible_conflict"]).take(pa.array(kind[row, column] - 1))
                yield pa.RecordBatch.from_arrays([asked.field("id").take(pa.array(row)), held.field("id").take(pa.array(column)), names, pa.array(value[row, column])], names=["candidate", "memory", "kind", "similarity"])

    each = [chunks.join(F.broadcast(blocked(new.where(of == b), "asked", BLOCK)), GROUP).mapInArrow(work, told) for b in range(blocks)]
    return reduce(DataFrame.unionByName, each)


def candidate_pairs(new: DataFrame, old: DataFrame, least: float, conflict: float, chars: int) -> DataFrame:
    """Pairs of classes of which one repeats or contradicts the other, each once and without a limit."""
    return compared(new, old, least, conflict, chars, 2**31).select("candidate", "memory")


def repeats(candidates: DataFrame, memories: DataFrame, least: float = 0.82, conflict: float = 0.68, chars: int = 8, most: int = 5) -> DataFrame:
    """What new memories repeat, or contradict, among a user's others of a type.

    A duplicate is equal, contains the other or is contained, or is alike in bigrams. Of the others, one is a conflict
    if just one of both has a negation and they are alike, or contained, without it. The first few of each candidate
    are told. Ids are unique; memories that nothing is left of when they are stripped take no part.
    """
    old, members = classes_of(memories, most + 1)  # a candidate may be among them
    new, _ = classes_of(candidates, 1)
    own = candidates.select(*GROUP, "id", stripped(F.col("content")).alias("s")).where("s <> ''")
    asked = own.join(new.select(*GROUP, "s", F.col("id").alias("candidate")), [*GROUP, "s"]).select("candidate", F.col("id").alias("asking"))
    # The first members that are told are of the first classes, of which one may be the candidate's own.
    found = stored(compared(new, old, least, conflict, chars, most + 1), "memory-compared").withColumn("similarity", F.round("similarity", 4))
    # Each class stands for its first members, and as many are told of a candidate at most.
    each = found.join(members.withColumnRenamed("id", "memory"), "memory").join(asked, "candidate").where("member <> asking")
    nth = F.row_number().over(Window.partitionBy("asking").orderBy("member"))
    return each.withColumn("_n", nth).where(F.col("_n") <= most).select(F.col("asking").alias("candidate"), F.col("member").alias("memory"), "kind", "similarity")


def merged(memories: DataFrame, chars: int = 2000) -> DataFrame:
    """A user's memories of a type as one: parts unique without regard to case, in order, cut; greatest confidence.

    Each part but the first adds two characters or more, one may be null and add none: so many parts fill the text, and
    no more of them are brought together, however many a user has."""
    seen = F.row_number().over(Window.partitionBy(*GROUP, F.lower("content")).orderBy("id"))
    parts = memories.withColumn("n", seen).where("n = 1").withColumn("nth", F.row_number().over(Window.partitionBy(*GROUP).orderBy("id"))).where(F.col("nth") <= chars + 1)
    texts = parts.groupBy(*GROUP).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "content"))), lambda x: x["content"]), "; "), 1, chars).alias("content"))
    sure = memories.groupBy(*GROUP).agg(F.max("confidence").alias("confidence"))
    same = F.col("t.user_id").eqNullSafe(F.col("c.user_id")) & F.col("t.type").eqNullSafe(F.col("c.type"))
    return texts.alias("t").join(sure.alias("c"), same).select("t.user_id", "t.type", "content", "confidence")


def fingerprint(columns: dict[str, Column]) -> Column:
    """SHA-256 of canonical JSON: sorted keys, no blanks, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(columns.items())]), {"ignoreNullFields": "false"}), 256)


def live_mirrors(mirrors: DataFrame, sources: DataFrame) -> DataFrame:
    """Mirrors whose hash is still that of their source; others never pair an old vector with a new text (P10)."""
    now = sources.select("id", F.col("content_hash").alias("now"))
    return mirrors.join(now, "id", "left").select("id", F.coalesce(F.col("content_hash") == F.col("now"), F.lit(False)).alias("live"))
