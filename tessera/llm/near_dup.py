"""Near-duplicate classes by MinHash bands, odd sketches and exact confirmation.

A document's set holds its distinct word shingles. Equal sets collapse into one class first. Each class has
BANDS * ROWS MinHash samples: bands of them give candidate buckets, and all of them are folded into a parity
bitmap, the odd sketch, whose XOR population count estimates high similarities. Only pairs that pass the sketch
and a bound on sizes are confirmed, on full sets of 64-bit shingle hashes.

A bucket never emits all its pairs. In HUB_ROUNDS rounds each member meets the bucket's hub, a member of another
component that shares most buckets with others; each round is linear in the members. What is left are buckets whose
members still lie in several components. Their members are compared across components in blocks of bounded size, first
by sketches alone: a block takes the pairs that pass for links and emits no more of them than would join its
components; these are confirmed on full sets. Only buckets in which one of them fails are compared once more, in
blocks that hold the full sets and confirm what passes, until their components are joined. Every link of a bucket is
thus confirmed or implied by confirmed ones. A pair at the threshold
of 0.8 misses all buckets with probability (1 - 0.8^4)^32 < 1e-7.

Null, empty and blank texts have no shingles and link with nothing. Rows with a null id take no part: they get no
component and are kept. Repeated rows are copies of one another with the same id, so all of them are kept or
none; ids repeated with other texts are judged by their own text. No rows give no rows. Surplus columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, removed, stored
from tessera.llm.components import components

#: Words of a shingle where the caller names no other number.
SHINGLE = 5
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Pairs are confirmed if the sketch puts them at PERCENT less this margin, five standard deviations of the estimate.
MARGIN = 20
#: Bits of the parity bitmap of a whole set, whose XOR counts the shingles in which two sets differ.
WHOLE_BITS = 2048
#: Rounds in which the members of a bucket meet a hub.
HUB_ROUNDS = 2
#: Members of a bucket that one side of a block holds, some 340 bytes each; and shingles, where it holds full sets.
BLOCK_MEMBERS, BLOCK_SHINGLES = 20_000, 1_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000

U = np.uint64
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 2**64, BANDS * ROWS, dtype=U) | U(1)
_ADD = _rng.integers(0, 2**64, BANDS * ROWS, dtype=U)
_ROW_MIX = _rng.integers(0, 2**64, ROWS, dtype=U) | U(1)
_BAND_SALT = _rng.integers(0, 2**64, BANDS, dtype=U)
_BIT_SALT = _rng.integers(0, 2**64, BANDS * ROWS, dtype=U)
_STEP = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: a bijection whose bits all depend on one another."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles_of(text: str | None, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; bytes.lower() and bytes.split() know ASCII only, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U)
    each = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    k_here = min(k, len(each))
    rolled = np.full(len(each) - k_here + 1, k_here, U)
    for i in range(k_here):
        rolled = mixed(rolled * _STEP + each[i : len(each) - k_here + 1 + i])
    return np.unique(rolled)


def samples_of(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(U).max, U)
    for start in range(0, len(shingles), 512):
        part = np.multiply.outer(_MULTIPLY, shingles[start : start + 512])
        part += _ADD[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes, and the odd sketch: one bit for each sample is flipped in a bitmap."""
    least = samples_of(shingles)
    bands = mixed((least.reshape(BANDS, ROWS) * _ROW_MIX).sum(axis=1, dtype=U) ^ _BAND_SALT)
    at = mixed(least ^ _BIT_SALT) % U(SKETCH_BITS)
    odd = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return bands, np.packbits(odd).view(U)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The odd sketch of the whole set: each shingle flips a bit."""
    odd = np.bincount((shingles % U(WHOLE_BITS)).astype(np.int64), minlength=WHOLE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def most_whole_flips(sizes: np.ndarray) -> np.ndarray:
    """Most XOR bits of two whole-set bitmaps whose sets are similar enough, by the sum of their sizes. Differing
    shingles flip a bit each, so their number is a bound; six deviations above the expected bits is the other."""
    differing = np.floor(sizes * (100 - PERCENT) / (100 + PERCENT))
    kept = (1 - 2 / WHOLE_BITS) ** differing
    return np.minimum(differing, np.ceil(WHOLE_BITS / 2 * (1 - kept) + 3 * np.sqrt(WHOLE_BITS * (1 - kept * kept)) + 1))


def most_flips(percent: int = PERCENT - MARGIN) -> int:
    """XOR population count that a pair of this similarity is expected to have: a pair with more is no candidate."""
    differing = BANDS * ROWS * (1 - percent / 100)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing)))


def estimated(flips: float) -> float:
    """Similarity that an XOR population count of two odd sketches stands for."""
    inside = max(1 - 2 * flips / SKETCH_BITS, 1e-9)
    return max(0.0, 1 + SKETCH_BITS / (4 * BANDS * ROWS) * float(np.log(inside)))


def class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signed(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, cls, bands, sketch, whole) of each row and the columns of ``keep``; all from cls to whole are
    null without shingles."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_shingles", "cls", "bands", "sketch", "whole", *keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, classes, bands, sketches, wholes = [], [], [], [], []
            for text in batch.column("_text").to_pylist():
                found = shingles_of(text, hashes, shingle)
                sizes.append(len(found))
                classes.append(class_of(found) if len(found) else None)
                own = signature(found) if len(found) else (None, None)
                bands.append(None if own[0] is None else own[0].view(np.int64))
                sketches.append(None if own[1] is None else own[1].view(np.int64))
                wholes.append(parity(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(wholes, pa.list_(pa.int64())), *[batch.column(c) for c in keep]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep).mapInArrow(work, f"doc_id {kind}, n_shingles long, cls binary, bands array<long>, sketch array<long>, whole array<long>{kept}")


def full_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles) of each row with shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [s for t in batch.column("_text").to_pylist() if len(s := shingles_of(t, hashes, shingle))]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["cls", "shingles"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(work, "cls binary, shingles array<long>")


def shared_size(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def across(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs between the components of a block, no more than join them. They meet the bound on sizes and both sketches;
    where the block holds sets they are confirmed on them, else each that passes is taken for a link."""
    side, size, names = (group[c].to_numpy() for c in ("side", "n_shingles", "cls"))
    sets = group["shingles"].to_numpy() if "shingles" in group else None
    code = pd.factorize(group["comp"])[0]
    root = np.arange(code.max() + 1)  # of each component; all are kept flat
    sketch = np.stack(group["sketch"].to_numpy()).view(U)
    whole = np.stack(group["whole"].to_numpy()).view(U)
    most, mirrored = most_flips(), side.max() != side.min()
    a, b = [], []
    for i in range(len(group)):
        rest = slice(i + 1, None)
        ok = (root[code[rest]] != root[code[i]]) & (100 * np.minimum(size[rest], size[i]) >= PERCENT * np.maximum(size[rest], size[i]))
        if mirrored:  # two blocks meet: pairs inside one block are the task of its own
            ok &= side[rest] != side[i]
        at = np.flatnonzero(ok) + i + 1
        if len(at):
            at = at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1) <= most]
        if len(at):
            at = at[np.bitwise_count(whole[at] ^ whole[i]).sum(axis=1) <= most_whole_flips(size[at] + size[i])]
        for j in at:
            one, other = root[code[i]], root[code[j]]
            if one == other:
                continue
            if sets is not None:
                both = shared_size(sets[i], sets[j])
                if 100 * both < PERCENT * (size[i] + size[j] - both):
                    continue
            root[root == other] = one
            a.append(i)
            b.append(j)
    return pd.DataFrame({"band": group["band"].to_numpy()[a], "a": names[a], "b": names[b]}, columns=["band", "a", "b"])


def compared(placed: DataFrame, brief: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """(band, a, b): pairs of across(), of buckets (band, cls, comp) whose members lie in several components."""
    rows = stored(placed.join(brief.select("cls", "n_shingles"), "cls"), "sized")
    load = F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES) if sets is not None else F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS)
    split = rows.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), load.cast("int").alias("blocks")).where("low != high")
    rest = rows.join(stored(split.select("band", "blocks"), "split"), "band").withColumn("side", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rest = rest.drop("n_shingles").join(brief, "cls")
    if sets is not None:
        rest = rest.join(sets, "cls")
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["side", "cls", "comp", "n_shingles", "sketch", "whole", *(["shingles"] if sets is not None else [])]
    rest = rest.select("band", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), *columns)
    return rest.groupBy("band", "low", "high").applyInPandas(across, "band long, a binary, b binary")


def close(pairs: DataFrame, brief: DataFrame) -> DataFrame:
    """Pairs that meet the bound on sizes and the odd sketches."""
    left = brief.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("ka"))
    right = brief.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("kb"))
    flips = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return stored(both.where(flips <= most_flips()).select("a", "b"), "close")


def unioned(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = two.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return shared.where(100 * F.col("i") >= PERCENT * (F.col("n") - F.col("i"))).select("a", "b")


def linked(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row, and the columns of ``keep``, which tell apart rows that share
    an id."""
    signs = stored(signed(docs, shingle, id_col, text_col, keep), "signs")
    classes = signs.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("whole").alias("whole"))
    classes = stored(classes, "classes")
    # What a hot bucket meets in a join is a table and no aggregate, so that Spark can split the bucket.
    slots = classes.select("cls", F.explode("bands").alias("band"))
    full = stored(slots.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    members = slots.join(full, "band")
    members = stored(members, "members")
    # A class's weight as a hub: how many members its buckets hold.
    shared = stored(members.groupBy("cls").agg(F.sum("members").alias("shared")), "shared")
    brief = classes.select("cls", "n_shingles", "sketch", "whole")
    sets = stored(full_sets(docs.join(shared.join(classes, "cls").select(F.col("first_doc").alias(id_col)), id_col, "left_semi"), shingle, id_col, text_col).dropDuplicates(["cls"]), "sets")

    links, labels = [], None
    # In the first round each class is a component of its own, and the heaviest member is the hub.
    placed = members.select("band", "cls", F.col("cls").alias("comp"), F.lit(False).alias("met"))
    for _ in range(HUB_ROUNDS):
        weight = F.struct(~F.col("met"), F.col("shared"), F.col("cls"), F.col("comp"))
        hubs = stored(placed.join(shared, "cls").groupBy("band").agg(F.max(weight).alias("hub")).select("band", F.col("hub.cls").alias("hub"), F.col("hub.comp").alias("hub_comp")), "hubs")
        to_hub = placed.join(hubs, "band").where("comp != hub_comp").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        links.append(stored(confirmed(close(to_hub, brief), sets), "links"))
        labels = components(unioned(links)).select(F.col("node").alias("cls"), F.col("label").alias("comp"))
        # Only buckets of more members than the hub's component has go on, with the hub's component marked as met.
        known = members.where("members > 2").select("band", "cls").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        of_hub = hubs.join(labels.withColumnRenamed("cls", "hub"), "hub", "left").select("band", F.coalesce("comp", "hub").alias("hub_comp"))
        known = stored(known.join(of_hub, "band").select("band", "cls", "comp", (F.col("comp") == F.col("hub_comp")).alias("met")), "known")
        split = stored(known.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("band"), "split")
        placed = stored(known.join(split, "band"), "placed")

    seen = stored(compared(placed.select("band", "cls", "comp"), brief), "seen")
    pairs = stored(seen.select("a", "b").distinct(), "pairs")
    links.append(stored(confirmed(pairs, sets), "links"))
    failed = seen.join(links[-1], ["a", "b"], "left_anti").select("band").distinct()
    failed = stored(failed, "failed")
    if not failed.isEmpty():
        labels = components(unioned(links)).select(F.col("node").alias("cls"), F.col("label").alias("comp"))
        again = placed.select("band", "cls").join(failed, "band", "left_semi").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        links.append(stored(compared(again, brief, sets).select("a", "b").distinct(), "links"))
    labels = components(unioned(links)).select(F.col("node").alias("cls"), "label")
    removed(full, members, shared, sets, placed, seen, pairs, failed, *links)  # the labels are checkpointed
    homes = classes.select("cls", "first_doc").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    lowest = homes.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    homes = homes.join(lowest, "label").select("cls", "component_id")
    found = signs.select("doc_id", "n_shingles", "cls", *keep).join(homes, "cls", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), *keep).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
