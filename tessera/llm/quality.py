"""Quality rules and an isolation forest on their statistics.

Each document gets counts by fixed rules. An isolation forest over ratios of these counts gives an anomaly score
from the mean path length; the threshold comes from all labelled rows. A document is kept if the base rule
passes and its score stays below the threshold.

Null and empty texts have counts of 0 and fail the base rule. Rows are independent, so repeated rows and null ids
give repeated results. Labels of unknown documents, null labels and repeated labels are no harm: null ones are
ignored, repeated ones count again. Without labelled rows of both qualities the forest rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, stored, with_text

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "marks", "capitals", "duplicate_lines", "repeats", "stutters", "word_length")
#: The forest is fitted on at most so many labelled rows that pass the base rule, the first by a hash of their ids.
FIT_ROWS = 16_384
#: Of the labelled poor rows one in so many may enter the fit: anomalies must be rare there to have short paths.
POOR_ONE_IN = 8
TREES, TREE_ROWS, DEPTH = 200, 256, 8
#: Share of labelled good rows that calibration may reject.
GOOD_LOSS = 0.005
SEED = 20_240_101
_UPPER = bytes(range(65, 91))
_LETTER_LIKE = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_NOT = lambda kept: bytes(b for b in range(256) if b not in kept)
_NOT_UPPER, _NOT_LETTER, _NOT_MARK = _NOT(_UPPER), _NOT(_LETTER_LIKE), bytes([*_LETTER_LIKE, *BLANKS.encode(), *b".,"])


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in windows of WINDOW words that occur twice or more in the text, and words equal to the one before
    them; exact, without hashing."""
    ids: dict[bytes, int] = {}
    each = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int64, len(words))
    n = len(words) - WINDOW + 1
    if len(ids) == len(words):
        return 0, 0
    stutters = int((each[1:] == each[:-1]).sum())
    if n < 2:
        return 0, stutters
    key, width = each[:n], len(ids)
    for k in range(1, WINDOW):
        if width > (1 << 62) // len(ids):  # renumber before the product overflows
            key = np.unique(key, return_inverse=True)[1]
            width = int(key.max()) + 1
        key, width = key * len(ids) + each[k : k + n], width * len(ids)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0, stutters
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum()), stutters


def counts_of(text: str | None) -> tuple[int, ...]:
    """The base counts, in the order of COUNTS, then stutters, capitals, letters, other marks and lines with words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        *repeat_words(words),
        len(raw.translate(None, _NOT_UPPER)),
        len(raw.translate(None, _NOT_LETTER)),
        len(raw.translate(None, _NOT_MARK)),
        len(lines),
    )


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def features_of(counts: np.ndarray) -> np.ndarray:
    words, chars, symbols, dup, repeat, stutter, upper, letters, marks, lines = counts.T.astype(np.float64)
    some = np.maximum
    # Square roots spread small ratios, where most documents lie; lengths of words are damped alike.
    return np.sqrt(np.stack([symbols / some(chars, 1), marks / some(chars, 1), upper / some(letters, 1), dup / some(lines, 1), repeat / some(words, 1), stutter / some(words, 1), np.minimum(chars / some(words, 1), 60) / 60], axis=1))


@dataclass
class Forest:
    """Trees as arrays: at each node the split's feature and value, or -1 and the path length of a leaf."""

    feature: np.ndarray
    value: np.ndarray
    norm: float
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, value in zip(self.feature, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                split = feature[at]
                right = x[np.arange(len(x)), np.maximum(split, 0)] >= value[at]
                at = np.where(split < 0, at, 2 * at + 1 + right)
            total += value[at]
        return 2.0 ** (-total / (len(self.feature) * self.norm)) if len(self.feature) else total


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown(x: np.ndarray) -> Forest:
    rng = np.random.default_rng(SEED)
    nodes = 2 ** (DEPTH + 1) - 1
    feature, value = np.full((TREES, nodes), -1, np.int64), np.zeros((TREES, nodes))
    for t in range(TREES):
        stack = [(0, 0, rng.choice(len(x), min(TREE_ROWS, len(x)), replace=False))]
        while stack:
            node, depth, rows = stack.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_to = np.flatnonzero(high > low)
            if depth == DEPTH or len(rows) < 2 or not len(open_to):
                value[t, node] = depth + mean_path(len(rows))
                continue
            f = int(rng.choice(open_to))
            v = rng.uniform(low[f], high[f])
            right = x[rows, f] >= v
            feature[t, node], value[t, node] = f, v
            stack += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return Forest(feature, value, mean_path(min(TREE_ROWS, len(x))) or 1.0, math.inf)


def counted(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, the base counts, base_failed and the features of each row, written once: texts are read
    and counted no more than that."""
    bounded_batches(docs.sparkSession)
    kinds = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"{c} long" for c in COUNTS]])
    names = [*keep, *COUNTS, "base_failed", "features"]
    rows, name = with_text(docs, keep, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = np.array([counts_of(t) for t in batch.column(name).to_pylist()], np.int64)
            arrays = [*[batch.column(c) for c in keep], *[pa.array(counts[:, i]) for i in range(len(COUNTS))]]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(base_failed(counts)), pa.array(features_of(counts).tolist(), pa.list_(pa.float64()))], names=names)

    return stored(rows.mapInArrow(work, f"{kinds}, base_failed boolean, features array<double>"), "quality-counts")


def judged(stats: DataFrame, forest: Forest) -> DataFrame:
    """The rows of counted(), with anomaly and kept in place of the features."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)  # a fixed number of trees and nodes
    keep = [c for c in stats.columns if c != "features"]
    kinds = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                score = own.scores(matrix(batch.column("features")))
                passed = ~batch.column("base_failed").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score), pa.array(passed & (score < own.threshold))], names=[*keep, "anomaly", "kept"])

    return stats.mapInArrow(work, f"{kinds}, anomaly double, kept boolean")


def matrix(features: pa.Array) -> np.ndarray:
    return features.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fitted(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> Forest:
    """Grows the forest on a bounded sample of labelled rows and sets the threshold on all labelled rows; both among
    the rows of counted() that pass the base rule, as only those await a verdict."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).where("_id is not null and quality is not null")
    rows = stats.where("not base_failed").select(F.col(id_col).alias("_id"), "features").join(known, "_id")
    rows = stored(rows.select("_id", "quality", "features"), "quality-labelled")
    few = (F.col("quality") == 1) | (F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(POOR_ONE_IN)) == 0)
    sample = rows.where(few).orderBy(F.xxhash64("_id"), "_id", "features").limit(FIT_ROWS).select("features").toArrow()["features"].to_pylist()
    if not sample:
        return Forest(np.empty((0, 1), np.int64), np.empty((0, 1)), 1.0, math.inf)
    forest = grown(np.array(sample))
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = shared.value.scores(matrix(batch.column("features")))
                yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(np.floor(score * 2000).astype(np.int64))], names=["quality", "at"])

    cells = rows.select("quality", "features").mapInArrow(work, "quality int, at long").groupBy("quality", "at").count().collect()
    forest.threshold = calibrated([(r["at"] / 2000, r["quality"], r["count"]) for r in cells])
    return forest


def measured(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, the base counts, base_failed, anomaly and kept of each row. ``keep`` holds the id."""
    stats = counted(docs, keep, text_col)
    return judged(stats, fitted(stats, labels, id_col=id_col))


def calibrated(cells: list[tuple[float, int, int]], good_loss: float = GOOD_LOSS) -> float:
    """The score at or above which rows are rejected: the one that tells most poor rows from good ones, among those
    that reject no more than ``good_loss`` of the good."""
    good, poor = sum(n for _, q, n in cells if q == 1), sum(n for _, q, n in cells if q == 0)
    best, at = 0.0, math.inf
    if not good or not poor:
        return at
    lost = found = 0
    for score in sorted({s for s, _, _ in cells}, reverse=True):
        lost += sum(n for s, q, n in cells if s == score and q == 1)
        found += sum(n for s, q, n in cells if s == score and q == 0)
        if lost <= good_loss * good and (gain := found / poor - lost / good) > best:
            best, at = gain, score
    return at
