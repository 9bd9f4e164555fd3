"""Hard negatives by a multiway hyperplane tree of split points, exact at its leaves.

A node of the tree has split points; a row goes down to the nearest of them. With each split point its node stores the
range of distances from it to the rows below each of the siblings, taken over all rows, not only those the tree was grown
from. A search asks for scores in a window. As the squared distance is the sum of both norms' squares minus twice the
score, a window is an annulus of distances around the anchor for rows of a known range of norms. By the triangle
inequality a sibling whose range from a split point cannot meet the annulus is passed over; what remains at the leaves is
scored in full.

Split points are grown on the driver from at most SAMPLE rows, those with the least hashes, so the tree is of bounded size
and is sent along with the tasks. Leaves are stored as blocks of at most BLOCK rows, so that no leaf is a task; anchors are
sent in blocks to the leaves that they need and meet them there by an equi-join, which Spark can split at a hot leaf.
Blocks return the best k of each window and no pairs besides.

Rows take part if their label and id are not null and their vector is whole (``vectors.gridded``) and as long as most of
the table's. A repeated row counts as often as it stands; rows with the anchor's id are no positives or negatives of it;
repeated anchors are mined once. Scores that tie go by smaller id. Surplus columns of the input are ignored, and an empty
table gives no rows. Scores beyond the range of longs raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, removed, stored
from tessera.llm.vectors import common_length, gridded, matrix, of_length, products

#: Rows that the tree is grown from at most, split points of a node, rows that a leaf should hold, rows of a stored block,
#: anchors of a block.
SAMPLE, FANOUT, LEAF, BLOCK, ANCHORS = 32_768, 8, 512, 1024, 256
#: Ends of a window that is open.
LEAST, MOST = -(1 << 62), 1 << 62
#: Room for rounding in distances, as a share of them.
ROOM = 1e-9


@dataclass
class Node:
    """Split points (rows of coordinates) and what each leads to: the number of a node, or of a leaf as -1 - leaf."""

    points: np.ndarray
    below: list[int] = field(default_factory=list)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each row of x to each point; from exact integers, so equal vectors have distance 0."""
    squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * products(x, points)
    return np.sqrt(squares.astype(np.float64))


def grown(sample: np.ndarray, rows: int) -> tuple[list[Node], int]:
    """The tree's nodes, the root first, and how many leaves it has. Split points of a node are chosen one after another,
    each farthest from those before, among the node's sample."""
    nodes: list[Node] = []
    share, leaves = rows / max(len(sample), 1), 0

    def grow(mine: np.ndarray) -> int:
        nonlocal leaves
        first = distances(mine, mine[:1])[:, 0] if len(mine) else np.zeros(0)
        if len(mine) * share <= LEAF or len(mine) < 2 * FANOUT or not first.any():
            leaves += 1
            return -leaves
        chosen, near = [int(np.argmax(first))], None
        while len(chosen) < FANOUT:
            last = distances(mine, mine[chosen[-1:]])[:, 0]
            near = last if near is None else np.minimum(near, last)
            if not near.any():
                break
            chosen.append(int(np.argmax(near)))
        node, at = Node(mine[chosen]), len(nodes)
        nodes.append(node)
        nearest = np.argmin(distances(mine, node.points), axis=1)
        node.below = [grow(mine[nearest == i]) for i in range(len(chosen))]
        return at

    grow(sample)
    return nodes, leaves


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int
    #: For node, split point i and sibling j: least and greatest distance from i to the rows below j; none below j: no key.
    ranges: dict[tuple[int, int, int], tuple[float, float]] = field(default_factory=dict)
    #: For node and child j: least and greatest squared norm of the rows below.
    norms: dict[tuple[int, int], tuple[float, float]] = field(default_factory=dict)
    #: Rows of each leaf.
    sizes: dict[int, int] = field(default_factory=dict)

    def routed(self, x: np.ndarray, met: Callable[[int, np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
        """The leaf of each row. ``met`` gets each node, the rows there, their distances to its split points and their ways."""
        leaf, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            at, mine = todo.pop()
            node, far = self.nodes[at], distances(x[mine], self.nodes[at].points)
            way = np.argmin(far, axis=1)
            if met:
                met(at, mine, far, way)
            for j, below in enumerate(node.below):
                chosen = mine[way == j]
                if len(chosen) and below < 0:
                    leaf[chosen] = -1 - below
                elif len(chosen):
                    todo.append((below, chosen))
        return leaf

    def needed(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each anchor and leaf: whether rows with a score from low to high can be there."""
        if not self.nodes:
            return np.ones((len(x), 1), dtype=bool)
        found, own = np.zeros((len(x), self.leaves), dtype=bool), (x * x).sum(axis=1).astype(np.float64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, mine = todo.pop()
            node = self.nodes[at]
            far = distances(x[mine], node.points)
            for j, below in enumerate(node.below):
                if (at, j) not in self.norms:
                    continue  # no row is below
                least, greatest = self.norms[at, j]
                inner = np.sqrt(np.maximum(own[mine] + least - 2.0 * high[mine], 0)) * (1 - ROOM)
                outer = np.sqrt(np.maximum(own[mine] + greatest - 2.0 * low[mine], 0)) * (1 + ROOM)
                stays = own[mine] + greatest - 2.0 * low[mine] >= -ROOM * (own[mine] + greatest)
                for i in range(len(node.points)):
                    near, reach = self.ranges[at, i, j]
                    room = ROOM * (far[:, i] + reach)
                    stays &= (np.maximum(far[:, i] - reach, near - far[:, i]) - room <= outer) & (far[:, i] + reach + room >= inner)
                chosen = mine[stays]
                if len(chosen) and below < 0:
                    found[chosen, -1 - below] = True
                elif len(chosen):
                    todo.append((below, chosen))
        return found


def ranged(rows: DataFrame, tree: Tree, width: int) -> Tree:
    """The tree with its ranges over all rows. A task sends one row for each pair of siblings that it met."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[float, float, int]] = {}

        def widen(key: tuple[int, int, int], low: float, high: float, rows: int) -> None:
            old = held.get(key, (low, high, 0))
            held[key] = min(low, old[0]), max(high, old[1]), old[2] + rows

        for batch in batches:
            x = matrix(batch.column("x"), width)
            squares = (x * x).sum(axis=1)

            def met(at: int, mine: np.ndarray, far: np.ndarray, way: np.ndarray, squares: np.ndarray = squares) -> None:
                for j in np.unique(way).tolist():
                    low, high = far[way == j].min(axis=0).tolist(), far[way == j].max(axis=0).tolist()
                    for i, ends in enumerate(zip(low, high, strict=True)):
                        widen((at, i, j), *ends, 0)
                    norm = squares[mine[way == j]]
                    widen((at, -1, j), float(norm.min()), float(norm.max()), len(norm))

            tree.routed(x, met)
        if held:
            keys, ends = ([[k[n] for k in held] for n in range(3)], [[v[n] for v in held.values()] for n in range(3)])
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), *(pa.array(e, pa.float64()) for e in ends[:2]), pa.array(ends[2], pa.int64())], names=["node", "i", "j", "low", "high", "rows"])

    each = rows.select("x").mapInArrow(work, "node int, i int, j int, low double, high double, rows long")
    found = each.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows")).collect()
    ranges = {(r.node, r.i, r.j): (r.low, r.high) for r in found if r.i >= 0}
    norms = {(r.node, r.j): (r.low, r.high) for r in found if r.i < 0}
    sizes = {-1 - tree.nodes[r.node].below[r.j]: r.rows for r in found if r.i < 0 and tree.nodes[r.node].below[r.j] < 0}
    return Tree(tree.nodes, tree.leaves, ranges, norms, sizes)


def fitted(rows: DataFrame, width: int) -> Tree:
    """A tree for the rows ``x``, grown from a bounded sample, with ranges over all of them."""
    count = rows.count()
    sample = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(min(SAMPLE, count)).toArrow().column("x").combine_chunks()
    nodes, leaves = grown(matrix(sample, width), count)
    return ranged(rows, Tree(nodes, leaves), width) if nodes else Tree(nodes, leaves, sizes={0: count})


BLOCKS = "leaf long, ids binary, labels binary, xs binary"


def indexed(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """All rows in blocks: leaf, and ids, labels and coordinates as bytes of longs, by id."""

    parts = np.array([max(1, -(-tree.sizes.get(leaf, 0) // BLOCK)) for leaf in range(tree.leaves)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            leaf = tree.routed(x)
            # A leaf of many blocks is dealt over as many tasks.
            part = (batch.column("id").to_numpy() * 40503 + x.sum(axis=1)).astype(np.int64) // 7 % parts[leaf]
            yield batch.append_column("leaf", pa.array(leaf, pa.int64())).append_column("part", pa.array(part, pa.int64()))

    routed = rows.mapInArrow(route, "id long, label int, x array<long>, leaf long, part long")
    spread = routed.repartition("leaf", "part").sortWithinPartitions("leaf", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            ids, labels, xs = (np.concatenate([h[n] for h in held]) for n in (1, 2, 3))
            out = [[held[0][0]], [ids.tobytes()], [labels.tobytes()], [xs.tobytes()]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(o, pa.binary()) for o in out[1:])], names=["leaf", "ids", "labels", "xs"])

        for batch in batches:
            leaf, ids, labels = (batch.column(c).to_numpy() for c in ("leaf", "id", "label"))
            xs = matrix(batch.column("x"), width).astype(np.int64)
            start = 0
            while start < len(leaf):
                room = BLOCK - sum(len(h[1]) for h in held)
                if held and (held[0][0] != leaf[start] or not room):
                    yield block()
                    continue
                end = min(int(np.searchsorted(leaf, leaf[start], side="right")), start + room)
                held.append((int(leaf[start]), ids[start:end].astype(np.int64), labels[start:end].astype(np.int64), xs[start:end]))
                start = end
        if held:
            yield block()

    return spread.select("id", "label", "x", "leaf").mapInArrow(pack, BLOCKS)


def best(keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest keys of each row, in any order."""
    return np.argpartition(-keys, min(k, keys.shape[1]) - 1, axis=1)[:, :k] if keys.shape[1] > k else np.tile(np.arange(keys.shape[1]), (len(keys), 1))


def searched(asked: DataFrame, index: DataFrame, tree: Tree, width: int, k: int, same_label: bool, own_leaf: bool) -> DataFrame:
    """The k best rows of each window: anchor, window, candidate, score and rank.

    ``asked`` has a row for each anchor: anchor (a number of its own), id, label, x, and the arrays windows (any numbers),
    lows and highs (scores that count, ends included). Candidates have the anchor's label or, unless ``same_label``,
    another. ``own_leaf`` looks only into the leaf where the anchor itself would be: a first bound, not a whole answer.
    """
    carried = ("anchors", "ids", "labels", "xs", "owners", "windows", "lows", "highs")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ANCHORS):
                batch = whole.slice(start, ANCHORS)
                x = matrix(batch.column("x"), width)
                anchor, ids, labels = (batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "id", "label"))
                owner = np.repeat(np.arange(len(x)), batch.column("windows").value_lengths().to_numpy())
                window, low, high = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("windows", "lows", "highs"))
                if own_leaf:
                    goes = np.arange(tree.leaves)[None, :] == tree.routed(x)[owner, None]
                else:
                    goes = tree.needed(x[owner], low, high)
                for leaf in np.flatnonzero(goes.any(axis=0)).tolist():
                    mine = goes[:, leaf]
                    some, owners = np.unique(owner[mine], return_inverse=True)
                    sent = (anchor[some], ids[some], labels[some], x[some].astype(np.int64), owners.astype(np.int64), window[mine], low[mine], high[mine])
                    yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in sent)], names=["leaf", *(f"a_{c}" for c in carried)])

    blocks = asked.select("anchor", "id", "label", "x", "windows", "lows", "highs").mapInArrow(send, "leaf long, " + ", ".join(f"a_{c} binary" for c in carried))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: np.frombuffer(batch.column(c)[at].as_py(), dtype=np.int64) for c in batch.schema.names if c != "leaf"}
                ids, owner = row["ids"], row["a_owners"]
                scores = products(row["a_xs"].reshape(-1, width), row["xs"].reshape(-1, width))
                if scores.dtype == object:
                    raise OverflowError("scores beyond the range of longs")
                fits = ((row["a_labels"][:, None] == row["labels"]) == same_label) & (row["a_ids"][:, None] != ids)
                scores, fits = scores[owner], fits[owner]
                fits &= (scores >= row["a_lows"][:, None]) & (scores <= row["a_highs"][:, None])
                n = len(ids)
                if np.abs(scores).max(initial=0) < 1 << 50:  # score, then smaller id, in one key
                    top = best(np.where(fits, scores * n + (n - 1 - np.arange(n)), LEAST), k)
                else:
                    top = np.argsort(np.where(fits, -scores, MOST), axis=1, kind="stable")[:, :k]
                hit = np.take_along_axis(fits, top, axis=1)
                who, place = np.nonzero(hit)[0], top[hit]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (row["a_anchors"][owner[who]], row["a_windows"][who], ids[place], scores[who, place])], names=["anchor", "window", "candidate", "score"])

    met = blocks.join(index, "leaf").mapInArrow(score, "anchor long, window long, candidate long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "candidate")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answered(windows: DataFrame, anchors: DataFrame, index: DataFrame, tree: Tree, width: int, k: int, same_label: bool, label: str) -> DataFrame:
    """The k best rows of each window (anchor, window, low, high) in the whole index, stored. Where an anchor's own leaf
    fills a window, the worst found there bounds what has to be looked for elsewhere."""

    def gathered(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w"))  # few for each anchor
        return anchors.join(lists, "anchor").select("anchor", "id", "label", "x", *[F.col(f"w.{c}").alias(f"{c}s") for c in ("window", "low", "high")])

    first = searched(gathered(windows), index, tree, width, k, same_label, own_leaf=True)
    bounds = first.where(F.col("rank") == k).select("anchor", "window", F.col("score").alias("bound"))
    narrowed = windows.join(bounds, ["anchor", "window"], "left").select("anchor", "window", F.greatest("low", "bound").alias("low"), "high")
    return stored(searched(gathered(narrowed), index, tree, width, k, same_label, own_leaf=False), label)


def mined(
    vectors: DataFrame,
    anchor: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    n_positives: int = 5,
    n_negatives: int = 10,
    least: int = 30,
    most: int = 90,
) -> DataFrame:
    """For each row where ``anchor`` holds and each of its best positives, the best negatives whose score is from least to
    most hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("int").alias("label"), F.col(vector_col).alias("_vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = gridded(named.where(F.col("id").isNotNull() & F.col("label").isNotNull()), "_vector").select("id", "label", "x", "anchor")
    width = common_length(rows)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not width:
        return spark.createDataFrame([], out)
    rows = stored(rows.where(of_length(F.col("x"), width)), "negatives-rows")
    tree = fitted(rows, width)
    index = stored(indexed(rows.select("id", "label", "x"), tree, width), "negatives-index")
    anchors = stored(rows.where("anchor").select("id", "label", "x").distinct().withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    opened = anchors.select("anchor", F.lit(0).cast("long").alias("window"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    positives = answered(opened, anchors, index, tree, width, n_positives, True, "negatives-positives")
    ranked = positives.select("anchor", F.col("rank").cast("long").alias("window"), F.col("candidate").alias("positive_id"), F.col("score").alias("positive_score"))
    # 100 * negative lies between least * positive and most * positive: whole scores from the ceiling to the floor.
    ends = ranked.select("anchor", "window", (F.col("positive_score") * least).alias("low"), (F.col("positive_score") * most).alias("high"))
    windows = ends.select("anchor", "window", F.expr("(low + pmod(-low, 100)) div 100").alias("low"), F.expr("(high - pmod(high, 100)) div 100").alias("high")).where("low <= high")
    negatives = answered(windows, anchors, index, tree, width, n_negatives, False, "negatives-found")
    named = negatives.select("anchor", "window", F.col("rank").cast("int").alias("rank"), F.col("candidate").alias("negative_id"), F.col("score").alias("negative_score"))
    found = named.join(ranked, ["anchor", "window"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    result = stored(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    removed(rows, index, anchors, positives, negatives)
    return result
