"""Scores of many vectors with many queries as products of blocks.

Both sides are packed into blocks of one shape. Blocks of rows lie where the rows lie and are dealt out; blocks of queries
are broadcast. A task multiplies two blocks at a time and hands on each query's best rows of the block, so what is sent is
in proportion to the queries and blocks and not to the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.sources.storage import bounded_batches

#: Scores are told to so many places.
PLACES = 6
#: Scores that are held at a time.
SLICE = 1 << 20
#: A null vector has no size, and one with null entries a negative one.
NONE = -1


def sizes_of(column: pa.ListArray) -> np.ndarray:
    sizes, flat = column.value_lengths().fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()
    if flat.null_count:
        ends = np.cumsum(np.maximum(sizes, 0))
        nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        sizes = np.where(nulls[ends] > nulls[ends - np.maximum(sizes, 0)], -sizes - 1, sizes)
    return sizes


def packed(rows: DataFrame, vectors: list[str], name: str) -> DataFrame:
    """(name: the other columns of the rows of a block, sizes and values of their vectors), each block of one shape."""
    keys = StructType([f for f in rows.schema if f.name not in vectors])
    bounded_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.stack([sizes_of(batch.column(v)) for v in vectors], axis=1)
            for shape in np.unique(sizes, axis=0):
                own = batch.take(pa.array(np.flatnonzero((sizes == shape).all(axis=1))))
                key = pa.StructArray.from_arrays([own.column(k) for k in keys.names], fields=[pa.field(k, own.schema.field(k).type) for k in keys.names])
                values = [own.column(v).flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes() for v in vectors]
                columns = [pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key), pa.array([shape.tolist()], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=[name, f"{name}_sizes", f"{name}_values"])

    return rows.select(*keys.names, *vectors).mapInArrow(work, f"{name} array<{keys.simpleString()}>, {name}_sizes array<long>, {name}_values array<binary>")


def weighed(asked: list[np.ndarray], held: list[np.ndarray], sizes: list[tuple[int, int]], weights: list[float]) -> np.ndarray | None:
    """Weighted sums of products; vectors of different sizes count 0, and null entries make the sum null."""
    found = np.zeros((len(asked[0]), len(held[0])))
    for (one, other), a, b, weight in zip(sizes, asked, held, weights, strict=True):
        width = [-n - 1 if n < NONE else n for n in (one, other)]
        if NONE in width or width[0] != width[1]:
            continue
        if min(one, other) < NONE:
            return None
        found += weight * (a @ b.T)
    return found


def firsts(scores: np.ndarray | None, shape: tuple[int, int], ids: np.ndarray, k: int, least: float | None, left_out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's first k rows by falling rounded score and id; NaN comes first, null last."""
    worth = np.full(shape, -np.inf) if scores is None else np.where(np.isnan(scores), np.inf, scores)
    if left_out is not None:
        worth[left_out] = -np.inf
    near = 10.0**-PLACES
    bound = np.full(shape[0], -np.inf if least is None else least - near)
    many = np.flatnonzero((worth >= bound[:, None]).sum(axis=1) > k)
    if len(many):
        bound[many] = np.maximum(bound[many], np.partition(worth[many], shape[1] - k, axis=1)[:, shape[1] - k] - 2 * near)
    query, row = np.nonzero(worth >= bound[:, None])
    said = worth[query, row]
    whole = np.isfinite(said)
    said[whole] = np.sign(said[whole]) * np.floor(np.abs(said[whole]) * 10**PLACES + 0.5) / 10**PLACES + 0.0
    if least is not None:
        query, row, said = (x[said >= least] for x in (query, row, said))
    order = np.lexsort((ids[row], -said, query))
    query, row, said = query[order], row[order], said[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], row[place < k], said[place < k]


def nearest(queries: DataFrame, rows: DataFrame, vectors: dict[str, tuple[str, float]], k: int, least: float | None = None, skip_own: bool = False) -> DataFrame:
    """For each block of rows its first k rows of each query, with all columns but the vectors and ``score``, rounded: the
    weighted sum of products of a row's vectors with the query's, ``vectors`` being {row's: (query's, weight)}.

    The first k of what this gives are the first k of all rows. queries: (query_id, ...), to be broadcast; rows: (id, ...)
    with long ids. Vectors are double.
    """
    weights = [weight for _, weight in vectors.values()]
    of_query = list(dict.fromkeys(q for q, _ in vectors.values()))
    place = [of_query.index(q) for q, _ in vectors.values()]
    held = packed(rows, list(vectors), "held").repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    pairs = held.join(F.broadcast(packed(queries, of_query, "asked")), F.lit(True))
    told = StructType([*[f for side, own in (("asked", of_query), ("held", list(vectors))) for f in pairs.schema[side].dataType.elementType], StructField("score", DoubleType())])

    def matrix(values: bytes, n: int) -> np.ndarray:
        return np.frombuffer(values).reshape(n, -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, held = (batch.column(c)[i].values for c in ("asked", "held"))
                (a_sizes, h_sizes), (a_values, h_values) = ([batch.column(f"{c}_{kind}")[i].as_py() for c in ("asked", "held")] for kind in ("sizes", "values"))
                mine, theirs = [matrix(a_values[p], len(asked)) for p in place], [matrix(v, len(held)) for v in h_values]
                sizes = [(a_sizes[p], n) for p, n in zip(place, h_sizes, strict=True)]
                ids, own = held.field("id").to_numpy(zero_copy_only=False), asked.field("query_id").to_numpy(zero_copy_only=False)
                step = max(SLICE // len(held), 1)
                for at in range(0, len(asked), step):
                    some = own[at : at + step]
                    scores = weighed([m[at : at + step] for m in mine], theirs, sizes, weights)
                    query, row, said = firsts(scores, (len(some), len(held)), ids, k, least, some[:, None] == ids[None, :] if skip_own else None)
                    left, right = asked.take(pa.array(query + at)), held.take(pa.array(row))
                    score = pa.array(np.where(said == np.inf, np.nan, said), mask=said == -np.inf)
                    yield pa.RecordBatch.from_arrays([*left.flatten(), *right.flatten(), score], names=told.names)

    return pairs.mapInArrow(work, told)
