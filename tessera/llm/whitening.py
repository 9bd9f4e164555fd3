"""Whitening of embeddings: exact covariance by Spark, its leading components by contour integration (``feast``).

A row takes part if its vector is whole (see ``vectors.gridded``) and as long as most of the table's. The fit list holds
each distinct vector of grid coordinates once. Covariances are over the fit list, with divisor n: coordinates are centred
on the whole number next to their mean before they are multiplied, products and sums are exact integers, and what is left
of the mean is taken off at the end, so the covariance is rounded once.

Only the sums, of a size that the dimensions bound, come to the driver; rows never do. Repeated rows and null ids give
repeated results. An empty table gives no rows. A component without variance (all vectors equal, or fewer of them than
dimensions) has ``whitened`` null and ``explained`` 0, or null where no dimension varies. ``deviation`` is null where it
is beyond the range of longs. Surplus columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, removed, stored
from tessera.llm.feast import top
from tessera.llm.vectors import common_length, gridded, matrix, of_length, products

#: Share of the trace up to which a variance counts as none.
NO_VARIANCE = 1e-13


@dataclass(frozen=True)
class Model:
    """n vectors with sums ``sums``; x is centred as x - centre - rest / n, with whole ``centre`` and ``rest``."""

    n: int
    sums: tuple[int, ...]
    centre: tuple[int, ...]
    rest: tuple[int, ...]
    variances: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Components over the roots of their variances; those without variance are zero."""
        held = self.variances > NO_VARIANCE * self.trace
        return np.where(held, self.components / np.sqrt(np.where(held, self.variances, 1)), 0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.centre, dtype=np.int64)).astype(np.float64) @ self.scaled - (np.array([r / self.n for r in self.rest]) @ self.scaled)


def total(sums: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return sums.groupBy(*by).agg(F.sum("value").alias("value"))


def summed(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of the vectors and the sum of each dimension. Tasks send one row for each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = matrix(batch.column("x"), width)
            # Halves of a long cannot overflow when they are summed apart.
            high, low = x >> 32, x & 0xFFFFFFFF
            n += len(x)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high.sum(axis=0), low.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(width)], pa.int32()), pa.array([n, *sums], pa.decimal128(38))], names=["i", "value"])

    found = {r.i: int(r.value) for r in total(fit.mapInArrow(work, "i int, value decimal(38,0)"), ("i",)).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def product_sums(fit: DataFrame, width: int, centre: tuple[int, ...]) -> np.ndarray:
    """Exact sums of the products of centred dimensions, as Python's integers. Tasks send one row for each pair i <= j."""
    rows, columns = np.triu_indices(width)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, any_row = np.zeros((width, width), dtype=object), False
        for batch in batches:
            x = matrix(batch.column("x"), width) - np.array(centre, dtype=np.int64)
            # products() bounds one row's products by the number of columns: here the rows are what is summed over.
            held += products(x.T, x.T)
            any_row |= len(x) > 0
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(list(held[rows, columns]), pa.decimal128(38))], names=["i", "j", "value"])

    sums = np.zeros((width, width), dtype=object)
    for r in total(fit.mapInArrow(work, "i int, j int, value decimal(38,0)"), ("i", "j")).collect():
        sums[r.i, r.j] = sums[r.j, r.i] = int(r.value)
    return sums


def fitted(fit: DataFrame, width: int, k: int) -> Model:
    """The model of a list of distinct vectors ``x``."""
    n, sums = summed(fit, width)
    centre = tuple(round(Fraction(s, n)) if n else 0 for s in sums)
    rest = tuple(s - n * c for s, c in zip(sums, centre, strict=True))
    products_of = product_sums(fit, width, centre)
    covariance = np.array([[float(Fraction(n * int(products_of[i, j]) - rest[i] * rest[j], n * n)) if n else 0.0 for j in range(width)] for i in range(width)]).reshape(width, width)
    variances, components = top(covariance, k)
    return Model(n, tuple(sums), centre, rest, np.maximum(variances, 0), components, float(np.trace(covariance)))


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on all its vectors."""
    width, k = model.components.shape
    held = model.variances > NO_VARIANCE * model.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, any_row = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            w = model.whitened(matrix(batch.column("x"), width))
            first, second, any_row = first + w.sum(axis=0), second + w.T @ w, True
        if any_row:
            at = [(i, j) for i in range(-1, k) for j in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([float(first[j] if i < 0 else second[i, j]) for i, j in at])], names=["i", "j", "value"])

    found = {(r.i, r.j): r.value / model.n for r in total(fit.mapInArrow(work, "i int, j int, value double"), ("i", "j")).collect()}
    off = [abs(found[i, j] - found[-1, i] * found[-1, j] - (i == j)) for i in range(k) for j in range(k) if held[i] and held[j]]
    return max(off, default=0.0)


def whitened(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4) -> DataFrame:
    """For each row that takes part and each of the first k components: id, component, n, deviation, whitened, explained
    and identity_error (see the module)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = gridded(vectors.select(id_col, vector_col), vector_col).select(id_col, "x")
    width = common_length(rows)
    kept = rows.where(of_length(F.col("x"), width))
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], schema)
    fit = stored(kept.select("x").distinct(), "whitening-fit")
    model = fitted(fit, width, k)
    error = identity_error(fit, model)
    removed(fit)
    count, held = len(model.variances), model.variances > NO_VARIANCE * model.trace
    shares = [float(e / model.trace) if model.trace > 0 else None for e in model.variances]
    whole = max(map(abs, model.rest), default=0)

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - sum)^2."""
        off = x - np.array(model.centre, dtype=np.int64)
        bound = (int(np.abs(off).max(initial=0)) * model.n + whole) ** 2 * width
        if bound < 1 << 63:
            return ((off * model.n - np.array(model.rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((off.astype(object) * model.n - np.array(model.rest, dtype=object)) ** 2).sum(axis=1)
        return [int(d) if d < 1 << 63 else None for d in exact]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            w, size = model.whitened(x).reshape(-1), len(x) * count
            arrays = [
                batch.column(id_col).take(pa.array(np.repeat(np.arange(len(x)), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, model.n, dtype=np.int64)),
                pa.array([d for d in deviations(x) for _ in range(count)], pa.int64()),
                pa.array(w, mask=~np.tile(held, len(x))),
                pa.array(shares * len(x), pa.float64()),
                pa.array(np.full(size, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(work, schema)
