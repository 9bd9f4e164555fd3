"""What the operators on vectors share: rows that hold whole finite vectors, as integer coordinates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of one unit on the integer grid.
GRID = 256
#: Products and their sums below this are exact in doubles.
EXACT = 1 << 53


def gridded(vectors: DataFrame, vector_col: str, x: str = "x") -> DataFrame:
    """The rows whose vector is whole (not null, of a length above 0, no entry null or not finite), with its coordinates
    floor(256 * c) as longs beside them. Coordinates beyond the range of longs stop at its ends."""
    vector = F.col(f"`{vector_col}`")
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    grid = F.transform(vector, lambda c: F.floor(c.cast("double") * GRID).cast("long"))
    return vectors.where(vector.isNotNull() & (F.size(vector) > 0) & whole).withColumn(x, grid)


def common_length(rows: DataFrame, x: str = "x") -> int:
    """The length of most vectors, the longer at a tie; 0 without rows. Lengths are counted, and few."""
    found = rows.groupBy(F.size(x).alias("length")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("length")).limit(1).collect()
    return found[0].length if found else 0


def of_length(x: Column, length: int) -> Column:
    return F.size(x) == length


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A batch's coordinates, a row for each vector: longs, or Python's integers where differences would overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    return x if x.max(initial=0) < 1 << 61 and x.min(initial=0) > -(1 << 61) else x.astype(object)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integer matrices, exact: in doubles where nothing is rounded, else in longs, else in Python's integers."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    return a.astype(object) @ b.T.astype(object)
