"""Folds over a key's rows in order, one row at a time, for rules that no window expresses.

Rows are dealt by key and sorted inside their partition, so a task streams them with the state of one key in memory,
however many rows the key has. Spark cannot split a key here: its rows depend on one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task hands on together.
BATCH = 10_000
Step = Callable[[Any, dict[str, Any]], tuple[Any, dict[str, Any] | None]]


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Step, schema: str) -> DataFrame:
    """For each key's rows in order, ``step(state, row)`` gives the next state and a row of ``schema``, or none of it."""
    shape = StructType.fromDDL(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(shape)
        key, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (own := tuple(row[k] for k in keys)) != key:
                    key, state = own, start()
                state, told = step(state, row)
                if told is not None:
                    out.append(told)
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, types)
                    out = []
        yield pa.RecordBatch.from_pylist(out, types)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(work, schema)
