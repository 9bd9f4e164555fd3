"""Whether streamed turns follow their protocol (Q4), by composing transition tables.

An event is a table from states to states. Tables compose, and it doesn't matter where a request's events are cut: rows
are dealt by ranges of request and time, so the events of one request may lie in many tasks; each task folds its part of
a request into one table, and only these tables meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

STATES = ["start", "opened", "sourced", "text", "grounded", "references", "candidates", "done", "error", "invalid"]
#: What may follow: a turn opens, says how it goes, then either offers candidates or names its sources, answers, is
#: checked and lists references. It ends once, and a request that has ended may be opened again, to be replayed. A turn
#: that is refused before it opens is a single error.
FOLLOWS = {
    "start": {"meta": "opened", "error": "error"},
    "opened": {"status": "opened", "source_set": "sourced", "source_candidate": "candidates", "text_delta": "text", "done": "done", "error": "error"},
    "sourced": {"status": "sourced", "text_delta": "text", "error": "error"},
    "text": {"text_delta": "text", "status": "grounded", "reference": "references", "done": "done", "error": "error"},
    "grounded": {"reference": "references", "done": "done", "error": "error"},
    "references": {"reference": "references", "done": "done", "error": "error"},
    "candidates": {"source_candidate": "candidates", "done": "done", "error": "error"},
    "done": {"meta": "opened"},
    "error": {"meta": "opened"},
    "invalid": {},
}


def table_of(event: str | None) -> tuple[int, ...]:
    """Where an event leads from each state; unknown events and null lead to 'invalid'."""
    return tuple(STATES.index(FOLLOWS[s].get(event, "invalid")) for s in STATES)


def parts(events: DataFrame) -> DataFrame:
    """(request, at, id, events, ended, steps): of each run of a request's events in a task its first place, their number,
    how many of them end a turn, and their table."""
    tables = {e: table_of(e) for e in {e for to in FOLLOWS.values() for e in to}}
    unknown = table_of(None)
    rows = events.select("request", "at", "id", "event").repartitionByRange("request", "at", "id").sortWithinPartitions("request", "at", "id")
    schema = events.select("request", "at", "id").schema.add("events", LongType()).add("ended", LongType()).add("steps", ArrayType(IntegerType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places, told = None, None, []
        for batch in batches:
            places = batch.schema
            for i, (request, event) in enumerate(zip(batch.column("request").to_pylist(), batch.column("event").to_pylist(), strict=True)):
                step = tables.get(event, unknown)
                if held is None or held[0] != request:
                    if held:
                        told.append(held)
                    held = [request, batch.slice(i, 1), 0, 0, range(len(STATES))]
                held[2] += 1
                held[3] += event in ("done", "error")
                held[4] = [step[s] for s in held[4]]
            if told:
                yield packed(places, told)
                told = []
        if held:
            yield packed(places, [held])

    def packed(places: pa.Schema, runs: list) -> pa.RecordBatch:
        first = pa.Table.from_batches([r[1] for r in runs]).select(["request", "at", "id"]).combine_chunks()
        more = {"events": pa.array([r[2] for r in runs], pa.int64()), "ended": pa.array([r[3] for r in runs], pa.int64()), "steps": pa.array([list(r[4]) for r in runs], pa.list_(pa.int32()))}
        return pa.RecordBatch.from_arrays([*(c.chunk(0) for c in first.columns), *more.values()], names=["request", "at", "id", *more])

    return rows.mapInArrow(work, schema)


def composed(steps: Column, start: Column) -> Column:
    """The state that tables lead to, one after another."""
    return F.aggregate(steps, start, lambda state, part: F.element_at(part["steps"], state + 1))


def outcomes(events: DataFrame) -> DataFrame:
    """(request, events, ended, outcome) of each request: 'done' or 'error' by its last turn, 'invalid' if any event is out of
    order, else 'open' (Q4).

    events: (request, at, id, event), in the order of at and id. A null request is a request of its own.
    """
    one = parts(events).groupBy("request").agg(F.sum("events").alias("events"), F.sum("ended").alias("ended"), F.array_sort(F.collect_list(F.struct("at", "id", "steps"))).alias("parts"))
    state = F.element_at(F.array(*map(F.lit, STATES)), composed(F.col("parts"), F.lit(0)) + 1)
    return one.select("request", "events", "ended", F.when(state.isin("done", "error", "invalid"), state).otherwise("open").alias("outcome"))
