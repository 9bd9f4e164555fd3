"""Lexical search by an inverted index of character n-grams.

A term is a part of a text and no word of it, so the index is of n-grams: of three characters, or of a whole term that is
shorter. Only n-grams that some term has are kept. Of each term the n-gram that the fewest texts hold finds its candidates
by an equi-join; the texts of those are then looked at themselves. No text meets a query that it shares nothing with, and
what is sent is n-grams and ids. Where a term's rarest n-gram stands in no text, the term has no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import bounded_batches, stored

#: Characters of an n-gram; three code points and their places fit a long.
SIZE, BITS = 3, 21
#: Rows up to which a counted table is broadcast, and n-grams up to which counted ones are sent along with the tasks.
SMALL, SENT = 200_000, 1_000_000


def small(rows: DataFrame) -> DataFrame:
    """The table, to be broadcast if it was counted to be small."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def coded(text: str, size: int) -> np.ndarray:
    """The n-grams of a text as numbers, in its order; numbers of different sizes differ."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64) + 1
    last = max(len(points) - size + 1, 0)
    found = points[:last]
    for i in range(1, size):
        found = found | points[i : i + last] << BITS * i
    return found


def exploded(rows: DataFrame, key: str, text: str, sizes: list[int] | None, among: np.ndarray | None = None) -> DataFrame:
    """(key, gram) for the distinct n-grams of each text, of the sizes or else of the text's own size up to SIZE, and only
    those ``among`` sorted ones if given. A null text has none."""
    bounded_batches(rows.sparkSession)

    def of(whole: str) -> np.ndarray:
        found = np.concatenate([coded(whole, n) for n in sizes or [min(len(whole), SIZE) or 1]])
        if among is not None:
            at = np.minimum(np.searchsorted(among, found), max(len(among) - 1, 0))
            found = found[among[at] == found] if len(among) else found[:0]
        return np.unique(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(whole or "") for whole in batch.column(text).to_pylist()]
            places = np.repeat(np.arange(len(found)), [len(g) for g in found])
            grams = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(places)), pa.array(grams)], names=[key, "gram"])

    return rows.select(key, text).mapInArrow(work, f"{key} {rows.schema[key].dataType.simpleString()}, gram long")


def terms_of(queries: DataFrame) -> DataFrame:
    """Each query's distinct terms: (query_id, term)."""
    return queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).where("term <> ''")


def asked(terms: DataFrame) -> tuple[DataFrame, list[int]]:
    """The n-grams of each distinct term, (term, gram), and the sizes that they have."""
    each = terms.select("term").distinct()
    sizes = each.select(F.least(F.length("term"), F.lit(SIZE)).alias("size")).distinct().collect()  # SIZE values at most
    return exploded(each.withColumn("said", F.col("term")), "term", "said", None), sorted(r["size"] for r in sizes)


def index(texts: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """Postings (gram, id) of the wanted n-grams over texts (id, hay). They are counted: as a rule they are few, as an
    alphabet bounds them, and go to the tasks, which then send no others; else a semi-join drops the others."""
    distinct = wanted.select("gram").distinct()
    known = distinct.limit(SENT + 1).toArrow().column("gram").to_numpy()
    if len(known) <= SENT:
        return exploded(texts, "id", "hay", sizes or [SIZE], np.sort(known))
    return exploded(texts, "id", "hay", sizes).join(distinct, "gram", "left_semi")


def candidates(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (query_id, id) that hold all texts with a term of the query, and few others.

    queries: (query_id, terms), terms in lower case; texts: (id, hay), hay in lower case.
    """
    terms = terms_of(queries)
    parts, sizes = asked(terms)
    postings = stored(index(texts, parts, sizes), "postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    known = parts.join(counts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = known.groupBy("term").agg(F.min(F.struct("texts", "gram")).alias("r")).where("r.texts > 0").select("term", F.col("r.gram").alias("gram"))
    near = terms.join(rarest, "term").select("query_id", "gram").distinct()
    return postings.join(near, "gram").select("query_id", "id").distinct()


def met(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates with the columns of both sides, for what looks at the texts themselves."""
    pairs = candidates(queries, texts.select("id", "hay"))
    return pairs.join(queries, "query_id").join(texts, "id")
