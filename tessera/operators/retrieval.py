"""Dense and lexical search for many queries at once.

Dense: the queries are a stated set, broadcast in blocks of a bounded number; blocks of rows are multiplied with them
(``products``), and only each block's best rows of a query are shuffled. Lexical: an inverted index finds the texts that can hold a term
(``postings``), and those are looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.vectors import combined, norm, unit
from tessera.operators import postings, products

LEAST = 0.35


def best(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """Each query's first k rows with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


#: Queries that are broadcast at a time.
QUERY_BLOCK = 10_000


def met(queries: DataFrame, rows: DataFrame, vectors: dict[str, tuple[str, float]], k: int, least: float | None = None, skip_own: bool = False) -> DataFrame:
    """What can be among the first k rows of each query of the stated set, with its score (``products.nearest``). The
    queries are counted first: a block of them is broadcast, and more than one block meet the rows one after another."""
    blocks = -(-queries.count() // QUERY_BLOCK)
    if blocks <= 1:
        return products.nearest(queries, rows, vectors, k, least, skip_own)
    of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.union, [products.nearest(queries.where(of == i), rows, vectors, k, least, skip_own) for i in range(blocks)])


def by_score(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("id")]


def entry_dense(queries: DataFrame, vectors: DataFrame, k: int = 10, over: int = 3, least: float = LEAST, label: str | None = None) -> DataFrame:
    """Inner product of the query with the unit vector along 0.3 title + 0.7 content (R15). More rows than asked are
    fetched; the bound on scores and the label filter come after, so fewer than k may remain. What is below the bound
    comes last, so blocks need not hand it on."""
    unit = vectors.select("id", "label", combined(F.col("title_vector"), F.col("content_vector"), 0.3, 0.7).alias("v"))
    q = queries.select("query_id", combined(F.col("query_vector"), F.col("query_vector"), 1.0, 0.0).alias("q"), "query_label")
    found = best(met(q, unit, {"v": ("q", 1.0)}, over * k, least), over * k, *by_score())
    if label is not None:
        found = found.where(F.col("label") == F.col(label))
    return best(found.drop("rank"), k, *by_score()).select("query_id", "rank", "id", "score")


def entry_dense_fallback(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = LEAST) -> DataFrame:
    """0.3 times the title's cosine and 0.7 times the content's (R16); if nothing reaches the bound, the best k anyway.
    A zero vector counts 0, as one with null entries does."""
    along = lambda c: F.when(norm(F.col(c)).isNotNull(), unit(F.col(c)))
    q = queries.select("query_id", along("query_vector").alias("q"))
    rows = vectors.select("id", along("title_vector").alias("t"), along("content_vector").alias("c"))
    scored = best(met(q, rows, {"t": ("q", 0.3), "c": ("q", 0.7)}, k), k, *by_score())
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("top", top).where((F.col("score") >= least) | (F.col("top") < least)).select("query_id", "rank", "id", "score")


def dense(queries: DataFrame, vectors: DataFrame, k: int = 30, least: float = LEAST, skip_own: bool = False) -> DataFrame:
    """Cosine search (R17-R20). A zero query finds nothing; a zero row scores 0. Vectors are brought to unit length once
    each, before they meet, so a pair costs one product."""
    asked = queries.where(norm(F.col("query_vector")) > 0).select("query_id", unit(F.col("query_vector")).alias("q"))
    rows = vectors.select("id", unit(F.col("content_vector")).alias("v"))
    return best(met(asked, rows, {"v": ("q", 1.0)}, k, least, skip_own), k, *by_score()).select("query_id", "rank", "id", "score")


def keyword(queries: DataFrame, entries: DataFrame, clock: str, k: int = 30, over: int = 3) -> DataFrame:
    """Keyword search (R8): of the newest 3k entries with a term, score term counts and recency, over the best score.

    queries: (query_id, terms). A term that occurs n times counts 1 + 0.15 min(n, 5).
    """
    hay = F.lower(F.concat_ws("\n", "content", "label_code"))
    rows = entries.select("id", "created_at", hay.alias("hay"))
    counts = F.transform("terms", lambda t: tx.occurrences(F.col("hay"), t))
    points = F.aggregate(F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda s, n: s + 1 + 0.15 * F.least(n, F.lit(5)))
    scored = postings.met(queries, rows).select("query_id", "id", "created_at", points.alias("points")).where("points > 0")
    newest = best(scored, over * k, F.desc("created_at"), F.desc("id")).drop("rank")
    age = F.datediff(F.lit(clock).cast("date"), F.to_date("created_at"))
    recency = F.greatest(F.lit(0.0), 0.2 - F.least(F.greatest(age, F.lit(0)), F.lit(365)) / 365 * 0.2)
    total = newest.select("query_id", "id", (F.col("points") + recency).alias("raw"))
    return best(total.withColumn("score", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")), 6)), k, *by_score()).select("query_id", "rank", "id", "score")


def lexical(queries: DataFrame, entries: DataFrame, k: int | None = 40, budget: int | None = None) -> DataFrame:
    """Distinct terms in titles and bodies (R9, R10): title hits first, then more title hits, more body hits, id. The body
    is the whole text, its title included.

    With a budget, only the first so many texts of a query with a term, by id, are ranked; ``cut`` says whether there
    was one more (R9). No k: all of them.
    """
    hay = F.lower("content")
    rows = entries.select("id", F.lower(tx.title(F.col("content"))).alias("title"), hay.alias("hay"))
    in_title = F.size(F.filter("terms", lambda t: F.contains("title", t))).cast("long")
    in_body = F.size(F.filter("terms", lambda t: F.contains("hay", t))).cast("long")
    scored = postings.met(queries, rows).select("query_id", "id", in_title.alias("title_hits"), in_body.alias("body_hits")).where("body_hits > 0")
    columns = ["query_id", "rank", "id", "title_hits", "body_hits"]
    if budget is not None:
        # One text more than the budget shows that the budget cuts; it is not ranked.
        first = best(scored, budget + 1, F.asc("id")).drop("rank").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
        probed = first.withColumn("cut", F.max("n").over(Window.partitionBy("query_id")) > budget)
        scored, columns = probed.where(F.col("n") <= budget).drop("n"), [*columns, "cut"]
    order = [F.when(F.col("title_hits") > 0, 0).otherwise(1), F.desc("title_hits"), F.desc("body_hits"), F.asc("id")]
    if k is None:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).select(*columns)
    return best(scored, k, *order).select(*columns)


def page_lexical(queries: DataFrame, pages: DataFrame, k: int = 20, before: int = 40, after: int = 200, opening: int = 420) -> DataFrame:
    """How many of the terms occur in title, path and text of a page, and what is shown of it (R11): the text around the
    first term, in the query's order, that occurs in the text itself, or else the text's opening."""
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    rows = pages.select("id", plain.alias("plain"), F.lower(F.concat_ws("\n", "title", "host", "lang", plain)).alias("hay"))
    hits = F.size(F.filter("terms", lambda t: F.contains("hay", t))).cast("long")
    scored = postings.met(queries, rows).withColumn("score", hits).where("score > 0")
    found = best(scored.select("query_id", "id", "score"), k, *by_score())
    # Only what is returned is looked at again for its snippet.
    shown = found.join(queries, "query_id").join(rows.select("id", "plain"), "id").withColumn("low", F.lower("plain"))
    places = F.filter(F.transform("terms", lambda t: F.instr(F.col("low"), t)), lambda p: p > 0)
    shown = shown.withColumn("at", F.get(places, F.lit(0)) - 1)
    start = F.greatest(F.col("at") - before, F.lit(0))
    snippet = F.when(F.col("at").isNull(), F.substring("plain", 1, opening)).otherwise(F.substring(F.col("plain"), start + 1, F.col("at") + after - start))
    return shown.select("query_id", "rank", "id", "score", snippet.alias("snippet"))
