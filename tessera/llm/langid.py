"""Language identification by words first, then by ever shorter character n-grams.

Learning counts lower-cased words of each language over all training rows: every word counts, however rare. A
document's words are scored by per-language log frequency if they were learned; for a word that wasn't, the longest
character n-grams of it that were learned are averaged.

Frequent words have their scores in a table of bounded size that each worker holds. All other words of the documents
meet the whole model in joins: distinct words first, then, for the unseen among them, their n-grams, order by order
until each has one that was learned. So the table's size is a matter of speed and changes no result.

Words are runs of letters, which may carry combining marks. A text that is null, empty or without letters, or a model
that saw no language, gives ``und`` with score 0. Ties go to the first language by code point. Rows are independent,
so repeated rows and null ids give repeated results. Training ignores rows without a language or text. Surplus
columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, stored

UNDETERMINED = "und"
#: Lengths of the character n-grams, longest first.
ORDERS = (5, 4, 3, 2, 1)
#: Entries of the table of frequent words that workers hold, and the most scores in it over all languages.
TABLE_WORDS, TABLE_SCORES = 200_000, 4_000_000
#: Distinct entries that a task holds before it sends them on.
HELD = 100_000
#: Rows that a task numbers at most.
TASK_ROWS = 1 << 36

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORD = re.compile(r"[a-z]+")
#: As WORD, for texts without what unusual() finds.
PLAIN_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def unusual() -> re.Pattern[str]:
    """Code points that PLAIN_WORD takes for letters though they aren't, or the reverse; and all beyond the first plane."""
    odd = [chr(c) for c in range(0x80, 0x10000) if (k := unicodedata.category(chr(c)))[0] == "M" or (k in ("No", "Nl")) or (chr(c).isalnum() and k[0] != "L" and k != "Nd")]
    return re.compile("[" + "".join(map(re.escape, odd)) + f"\U00010000-{chr(sys.maxunicode)}]")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return ASCII_WORD.findall(text)
    return (WORD if unusual().search(text) else PLAIN_WORD).findall(text)


def grams(word: str, n: int) -> list[str]:
    framed = f"^{word}$"
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def grams_column(word: Column, n: int) -> Column:
    """The n-grams of a framed word that is long enough; none of others."""
    framed = F.concat(F.lit("^"), word, F.lit("$"))
    return F.when(F.length(framed) >= n, F.transform(F.sequence(F.lit(1), F.length(framed) - n + 1), lambda i: F.substring(framed, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


@dataclass
class Model:
    """What was learned. Counts of languages that an entry lacks are no part of its list."""

    langs: list[str]
    words: DataFrame | None  # entry, n of all languages, counts: array of (lang, n)
    totals: dict[int, list[int]]  # 0: words, else the n-gram length; of each language
    table: dict[str, int]
    scores: np.ndarray  # a row for each entry of the table

    def vector(self, kind: int, counts: Column) -> Column:
        """Log frequencies, by language, of an entry with these counts; one without counts has half an occurrence."""
        total = F.array(*[F.lit(float(t + 1)) for t in self.totals[kind]])
        found = F.map_from_entries(counts)
        name = F.array(*map(F.lit, self.langs))
        return F.transform(F.sequence(F.lit(0), F.lit(len(self.langs) - 1)), lambda i: F.log(F.coalesce(F.element_at(found, F.get(name, i)).cast("double"), F.lit(0.5)) / F.get(total, i)))


def counted(docs: DataFrame) -> DataFrame:
    """(entry, lang, n) of words, summed in each task as far as memory allows and then by Spark."""

    def sent(held: dict[str, Counter]) -> pa.RecordBatch:
        langs = pa.array([lang for lang, found in held.items() for _ in found], pa.string())
        entries = pa.array([entry for found in held.values() for entry in found], pa.string())
        return pa.RecordBatch.from_arrays([langs, entries, pa.array([n for found in held.values() for n in found.values()], pa.int64())], names=["lang", "entry", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, held.values())) > HELD:
                    yield sent(held)
                    held = {}
        yield sent(held)

    return docs.mapInArrow(work, "lang string, entry string, n long").groupBy("entry", "lang").agg(F.sum("n").alias("n"))


def fitted(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", table_words: int = TABLE_WORDS) -> Model:
    """Learns from all rows of ``train``. The driver gets the table of frequent words and a few sums."""
    bounded_batches(train.sparkSession)
    rows = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    each = counted(rows).groupBy("entry").agg(F.sum("n").alias("n"), F.collect_list(F.struct("lang", "n")).alias("counts"))
    words = stored(each, "language-words")
    # How many n-grams a word has follows from its length, so no n-gram is counted before one is asked for.
    length = F.length("entry") + 2
    sums = words.select(F.explode("counts").alias("c"), length.alias("length")).groupBy("c.lang").agg(F.sum("c.n").alias("n0"), *[F.sum(F.col("c.n") * F.greatest(F.col("length") - n + 1, F.lit(0))).alias(f"n{n}") for n in ORDERS])
    found = {r["lang"]: r for r in sums.collect()}
    langs = sorted(found)
    totals = {kind: [found[lang][f"n{kind}"] for lang in langs] for kind in (0, *ORDERS)}
    model = Model(langs, words if langs else None, totals, {}, np.empty((0, len(langs)), np.float32))
    # A histogram over eighths of powers of two tells how frequent a word must be.
    level = F.floor(8 * F.log2("n"))
    room, least = min(table_words, TABLE_SCORES // max(1, len(langs))), None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):
        if (room := room - r["count"]) < 0:
            break
        least = r["level"]
    if least is not None:
        chosen = words.where(level >= least).select("entry", model.vector(0, F.col("counts")).cast("array<float>").alias("v")).toArrow()
        model.table = {entry: i for i, entry in enumerate(chosen["entry"].to_pylist())}
        model.scores = np.array(chosen["v"].combine_chunks().flatten().to_numpy(), np.float32).reshape(-1, len(langs))
    return model


def split_scores(docs: DataFrame, model: Model, keep: tuple[str, ...], text_col: str) -> DataFrame:
    """The columns of ``keep``, a number of the row, how many words it has, the sum of the table's scores, and the words
    that the table lacks with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.scores))  # bounded by the table's size
    width = len(model.langs)
    names = ["_row", "_words", "_sum", "_rest", "_times"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scores = shared.value
        row = TaskContext.get().partitionId() * TASK_ROWS
        for batch in batches:
            sums, sizes, rest, times = [], [], [], []
            for text in batch.column("_text").to_pylist():
                words = words_of(text)
                at = list(map(table.get, words))
                other = Counter(w for w, i in zip(words, at, strict=True) if i is None) if None in at else {}
                known = [i for i in at if i is not None] if other else at
                # In parts, so that a long text needs no more memory than its words.
                sums.append(sum((scores[known[j : j + 65_536]].sum(axis=0, dtype=np.float64) for j in range(0, len(known), 65_536)), np.zeros(width)))
                sizes.append(len(words))
                rest.append(list(other))
                times.append(list(other.values()))
            n = len(sizes)
            arrays = [pa.array(range(row, row + n), pa.int64()), pa.array(sizes, pa.int64()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64())), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            row += n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays], names=[*keep, *names])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, docs[text_col].alias("_text")).mapInArrow(work, f"{kinds}_row long, _words long, _sum array<double>, _rest array<string>, _times array<long>")


def backed_off(unseen: DataFrame, model: Model) -> DataFrame:
    """(word, v) of words that weren't learned: the mean over their longest n-grams that were, order by order."""
    found, left = [], unseen
    empty = F.array_repeat(F.lit(0.0), len(model.langs))
    for order in ORDERS:
        if left.isEmpty():
            return unioned(found)
        asked = left.select("word", F.explode(grams_column(F.col("word"), order)).alias("gram"))
        # Distinct n-grams are few beside the words that have them, so they are summed in each task before they are sent.
        learned = model.words.select("counts", F.explode(grams_column(F.col("entry"), order)).alias("gram"))
        learned = learned.select("gram", F.explode("counts").alias("c")).groupBy("gram", "c.lang").agg(F.sum("c.n").alias("n"))
        vectors = learned.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("counts")).select("gram", model.vector(order, F.col("counts")).alias("v"))
        vectors = stored(vectors, "language-vectors")  # as a table, so that Spark can split an ending that many words share
        means = F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(len(model.langs))])
        hit = stored(asked.join(vectors.hint("shuffle_hash"), "gram").groupBy("word").agg(means.alias("v")), "language-grams")
        found.append(hit)
        left = left.join(hit, "word", "left_anti")
    return unioned([*found, left.select("word", empty.alias("v"))])


def unioned(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def predicted(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, then lang_pred, score (the posterior of that language under equal priors) and known (the
    share of the text's words that were learned)."""
    bounded_batches(docs.sparkSession)
    if not model.langs:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("known"))
    width = len(model.langs)
    rows = stored(split_scores(docs, model, keep, text_col), "language-rows")
    rest = rows.select("_row", F.explode(F.arrays_zip("_rest", "_times")).alias("w")).select("_row", F.col("w._rest").alias("word"), F.col("w._times").alias("times"))
    distinct = rest.select("word").distinct()
    learned = model.words.select(F.col("entry").alias("word"), "counts").hint("shuffle_hash")
    met = stored(distinct.join(learned, "word", "left"), "language-met")
    unseen = met.where("counts is null").select("word")
    vectors = met.where("counts is not null").select("word", model.vector(0, F.col("counts")).alias("v"), F.lit(True).alias("learned"))
    if not unseen.isEmpty():
        vectors = vectors.unionByName(backed_off(unseen, model).withColumn("learned", F.lit(False)))
    # Words outside the table are rare, so no word's rows are many; a row's are summed before they are sent.
    sums = [F.sum(F.col("times") * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]
    others = rest.join(vectors.hint("shuffle_hash"), "word").groupBy("_row").agg(*sums, F.sum(F.when(~F.col("learned"), F.col("times"))).alias("_new")).select("_row", F.array(*[f"s{i}" for i in range(width)]).alias("_more"), "_new")
    whole = rows.drop("_rest", "_times").join(others, "_row", "left")
    total = F.zip_with("_sum", F.coalesce("_more", F.array_repeat(F.lit(0.0), width)), lambda a, b: a + b)
    whole = whole.withColumn("_total", total).withColumn("_best", F.array_max("_total"))
    spread = F.aggregate("_total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_best")))
    name = F.get(F.array(*map(F.lit, model.langs)), (F.array_position("_total", F.col("_best")) - 1).cast("int"))
    heard = F.col("_words") > 0
    return whole.select(*keep, F.when(heard, name).otherwise(UNDETERMINED).alias("lang_pred"), F.when(heard, 1 / spread).otherwise(0.0).alias("score"), F.when(heard, 1 - F.coalesce("_new", F.lit(0)) / F.col("_words")).otherwise(0.0).alias("known"))
