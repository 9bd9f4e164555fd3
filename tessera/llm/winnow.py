"""Document fingerprints by winnowing, with DataFrame functions only.

Tokens are words; words of scripts that are written without spaces, and words of more than LONG_WORD characters, give
a token for each character. A hash rolls over every k tokens in a row; of each window of w such k-grams the least
hash is chosen, the rightmost of equal ones, and kept with its position. Two texts that share w + k - 1 tokens in a
row share a chosen k-gram.

A text of fewer than k tokens is one k-gram, a text of fewer k-grams than w is one window; null, empty and blank
texts have an empty fingerprint. The likeness of two fingerprints is the Jaccard similarity of their hashes: 1 if
both are empty. Equal texts have equal fingerprints. Rows are ordered by id, null ids last, then by text, so
repeated rows follow one another; the last row is followed by the first, a single row by itself. No rows give no
rows. Surplus columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, words_of

GRAM, WINDOW = 5, 8
#: The hash of tokens t1 to tk is t1 * BASE^(k-1) + ... + tk modulo PRIME, where each t is a hash of a token.
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: K-grams over which a hash rolls before it starts anew, so that no long array is built step by step.
ROLL = 64
LONG_WORD = 32
# Code points of scripts that are written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, Chinese,
# Japanese).
UNSPACED = r"[\u0E00-\u0EFF\u0F00-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3021-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
#: Positions take the low bits of a packed value, counted from the right so that the least is the rightmost.
PLACE_BITS = 31
LAST_PLACE = (1 << PLACE_BITS) - 1
#: Bytes of text in one bucket of neighbours, and the most buckets.
BUCKET_BYTES, BUCKETS = 64 << 20, 10_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value so that the lambdas in the body don't evaluate it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens_of(text: Column) -> Column:
    """Words, and in their place the characters of those that are long or of a script without spaces."""
    apart = lambda w: F.when((F.length(w) > LONG_WORD) | w.rlike(UNSPACED), F.split(w, "")).otherwise(F.array(w))
    # Most texts are told apart from the others by their sizes alone.
    unspaced = (F.octet_length(text) > F.length(text)) & text.rlike(UNSPACED)

    def of(words: Column) -> Column:
        some = F.when(F.exists(words, lambda w: F.length(w) > LONG_WORD), True).otherwise(unspaced)
        return F.when(some, F.filter(F.flatten(F.transform(words, apart)), lambda c: c != "")).otherwise(words)

    return let(words_of(text), of)


def rolled(hashes: Column, k: int) -> Column:
    """The hash of every k tokens in a row; of all of them if they are fewer. Each hash follows from the one before by
    taking a token out on the left and one in on the right; after ROLL of them it starts from its tokens again."""
    high = pow(BASE, k - 1, PRIME)
    size = F.size(hashes)
    into = lambda h, x: (h * BASE + x) % PRIME

    def block(i: Column) -> Column:
        first = F.aggregate(F.slice(hashes, i * ROLL + 1, k), F.lit(0).cast("long"), into)
        last = F.least(i * ROLL + ROLL - 1, F.greatest(size - k, F.lit(0)))

        def step(at: Column, j: Column) -> Column:
            out = (at["h"] + PRIME - F.get(hashes, j - 1) * high % PRIME) % PRIME
            h = into(out, F.get(hashes, j + k - 1))
            return F.struct(h.alias("h"), F.array_append(at["all"], h).alias("all"))

        rest = F.when(last > i * ROLL, F.sequence(i * ROLL + 1, last)).otherwise(F.array().cast("array<int>"))
        return let(first, lambda h: F.aggregate(rest, F.struct(h.alias("h"), F.array(h).alias("all")), step, lambda at: at["all"]))

    blocks = F.sequence(F.lit(0), F.floor(F.greatest(size - k, F.lit(0)) / ROLL).cast("int"))
    return F.flatten(F.transform(blocks, block))


def least_of(values: Column, w: int, then: Callable[[Column], Column]) -> Column:
    """The least value of each w in a row, of all of them if they are fewer, from those of 1, 2, 4 in a row and so on."""
    size = F.size(values)

    def joined(mins: Column, have: int, want: int) -> Column:
        """From the least of each ``have`` in a row, the least of each ``want``, no more than twice as many."""
        n = F.greatest(F.size(mins) - (want - have), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(F.get(mins, i), F.get(mins, i + (want - have))))

    def go(mins: Column, have: int) -> Column:
        want = min(2 * have, w)
        return then(mins) if have == w else let(joined(mins, have, want), lambda m: go(m, want))

    return F.when(size < w, then(F.array(F.array_min(values)))).otherwise(go(values, 1))


def chosen(text: Column, k: int = GRAM, w: int = WINDOW) -> Column:
    """The chosen k-grams in order of position: each a hash of 31 bits over a place counted from the right."""
    packed = lambda grams: F.transform(grams, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(F.lit(LAST_PLACE) - i))
    none = F.array().cast("array<bigint>")

    def of(hashes: Column) -> Column:
        return F.when(F.size(hashes) == 0, none).otherwise(let(packed(rolled(hashes, k)), lambda p: least_of(p, w, F.array_distinct)))

    return let(F.transform(tokens_of(text), lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME))), of)


def hash_of(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def place_of(packed: Column) -> Column:
    return F.lit(LAST_PLACE) - packed.bitwiseAND(F.lit(LAST_PLACE))


def written(fingerprint: Column) -> Column:
    """A fingerprint as text: hash@position, by position."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit("@"), place_of(x).cast("string"))), " ")


def hashes_of(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds _tie, a hash of the text, and _bucket: ranges of (id, _tie) of some BUCKET_BYTES of text each.

    Bounds are quantiles of the ids. An id that takes several quantiles, or null ids, which come first, are cut into
    as many ranges of _tie, so no id makes a bucket too large.
    """
    facts = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.count(id_col).alias("ids")).first()
    n = min(BUCKETS, max(shuffle_partitions(docs.sparkSession), math.ceil(facts["bytes"] / BUCKET_BYTES)))
    of_ids = max(1, round(n * facts["ids"] / max(1, facts["rows"])))
    shares = "array(" + ", ".join(f"{(i + 1) / of_ids:.9f}D" for i in range(of_ids)) + ")"
    found = docs.agg(F.expr(f"percentile_approx({id_col}, {shares}, {max(10_000, 20 * of_ids)})")).first()[0] or []
    times = Counter(found)
    bounds = [(None, t) for t in cuts(max(1, n - of_ids))] + [(i, t) for i in sorted(times) for t in cuts(times[i])]
    # Bounds in groups, to be searched group first; as JSON, which Spark turns into one constant.
    size = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + size] for i in range(0, len(bounds), size)]
    kind = docs.schema[id_col].dataType.simpleString()
    search = lambda rows, at: F.size(F.filter(rows, lambda b: b < at))
    constant = lambda rows, schema: F.from_json(F.lit(json.dumps(rows)), schema)
    named = lambda rows: [{"i": i, "t": t} for i, t in rows]
    own = F.struct(F.col(id_col).alias("i"), F.col("_tie").alias("t"))
    ends = constant(named([g[-1] for g in groups[:-1]]), f"array<struct<i:{kind},t:bigint>>")
    whole = constant([named(g) for g in groups], f"array<array<struct<i:{kind},t:bigint>>>")
    rows = docs.withColumn("_tie", F.xxhash64(text_col)).withColumn("_group", search(ends, own))
    return rows.withColumn("_bucket", F.col("_group") * size + search(F.get(whole, F.col("_group")), own)).drop("_group")


def cuts(n: int) -> list[int]:
    """Upper ends of n equal ranges of 64-bit numbers."""
    return [-(1 << 63) + (i + 1) * (1 << 64) // n - 1 for i in range(n)]


def followed(docs: DataFrame, columns: dict[str, Column], id_col: str, text_col: str) -> DataFrame:
    """Adds ``columns``, and next_<column> for each: that of the next row by descending id, of the first row for the last.

    The first row of each bucket also goes, as a sentinel, behind the bucket that it follows: a row for each bucket.
    """
    rows = bucketed(docs, id_col, text_col)
    order = [F.desc_nulls_last(id_col), F.desc("_tie"), F.desc_nulls_last(text_col)]
    first = rows.groupBy("_bucket").agg(F.max(F.struct(F.col(id_col).alias("i"), F.col("_tie").alias("t"))).alias("m"))
    known = first.select("_bucket", "m.i", "m.t").collect()
    used = sorted(r["_bucket"] for r in known)
    before = dict(zip(used, used[1:] + used[:1], strict=True))  # lower buckets follow higher ones, the highest the lowest
    schema = f"_b int, _i {docs.schema[id_col].dataType.simpleString()}, _t bigint, _to int"
    heads = docs.sparkSession.createDataFrame([(r["_bucket"], r["i"], r["t"], before[r["_bucket"]]) for r in known], schema)
    same = (F.col("_bucket") == F.col("_b")) & F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t"))
    met = rows.join(F.broadcast(heads), same)  # no more rows than buckets
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*order))).where("_n = 1")
    sentinels = met.withColumn("_bucket", F.col("_to")).select(*rows.columns, F.lit(1).alias("_sentinel"))
    every = rows.withColumn("_sentinel", F.lit(0)).unionByName(sentinels).withColumns(columns)
    ahead = Window.partitionBy("_bucket").orderBy("_sentinel", *order)
    return every.select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in columns]).where("_sentinel = 0").drop("_bucket", "_tie", "_sentinel")


def fingerprinted(docs: DataFrame, *, k: int = GRAM, w: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = followed(rows, {"own_text": F.col("text"), "print": chosen(F.col("text"), k, w)}, "doc_id", "text").withColumnRenamed("next_own_text", "next_text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "print", "next_print", let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), chosen(e, k, w).alias("print"))).alias("edited"))
    own = hashes_of(F.col("print"))
    return rows.select("doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), written(F.col("print")).alias("fingerprint"), written(F.col("edited.print")).alias("edited_fingerprint"), let(own, lambda h: likeness(h, hashes_of(F.col("edited.print")))).alias("near_edited"), let(own, lambda h: likeness(h, hashes_of(F.col("next_print")))).alias("near_next"))
