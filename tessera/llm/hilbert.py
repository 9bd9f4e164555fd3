"""Sharding along a Hilbert curve through metadata, by DataFrame functions only.

Source, language and size are each quantised at their quantiles (strings in the order of whole strings), the cell's index along a Hilbert curve is found
by a state table, and the rows, sorted by that index, are cut into runs of equal bytes. Neighbours on the curve
are neighbours in every dimension, so the shards' ranges of each dimension stay narrow and files can be pruned.

Sizes are UTF-8 bytes plus 1; a null text has none, so size 1 and checksum 0. Null sources and languages take
the lowest cell. Ties on the curve are ordered by checksum, id and size, so only equal rows can take each
other's place; groups of any size are cut where the bytes ask for it. No rows give no rows. Surplus columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import running, settled

DIMENSIONS = ("source_key", "lang_key", "size")
#: Levels of the curve: each dimension has 2**BITS cells.
BITS = 5
SHARDS = 8


def gray(i: int) -> int:
    return i ^ (i >> 1)


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """For each state and cell of n bits: the cell's place on the curve, and the state inside that cell.

    A state is an entry corner and a direction; entry and exit of the sub-cubes follow the Gray code.
    """
    whole = (1 << n) - 1
    rotated = lambda x, k: ((x << k) | (x >> (n - k))) & whole if (k := k % n) else x
    inverse = {gray(i): i for i in range(1 << n)}
    entry = lambda w: gray(2 * ((w - 1) // 2)) if w else 0
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # trailing ones
    turn = lambda w: 0 if not w else ones(w - 1 if w % 2 == 0 else w) % n
    place, state = [], []
    for s in range((1 << n) * n):
        e, d = divmod(s, n)
        for cell in range(1 << n):
            w = inverse[rotated(cell ^ e, n - (d + 1) % n)]
            place.append(w)
            state.append((e ^ rotated(entry(w), d + 1)) * n + (d + turn(w) + 1) % n)
    return place, state


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """The index of a cell along the Hilbert curve through 2**bits cells in each dimension."""
    n = len(cells)
    place, state = curve_table(n)
    places, states = F.array(*[F.lit(x) for x in place]), F.array(*[F.lit(x) for x in state])

    def step(at: Column, level: Column) -> Column:
        bit = [F.call_function("getbit", c.cast("int"), level).cast("int") * (1 << i) for i, c in enumerate(cells)]
        cell = at["state"] * (1 << n) + sum(bit[1:], bit[0])
        return F.struct(F.get(states, cell).alias("state"), (at["index"] * (1 << n) + F.get(places, cell)).alias("index"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index")), step, lambda at: at["index"])


def below(bounds: list, value: Column) -> Column:
    """How many of the bounds lie below a value."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value)) if bounds else F.lit(0)


def number_cells(df: DataFrame, column: str, cells: int) -> Column:
    """A number's cell: which of its quantiles it lies between. The driver gets cells - 1 bounds."""
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    return below(df.agg(F.percentile_approx(column, shares, 10_000)).first()[0] or [], F.col(column))


def string_cells(df: DataFrame, column: str, cells: int) -> Column:
    """A string's cell: the quantile of the middle of its rows, in the order of whole strings. Distinct values are
    ranked with a distributed sort; the driver gets the last value of each cell. Nulls take cell 0."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    placed = running(counts, [column], {"_before": "_rows"})
    whole = df.count()
    cell = F.expr(f"(_before + (_rows - 1) div 2) * {cells} div {max(1, whole)}")
    ends = sorted((r[1], r[0]) for r in placed.groupBy(cell.alias("_cell")).agg(F.max(column)).collect())
    if not ends:
        return F.lit(0)
    at = F.get(F.array(*[F.lit(c).cast("int") for _, c in ends]), below([v for v, _ in ends[:-1]], F.col(column)))
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(at)


def sharded(docs: DataFrame, *, shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col(source_col).cast("string").alias("source_key"), F.col(lang_col).cast("string").alias("lang_key")))
    cells = {c: (number_cells if c == "size" else string_cells)(rows, c, 1 << bits) for c in DIMENSIONS}
    placed = rows.withColumns({f"{c}_cell": cell for c, cell in cells.items()})
    placed = placed.select("doc_id", "size", "text_crc32", curve_index([F.col(f"{c}_cell") for c in DIMENSIONS], bits).alias("curve"))
    ordered = running(placed, ["curve", "text_crc32", "doc_id", "size"], {"before": "size"})
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    # A row belongs to the shard that holds its middle byte.
    shard = F.least(F.floor((2 * F.col("before") + F.col("size")) * F.lit(shards) / F.lit(2 * total)), F.lit(shards - 1)).cast("int")
    cut = settled(ordered.withColumn("shard", shard))
    starts = cut.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # a row for each shard
    return cut.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
