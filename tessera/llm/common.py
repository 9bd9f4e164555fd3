"""What the training-data operators share: shared storage, whole-text words, ordered prefix sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Bytes of one Arrow batch sent to a Python worker, so that long texts cannot make a batch large.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at a time by bytes, besides the bound by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_text(docs: DataFrame, keep: Sequence[str], text_col: str) -> tuple[DataFrame, str]:
    """The columns of ``keep`` and the text, sent to workers once, and the name that the text has there."""
    if text_col in keep:
        return docs.select(*keep), text_col
    return docs.select(*keep, docs[text_col].alias("_text")), "_text"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: spark.checkpoint.dir.

    Only where that is unset, on a local master, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, written to the shared folder by checkpoint()."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a Parquet table written to the shared folder: compact, for wide rows."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing reads any more, whatever the storage is."""
    for df in tables:
        jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(context.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, without building an array of them for each lambda call."""
    return F.size(words_of(text)).cast("long")


def crc_of_id(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Adds to each row its 0-based rank and exclusive prefix sums in a global order, without a single-task window.

    Rows are range-partitioned by ``by`` and ``order``; each range is summed, the few sums of ranges become
    offsets, and a window inside each range finishes the job. ``sums`` maps new columns to summed columns;
    ``rank`` is always added. Ranks and sums start anew for each value of ``by``. Rows that tie in all of
    ``order`` may take each other's place, so callers order by enough columns for ties to be interchangeable.
    """
    keys = [*by, *order]
    n = shuffle_partitions(df.sparkSession)
    # The checkpoint fixes which row lies in which range: a second evaluation could sample other bounds.
    ranged = settled(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    added = {"rank": F.count(F.lit(1)), **{k: F.coalesce(F.sum(v), F.lit(0)) for k, v in sums.items()}}
    # One row for each range and group: bounded by ranges plus groups.
    totals = ranged.groupBy("_range", *by).agg(*[v.alias(f"_{k}") for k, v in added.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_range").alias("_of_range"), *[F.col(c).alias(f"_of_{c}") for c in by], *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in added])
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = {"rank": F.count(F.lit(1)).over(inside), **{k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}}
    here = ranged.select("*", *[v.alias(k) for k, v in near.items()])
    same = F.col("_range") == F.col("_of_range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return here.join(offsets, same, "left").select(*df.columns, *[(F.col(k) + F.coalesce(F.col(f"_{k}"), F.lit(0))).alias(k) for k in added])
