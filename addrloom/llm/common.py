"""Shared pieces of the training-data operators: shared-folder tables and skew-safe lookups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Rows a broadcast of hot keys may hold; every other key has at most 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
#: Documents in an Arrow batch; the default of 10,000 holds some 30 to 60 MB on both sides of each task.
TEXT_ROWS = 2000
#: Rows of some longs that are broadcast: about 100 MB.
SMALL = 2_000_000
#: Slots over which the rows of a hot key are spread.
HOT_SLOTS = 4096


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset, a local one in local mode (one machine), an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="addrloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/addrloom/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` once in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Removes tables of write_table that nothing reads any more: what was made of them is itself written."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame) -> DataFrame:
    """``table`` (a written one of a few longs a row), to be broadcast if it has SMALL rows at most; otherwise the join shuffles."""
    return F.broadcast(table) if table.count() <= SMALL else table


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, row_id: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per key), safe when a few keys hold most rows.

    The ``HOT_KEYS`` keys with the largest ``count`` are broadcast: by construction a bounded number of
    rows. Their rows never meet in the shuffle join, since a slot drawn from ``row_id`` is part of the
    join key and the table only has slot 0. ``table`` should be a written table: it is read twice.
    Keys must not be null. The columns of ``table`` that aren't keys are added, null where no key fits.
    """
    values = [c for c in table.columns if c not in keys]
    hot = table.orderBy(F.col(count).desc(), *keys).limit(HOT_KEYS).select(
        *[F.col(k).alias(f"_hk_{k}") for k in keys], F.struct(*values).alias("_hot")
    )
    on_hot = [F.col(k) == F.col(f"_hk_{k}") for k in keys]
    cold = table.select(*[F.col(k).alias(f"_ck_{k}") for k in keys], F.lit(0).alias("_ck_slot"), F.struct(*values).alias("_cold"))
    slot = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*row_id), F.lit(HOT_SLOTS)).cast("int") + 1)
    joined = rows.join(F.broadcast(hot), on_hot, "left").withColumn("_slot", slot)
    joined = joined.join(cold, [F.col(k) == F.col(f"_ck_{k}") for k in keys] + [F.col("_slot") == F.col("_ck_slot")], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])


def text_batches(spark: SparkSession) -> None:
    """Lets Python workers get TEXT_ROWS rows at a time from now on, unless the session asks for fewer: documents are long rows."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= TEXT_ROWS:
        spark.conf.set(rows, str(TEXT_ROWS))


def freed(run: Callable) -> Callable:
    """``run`` of mapInArrow; after a task's last batch what its worker no longer uses goes back to the system.

    Workers are used again by the tasks of later stages, and what allocators hold back adds up beside these.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def n_words(text: Column) -> Column:
    """Number of words; 0 for null. Counts word starts, without building an array of the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def hidden(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns under names of their own, so that none can clash, and the needed ones beside them; and the way back."""
    own = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)], *[F.col(c).alias(f"_need_{c}") for c in needed])
    return own, [F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)]


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one row for each ``root`` of ``found`` (doc_id, th, root of every row): the smallest doc_id, null last, then text hash.

    Rows that repeat in doc_id and text are one. Where the rows to remove are few enough to be broadcast, texts don't
    move; otherwise they move once: the join and the choice among repeated rows share a partitioning.
    """
    key = ["_id", "_none", "_th"]
    rows = found.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("th").alias("_th"), "root")
    rows = write_table(rows.groupBy(*key, "root").agg(F.count("*").alias("n")), "keys")
    best = rows.groupBy("root").agg(F.min(F.struct("_none", "_id", "_th")).alias("k")).select("k._id", "k._none", "k._th")
    own, names = hidden(docs, "doc_id", "text")
    own = own.withColumns({"_id": F.coalesce(F.col("_need_doc_id").cast("bigint"), F.lit(0)), "_none": F.col("_need_doc_id").isNull(), "_th": F.xxhash64("_need_text")})
    own = own.drop("_need_doc_id", "_need_text")
    gone = write_table(rows.join(best, key, "left_anti").select(*key), "removed-keys")
    again = rows.where("n > 1").join(best, key, "left_semi").select(*key)
    if gone.count() + (n := again.count()) > SMALL:
        return own.join(best, key, "left_semi").dropDuplicates(key).select(*names)
    left = own.join(F.broadcast(gone), key, "left_anti")
    if n:
        again = F.broadcast(write_table(again, "repeated-keys"))
        left = left.join(again, key, "left_anti").union(left.join(again, key, "left_semi").dropDuplicates(key))
    return left.select(*names)
