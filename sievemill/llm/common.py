"""Pieces shared by the training-data operators: input cleaning, planning of partitions, and checkpoints."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import itertools
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_serial = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark's own reader so that any file system will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty), whatever other columns the input carries."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null stays null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir was given.

    In local mode, where driver and executors are one process, a temporary folder will do, which goes with the process;
    on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="sievemill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint(spark: SparkSession, df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation from the start."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=eager)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def hand_back() -> None:
    """Give memory that Arrow and the C library hold for later use back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        return


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``mapInArrow`` with small batches, by a function that hands memory back when it is done."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(tidied, schema)


#: What Spark sets unless told otherwise, and what a batch of texts is held to then: each task has several at once.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT_BATCH, _SMALL_BATCH = "67108864b", "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers in this session, unless it has a bound of its own."""
    if spark.conf.get(_BATCH_BYTES, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH_BYTES, _SMALL_BATCH)


def release(spark: SparkSession) -> None:
    """Free what finished steps hold: Spark deletes their shuffle files once their plans are garbage, and a collection on
    the executors lets their heaps shrink before Python workers need the room."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        n = spark.sparkContext.defaultParallelism
        collected = spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done"))
        collected.write.format("noop").mode("overwrite").save()
