"""Helpers that the operators of this subpackage share: table access, the shared folder, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the controls 9 to 13. A Java and RE2 pattern for one word.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when a count shows it has no more rows than this; rows are narrow (ids).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``, or the one that the session has.

    Where neither is set, a local session (tests) gets a folder of its own, as driver and executors are one process; on a
    cluster that is an error, as a machine-local folder would lose rows.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessellar-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Collect the driver's garbage, upon which Spark removes the shuffle files and checkpoints of plans that were cut."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text that isn't null."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def doc_crc(name: str = "doc_id") -> Column:
    """crc32 of the id as text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(0))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, with a broadcast hint if its counted rows stay within the bound; else it is left to a shuffled join.

    ``df`` should be cut before, as it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the system at its end: Python workers stay and are used again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if give_back:
                give_back(0)

    return run
