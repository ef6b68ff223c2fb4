"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one named in ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) is a folder made and set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomtick-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Paths of the tables that ``written`` made and nobody deleted yet.
_made: dict[str, None] = {}


def written(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    ``tidy`` also lets go of the shuffle files of the frames before it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _made[path] = None
    df.write.parquet(path)
    if tidy:  # Spark deletes the shuffle files of frames that are garbage
        gc.collect()
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made, once what was made from them is written too."""
    for df in frames:
        drop_path(df.sparkSession, df.written_to)
        _made.pop(df.written_to, None)


@contextlib.contextmanager
def tables_of(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all tables that ``written`` made inside: for work whose result is written by then."""
    before = set(_made)
    try:
        yield
    finally:
        for path in [p for p in _made if p not in before]:
            drop_path(spark, path)
            del _made[path]


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text (null counts as the empty text)."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bytes of text that Python code takes at a time.
SLICE_BYTES = 1 << 21


def text_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column's bytes stay near ``size`` (a longer value alone is a batch).

    What Python keeps of a text (words, numbers) is many times its size; so memory
    follows the size given here and the longest text, not Spark's batches.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Bytes of an Arrow batch between Spark and Python at most (a longer row alone is a batch).
BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, and workers that give memory back after each task.

    Lowers the session's limit for Arrow batches if it is above ``BATCH_BYTES``.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name, "67108864b").lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(wrapped, schema)
