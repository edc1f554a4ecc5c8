"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and driver and
    executors are one process (tests) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="turnstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, f"t-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame, sweep: bool = True) -> None:
    """Delete tables that stored() wrote and that nothing reads any more. sweep: let Spark drop the shuffles behind them, too."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._stored_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    if tables and sweep:
        gc.collect()
        if TRIM is not None:
            TRIM(0)
        tables[0].sparkSession._jvm.System.gc()  # shuffle files go when the driver collects what refers to them


#: Rows of some numbers or keys up to which they are broadcast (some 20 MB in memory); beyond, they are joined by shuffle.
MOST_NAMED = 250_000


def few(names: DataFrame) -> DataFrame:
    """names for a join, broadcast if counting shows them to be few."""
    return F.broadcast(names) if names.limit(MOST_NAMED + 1).count() <= MOST_NAMED else names


#: Rows of an Arrow batch: texts may be long, and a batch is held whole on both sides.
BATCH_ROWS = 512


def small_batches(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def key_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator needs; a null text counts as empty."""
    small_batches(df)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], most_mb: float = 2.0) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that size, so that what is made of a batch stays small. At the end the worker gives back what it no longer needs: it lives on for other tasks."""
    try:
        for b in batches:
            step = max(1, int(b.num_rows * most_mb * 1e6 / max(b.nbytes, 1)))
            for k in range(0, b.num_rows, step):
                yield b.slice(k, step)
    finally:
        b = None
        pa.default_memory_pool().release_unused()
        if TRIM is not None:
            TRIM(0)


#: Of the GNU C library: hands unused memory back to the system.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.empty(0, np.uint8)
    return raw, offs - (offs[0] if n else 0)
