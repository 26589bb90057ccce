"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words everywhere in this package.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows that Spark sends to a Python worker at once.
BATCH_ROWS = 2_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``; only on a single machine
    (tests) is a local folder set where that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
    context.setCheckpointDir(f"{tempfile.gettempdir()}/loglattice-shared")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage: what follows survives the loss of any executor, because the
    rows are read from the shared folder and not from shuffle files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Free the disk of a table that ``write_shared`` gave and nothing reads any more.

    An empty table takes its place, written by Spark, since only Spark reaches
    every kind of store.
    """
    files = df.inputFiles()
    if files:
        folder = files[0].rpartition("/")[0]
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(folder)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs soon.

    Spark drops them once the driver has collected their handles as garbage,
    and offers nothing to ask for that.  Events of the last job may hold them a
    little longer, hence the second round.  Where the driver can't be reached
    this way (Spark Connect) the files only stay longer.
    """
    import gc
    import time

    jvm = getattr(getattr(spark, "_sc", None), "_jvm", None)
    for _ in range(2 if jvm is not None else 0):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.4)


def give_back() -> None:
    """What this process has freed goes back to the system, since Spark keeps Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows in an Arrow batch of this session, since each row holds a whole text; a lower number stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int, field: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` bytes in ``column``, or in a ``field`` of that struct.

    What Arrow holds free is given back after each batch, and all that is free
    after the last one.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column) if field is None else batch.column(column).field(field).cast(pa.string())
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        del texts
        group = (np.cumsum(size.astype(np.int64)) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch
        pa.default_memory_pool().release_unused()
    give_back()


def text_of(df: DataFrame, text_col: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))
