"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and read from the checkpoint folder from then on.

    A cluster names that folder in ``spark.checkpoint.dir``; only on a single
    machine is a local one set where that is unset.  Spark removes the files with
    the last reference to the table where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/loglattice-kept")
    return df.checkpoint()
