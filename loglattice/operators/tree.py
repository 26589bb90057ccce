"""Directory listings over a table of files, with what is known of their indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import SOURCE


def listing(files: DataFrame, index: DataFrame) -> DataFrame:
    """Entries (``parent, name, type, path, size, mtime``) with ``is_indexed`` and ``line_count``."""
    known = index.select(*SOURCE, "line_count", F.lit(True).alias("k"))
    return files.join(known, SOURCE, "left").withColumn("is_indexed", F.coalesce("k", F.lit(False))).drop("k")


def in_order(entries: DataFrame) -> DataFrame:
    """Directories first, then names without regard to case."""
    return entries.orderBy("parent", F.col("type") != "directory", F.lower("name"), "name")


def totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("parent").agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count_if(F.col("type") == "directory").alias("n_directories"))
