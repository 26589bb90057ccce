"""Search over a stream of lines: the batch expressions, which keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import PatternSet
from ..operators.trace import matches


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that arrive in a folder, by file; Spark's text source gives neither numbers nor offsets."""
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").load(path)
    empty = F.lit(None).cast("long")
    return lines.select(F.col("_metadata.file_path").alias("file_id"), empty.alias("line_number"), empty.alias("start_offset"), empty.alias("end_offset"), F.col("value").alias("line"))


def trace(lines: DataFrame, patterns: PatternSet) -> DataFrame:
    """Matches as they arrive; the same rows as in batch."""
    return matches(lines, patterns)


def counts(found: DataFrame, time: str, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Matches by pattern and event-time window; rows later than ``late`` are left out."""
    return found.withWatermark(time, late).groupBy(F.window(time, every), "pattern_id").agg(F.count("*").alias("n"))
