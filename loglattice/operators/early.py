"""The first matches in the order of files, without reading on once there are enough.

Splits stand in the order of the files' names and bytes.  They are searched in
waves, each a job over some splits, twice as many as before: all matches of a
wave stand before those of all later ones, so the search ends with the wave in
which the wanted number is reached.  A task leaves a split as soon as it alone
has given that many.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import PatternSet
from ..sources import files
from .stored import kept
from .trace import matches, ordered, submatches

SPLIT = 64 << 20


class First(NamedTuple):
    rows: DataFrame
    splits_read: int
    splits: int


def _at_most(most: int):
    """The first rows of a task's input; what lies behind them isn't asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = most
        for batch in batches:
            yield batch.slice(0, left)
            left -= batch.num_rows
            if left <= 0:
                return

    return run


def first_matches(spark: SparkSession, path: str, patterns: PatternSet, most: int, split_bytes: int = SPLIT, wave: int | None = None, with_submatches: bool = True) -> First:
    """``trace.ordered(trace.matches(...), most)`` of the files below ``path``; and how many splits were read, of how many.

    The first wave has ``wave`` splits (default: one for each core).
    """
    sizes = {f.path: f.size for f in files._listed(path)}
    splits = sorted(files.splits_of(sizes, split_bytes), key=lambda s: (s.path, s.start))
    found, n, at, size = None, 0, 0, max(wave or spark.sparkContext.defaultParallelism, 1)
    while at < len(splits) and n < most:
        some = splits[at : at + size]
        lines = files.read_splits(spark, path, some)
        hits = matches(lines, patterns, with_submatches=False, more=("split",))
        # Lines of a split come in order; so do the patterns of each.
        hits = kept(hits.mapInArrow(_at_most(most), hits.schema))
        n += hits.count()
        found = hits if found is None else found.unionByName(hits)
        at, size = at + len(some), 2 * size
    if found is None:
        return First(matches(files.read_lines(spark, path), patterns, with_submatches).limit(0), 0, 0)
    # What lies before a match in its file has been searched, or its lines can be counted.
    last = {r["file_id"]: r["s"] for r in found.groupBy("file_id").agg(F.max("split").alias("s")).orderBy("file_id").limit(most).collect()}
    before = [s for s in splits[:at] if s.path in last and s.start <= last[s.path] and last[s.path] > 0]
    if before:
        counts = files.split_counts(spark, path, split_bytes, before)
        placed = found.withColumns({"start_offset": F.col("offset"), "end_offset": F.col("offset")})
        found = files.numbered(placed, counts, True).withColumn("offset", F.col("start_offset"))
    out = ordered(found.select("pattern_id", "file_id", "offset", "line_number", "line_text"), most)
    if with_submatches:
        out = out.withColumn("submatches", submatches(F.col("line_text"), patterns.combined))
    return First(out, at, len(splits))
