"""Kept results as Parquet tables: indexes by path, size and time; matches by pattern hash as well."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import PatternSet
from ..functions.text import patterns_hash
from ..sources.files import read_lines
from . import seek, trace
from .stored import kept as kept_table

VERSION = 2
SOURCE = ["path", "size", "mtime"]


def save_index(index: DataFrame, path: str) -> None:
    """Adds indexes to those that are kept; Spark's commit keeps half-written ones out."""
    index.withColumns({"kept_at": F.current_timestamp(), "deleted": F.lit(False)}).write.mode("append").option("mergeSchema", "true").parquet(path)


def _latest(spark: SparkSession, path: str) -> DataFrame:
    """The last row that was kept of each state of a file, deleted ones left out."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    last = rows.groupBy(*SOURCE).agg(F.max_by(F.struct("*"), "kept_at").alias("r"))
    return last.select("r.*").filter("not deleted").drop("deleted")


def load_index(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Kept indexes of files that haven't changed since."""
    return _latest(spark, path).join(files.select(*SOURCE), SOURCE, "left_semi")


def delete_index(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Drop the kept indexes of files (``path``); gives the paths that had one.

    A row that says so is added, since stores only add or replace whole files.
    """
    gone = spark.createDataFrame(_latest(spark, path).join(files.select("path"), "path", "left_semi").select(*SOURCE).collect(), _latest(spark, path).select(*SOURCE).schema)
    gone.withColumns({"kept_at": F.current_timestamp(), "deleted": F.lit(True)}).write.mode("append").parquet(path)
    return gone.select("path").distinct()


def index_info(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """What is kept of each file: ``path, size, kept_at, analyzed, line_count, index_entries``; nulls where nothing is."""
    kept = load_index(spark, path, files).select("path", "kept_at", "analyzed", "line_count", F.size("line_index").alias("index_entries"))
    return files.select("path", "size").join(kept, "path", "left")


def to_build(files: DataFrame, kept: DataFrame, analyze: bool = False, force: bool = False) -> DataFrame:
    """Files that need an index: none kept, changed, or kept without anomalies where these are wanted."""
    if force:
        return files
    good = kept.filter("analyzed") if analyze else kept
    return files.join(good.select(*SOURCE), SOURCE, "left_anti")


def save_matches(found: DataFrame, path: str, patterns: list[str], flags: list[str]) -> None:
    """Matches of a search that wasn't cut short, by file and offset, with the text of their pattern."""
    kept = found.withColumns({"patterns_hash": patterns_hash(patterns, flags), "version": F.lit(VERSION)})
    kept.write.mode("append").partitionBy("patterns_hash").parquet(path)


def search(spark: SparkSession, path: str, files: DataFrame, patterns: PatternSet, cache: str) -> DataFrame:
    """``trace.matches`` of ``files`` (``path, size, mtime``) below ``path``; what was searched before comes from ``cache``.

    Kept are the places of matches only, and which files were searched, those
    without a match too; lines are read again at their places.  Files that
    changed since are searched anew.
    """
    wanted = files.select(*SOURCE).withColumn("patterns_hash", patterns_hash(list(patterns.patterns), list(patterns.flags)))
    order = {p: k for k, p in enumerate(patterns.patterns)}  # the hash doesn't hang on the order
    try:
        searched = spark.read.parquet(f"{cache}/searched")
        known, new = hits(wanted, searched), misses(wanted, searched)
    except AnalysisException:
        known, new = wanted.limit(0), wanted
    new = kept_table(new)
    if not new.isEmpty():
        lines = read_lines(spark, path).join(new.select(F.col("path").alias("file_id")), "file_id", "left_semi")
        found = trace.matches(lines, patterns, with_submatches=False).join(new.withColumnRenamed("path", "file_id"), "file_id")
        text = F.create_map(*[F.lit(x) for kv in zip(patterns.ids, patterns.patterns) for x in kv])[F.col("pattern_id")]
        rows = found.select(F.col("file_id").alias("path"), "size", "mtime", "patterns_hash", text.alias("pattern"), "offset", "line_number")
        rows.write.mode("append").parquet(f"{cache}/matches")
        new.write.mode("append").parquet(f"{cache}/searched")
    now = known.unionByName(new)
    number = F.create_map(*[F.lit(x) for p, k in order.items() for x in (p, f"p{k + 1}")])[F.col("pattern")]
    places = spark.read.parquet(f"{cache}/matches").join(now, ["patterns_hash", *SOURCE], "left_semi").distinct()
    read = seek.reconstruct(places.select(number.alias("pattern_id"), F.col("path").alias("file_id"), "offset", "line_number"), path)
    return read.select("pattern_id", "file_id", "offset", "line_number", "line_text").withColumn("submatches", trace.submatches(F.col("line_text"), patterns.combined))


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (``patterns_hash`` and a source) that are kept: same hash, size and time."""
    return requests.join(cache.select("patterns_hash", *SOURCE), ["patterns_hash", *SOURCE], "left_semi")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("patterns_hash", *SOURCE), ["patterns_hash", *SOURCE], "left_anti")


def reconstruct(kept: DataFrame, lines: DataFrame) -> DataFrame:
    """Kept matches (``pattern_id, file_id, offset``) with their lines, by file and offset."""
    return kept.join(lines.select("file_id", F.col("start_offset").alias("offset"), "line_number", F.col("line").alias("line_text")), ["file_id", "offset"])
