"""Frames of seekable files: places, overlaps with byte ranges, and the frame of an offset."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.blocks import zstd_frame, zstd_frames
from ..sources.files import _open
from .index import nearest_before

_PLACES = ("compressed_offset", "compressed_size", "decompressed_offset", "decompressed_size")


def frame_table(frames: DataFrame) -> DataFrame:
    """``file_id, frame`` and sizes to places: prefix sums of the compressed and plain sizes."""
    before = Window.partitionBy("file_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return frames.select("file_id", "frame", start("compressed_size").alias("compressed_offset"), "compressed_size", start("decompressed_size").alias("decompressed_offset"), "decompressed_size")


def overlapping(table: DataFrame, ranges: DataFrame, bucket: int = 1 << 24) -> DataFrame:
    """Frames that hold a byte of a range (``file_id, low, high``, ``high`` excluded).

    Both meet by file and bucket of bytes, each pair in the first bucket that they
    share; so the work follows the overlaps, however many frames a file has.
    """
    end = F.col("decompressed_offset") + F.col("decompressed_size")
    of = lambda c: F.floor(c / bucket)
    spread = lambda df, low, high: df.withColumn("__bucket", F.explode(F.sequence(of(low), of(F.greatest(high - 1, low)))))
    frames = spread(table.select("file_id", "frame", "decompressed_offset", "decompressed_size"), F.col("decompressed_offset"), end)
    asked = spread(ranges.select("file_id", "low", "high"), F.col("low"), F.col("high"))
    both = asked.join(frames, ["file_id", "__bucket"]).filter((F.col("decompressed_offset") < F.col("high")) & (end > F.col("low")))
    return both.filter(F.col("__bucket") == F.greatest(of(F.col("low")), of(F.col("decompressed_offset")))).select("file_id", "low", "high", "frame")


def locate(table: DataFrame, offsets: DataFrame, bucket: int = 1 << 26) -> DataFrame:
    """The frame that holds each offset (``file_id, offset``), and the offset within it: an as-of join by buckets of offsets."""
    places = table.select("file_id", "frame", "decompressed_offset")
    found = nearest_before(offsets, places, "offset", "decompressed_offset", bucket)
    return found.select("file_id", "offset", F.col("found.frame").alias("frame"), (F.col("offset") - F.col("found.decompressed_offset")).alias("within"))


def frames_with_matches(located: DataFrame) -> DataFrame:
    return located.groupBy("file_id").agg(F.array_sort(F.collect_set("frame")).alias("frames"))


def of_files(files: DataFrame, root: str) -> DataFrame:
    """``file_id, frame`` and places and sizes of the frames of seekable files (``file_id``, a path below ``root``), by the table at each file's end; others give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(root)
        for batch in batches:
            for path in batch.column("file_id").to_pylist():
                with fs.open_input_file(path) as raw:
                    found = zstd_frames(raw, raw.size())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array(range(len(found)), pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*found))], ["file_id", "frame", *_PLACES])

    return files.select("file_id").mapInArrow(run, f"file_id string, frame int, {', '.join(f'{p} long' for p in _PLACES)}")


def content(spots: DataFrame, root: str) -> DataFrame:
    """``file_id, frame, content``: the plain bytes of frames (rows of ``of_files``); each is read at its own place."""
    return spots.mapInArrow(_reading(root, lambda plain: (pa.array([plain], pa.binary()),), ("content",)), "file_id string, frame int, content binary")


def line_counts(spots: DataFrame, root: str) -> DataFrame:
    """``file_id, frame, lines``: line feeds in frames, which no bytes leave their task for."""
    return spots.mapInArrow(_reading(root, lambda plain: (pa.array([plain.count(b"\n")], pa.int64()),), ("lines",)), "file_id string, frame int, lines long")


def _reading(root: str, made, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(root)
        held, raw = None, None
        try:
            for batch in batches:
                for k, (path, at, size, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file_id", "compressed_offset", "compressed_size", "decompressed_size")))):
                    if path != held:
                        if raw is not None:
                            raw.close()
                        held, raw = path, fs.open_input_file(path)
                    raw.seek(at)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in ("file_id", "frame")), *made(zstd_frame(raw.read(size), n, 0))], ["file_id", "frame", *names])
        finally:
            if raw is not None:
                raw.close()

    return run
