"""Seekable zstandard: frames that end with a line, and the table that says where each lies."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lines import split_lines

# Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
FRAME_BYTES = 4 << 20
LEVEL = 3


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame behind the last frame: compressed and plain size of each."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + FOOTER.pack(len(sizes), 0, FOOTER_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(data: bytes, whole: bool = True) -> list[tuple[int, int, int, int]]:
    """Compressed place and size, plain place and size of each frame; entries with checksums are read too.

    ``data`` ends with the table; the frames before it needn't be ``whole``.
    """
    if len(data) < FOOTER.size:
        raise ValueError("too short for a seek table")
    n, flags, magic = FOOTER.unpack_from(data, len(data) - FOOTER.size)
    width = 12 if flags & 0x80 or flags & 1 else 8
    start = len(data) - FOOTER.size - n * width
    if magic != FOOTER_MAGIC or start < 8 or struct.unpack_from("<I", data, start - 8)[0] != SKIPPABLE_MAGIC:
        raise ValueError("no seek table")
    out, a, b = [], 0, 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", data, start + k * width)
        out.append((a, packed, b, plain))
        a, b = a + packed, b + plain
    return out


def is_seekable(data: bytes) -> bool:
    return len(data) >= FOOTER.size and FOOTER.unpack_from(data, len(data) - FOOTER.size)[2] == FOOTER_MAGIC


def cut_frames(data: bytes, frame_bytes: int = FRAME_BYTES) -> list[bytes]:
    """Pieces of about ``frame_bytes`` that end with a line."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\n", min(at + frame_bytes, len(data)) - 1)
        end = len(data) if end < 0 else end + 1
        out.append(data[at:end])
        at = end
    return out


def encode(files: DataFrame, file_col: str = "path", content_col: str = "content", frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """``file_id, content``: each file's bytes as a seekable zstandard file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            out = []
            for data in batch.column("content").to_pylist():
                plain = cut_frames(data or b"", frame_bytes)
                packed = [press.compress(p) for p in plain]
                out.append(b"".join(packed) + seek_table([(len(a), len(b)) for a, b in zip(packed, plain)]))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(out, pa.binary())], ["file_id", "content"])

    rows = files.select(F.col(file_col).alias("file_id"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInArrow(run, f"file_id {rows.schema['file_id'].dataType.simpleString()}, content binary")


def frames(files: DataFrame) -> DataFrame:
    """``file_id, frame``, places and sizes of all frames of seekable files (``file_id, content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, *f) for k, data in enumerate(batch.column("content").to_pylist()) for n, f in enumerate(read_seek_table(data))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("file_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["file_id", "frame", "compressed_offset", "compressed_size", "decompressed_offset", "decompressed_size"])

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInArrow(run, f"file_id {kind}, frame int, compressed_offset long, compressed_size long, decompressed_offset long, decompressed_size long")


def decode(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``file_id, frame, content``: the plain bytes of frames by number (``wanted``: ``file_id, frame``) of seekable files (``file_id, content``)."""
    spots = frames(files).join(wanted.select("file_id", "frame").distinct(), ["file_id", "frame"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            out = [plain.decompress(x, max_output_size=max(n, 1)) for x, n in zip(batch.column("packed").to_pylist(), batch.column("decompressed_size").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("frame"), pa.array(out, pa.binary())], ["file_id", "frame", "content"])

    # Only a frame's own bytes leave the file's row.
    packed = spots.join(files.select("file_id", F.col("content").alias("__all")), "file_id").select("file_id", "frame", "decompressed_size", F.substring("__all", F.col("compressed_offset").cast("int") + 1, F.col("compressed_size").cast("int")).alias("packed"))
    kind = files.schema["file_id"].dataType.simpleString()
    return packed.mapInArrow(run, f"file_id {kind}, frame int, content binary")


def frame_line_counts(files: DataFrame) -> DataFrame:
    """``file_id, frame, lines``: line feeds in each frame of seekable files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.count(b"\n") for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("frame"), pa.array(found, pa.int64())], ["file_id", "frame", "lines"])

    kind = files.schema["file_id"].dataType.simpleString()
    return decode(files, frames(files)).mapInArrow(run, f"file_id {kind}, frame int, lines long")


def decode_range(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """``file_id, low, high, content``: plain bytes from ``low`` to ``high``, excluded, of each range (``file_id, low, high``), by the frames that overlap it."""
    from ..operators.frames import overlapping

    table = frames(files)
    end = F.col("decompressed_offset") + F.col("decompressed_size")
    spots = overlapping(table, ranges.select("file_id", "low", "high").distinct()).join(table, ["file_id", "frame"])
    whole = decode(files, spots).withColumnRenamed("content", "plain")
    from_ = F.greatest(F.lit(0), F.col("low") - F.col("decompressed_offset"))
    upto = F.least(F.col("high"), end) - F.col("decompressed_offset")
    part = F.substring("plain", from_.cast("int") + 1, (upto - from_).cast("int"))
    cut = spots.join(whole, ["file_id", "frame"]).select("file_id", "low", "high", F.struct("frame", part.alias("part")).alias("p"))
    parts = cut.groupBy("file_id", "low", "high").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("file_id", "low", "high", F.aggregate("p.part", F.lit(b""), lambda a, x: F.concat(a, x)).alias("content"))


def frame_lines(files: DataFrame) -> DataFrame:
    """Lines of seekable files, one frame at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, data in enumerate(batch.column("content").to_pylist()):
                number = 0
                for a, size, b, _ in read_seek_table(data):
                    text = plain.decompress(data[a : a + size]).decode("utf-8", "replace")
                    _, n, start, end, line = split_lines(pa.array([text], pa.large_string()))
                    yield pa.RecordBatch.from_arrays([batch.column("file_id").take(pa.array([k] * len(n), pa.int64())), pa.array(n + number), pa.array(start + b), pa.array(end + b), line.cast(pa.string())], ["file_id", "line_number", "start_offset", "end_offset", "line"])
                    number += len(n)

    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInArrow(run, f"file_id {kind}, line_number long, start_offset long, end_offset long, line string")
