"""Files as sources: listing, formats, byte-range reading, compressed streams."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blocks import BlockStream, BzBlocks, xz_blocks, zstd_frame, zstd_frames
from .lines import COLUMNS, split_lines

MIN_CHUNK = 20 << 20
MAX_CHUNKS = 20
TEXT_PROBE = 8192
BLOCK = 4 << 20
#: Splits whose line counts are sent to all tasks; those of more are joined by a shuffle.
MOST_SENT_SPLITS = 100_000

# File name endings and first bytes of the formats.
SUFFIXES = {".gz": "gzip", ".gzip": "gzip", ".zst": "zstd", ".zstd": "zstd", ".xz": "xz", ".bz2": "bz2", ".bzip2": "bz2"}
COMPOUND = (".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".tar.zst", ".tzst")
MAGIC = {"1F8B": "gzip", "28B52FFD": "zstd", "FD377A585A00": "xz", "425A68": "bz2"}


def format_of(path: Column, head: Column | None = None) -> Column:
    """``gzip, zstd, xz, bz2`` or an empty string; archives of several files count as none."""
    name = F.lower(path)
    out = F.when(name.rlike("|".join(s.replace(".", r"\.") + "$" for s in COMPOUND)), F.lit(""))
    for suffix, kind in SUFFIXES.items():
        out = out.when(name.endswith(suffix), F.lit(kind))
    if head is not None:
        first = F.hex(F.substring(head, 1, 6))
        for magic, kind in MAGIC.items():
            out = out.when(first.startswith(magic), F.lit(kind))
    return out.otherwise("")


def is_text(head: Column, kind: Column, probe: int = TEXT_PROBE) -> Column:
    """Compressed files count as text; others if their first ``probe`` bytes have no NUL."""
    return (kind != "") | ~F.hex(F.substring(head, 1, probe)).rlike("^(?:..)*?00")


def chunk_count(size: Column, min_chunk: int = MIN_CHUNK, most: int = MAX_CHUNKS) -> Column:
    """Chunks that a file is cut into: ``size / min_chunk``, at least 1 and at most ``most``."""
    return F.greatest(F.lit(1), F.least(F.floor(size / min_chunk), F.lit(most))).cast("long")


def catalog(spark: SparkSession, path: str, recursive: bool = True, probe: int = TEXT_PROBE) -> DataFrame:
    """``path, size, mtime, format, text``: the files below a path; of each only the first bytes are read.

    A file that can't be read has a null ``text``.
    """
    spark.dataSource.register(FileHeads)
    read = spark.read.format("fileheads").option("recursive", str(recursive).lower()).load(path)
    kind = format_of(F.col("path"), F.col("head"))
    return read.select("path", "size", "mtime", kind.alias("format"), F.when(F.col("head").isNotNull(), is_text(F.col("head"), kind, probe)).alias("text"))


def skipped(files: DataFrame) -> DataFrame:
    """``path, reason`` of the files of a catalog whose lines aren't read."""
    reason = F.when(F.col("text").isNull(), "unreadable").when(~F.col("text"), "binary")
    return files.select("path", reason.alias("reason")).filter("reason is not null")


def decompressed(stream: io.RawIOBase, kind: str):
    """A reader of the plain bytes; concatenated members and frames are read through."""
    if kind == "gzip":
        return gzip.GzipFile(fileobj=stream)
    if kind == "bz2":
        return bz2.BZ2File(stream)
    if kind == "xz":
        return lzma.LZMAFile(stream)
    if kind == "zstd":
        return zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    return stream


def kind_of(path: str, head: bytes = b"") -> str:
    """The format by name, else by first bytes; archives of several files count as none."""
    name = path.lower()
    if name.endswith(COMPOUND):
        return ""
    by_name = next((k for s, k in SUFFIXES.items() if name.endswith(s)), "")
    return by_name or next((k for m, k in MAGIC.items() if head.startswith(bytes.fromhex(m))), "")


def _open(path: str):
    if "://" in path:
        fs, inner = pafs.FileSystem.from_uri(path)
    else:
        fs, inner = pafs.LocalFileSystem(), os.path.abspath(path)
    return fs, inner


def _listed(path: str, recursive: bool = True) -> list[pafs.FileInfo]:
    fs, inner = _open(path)
    info = fs.get_file_info(inner)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(inner, recursive=recursive))
    return sorted((f for f in found if f.is_file), key=lambda f: f.path)


class _Some(InputPartition):
    def __init__(self, files: list[tuple]) -> None:
        self.files = files


class _HeadReader(DataSourceReader):
    """Files by hundreds, each opened for its first bytes."""

    def __init__(self, path: str, recursive: bool) -> None:
        self.path, self.recursive = path, recursive

    def partitions(self) -> list[_Some]:
        found = [(f.path, f.size, f.mtime_ns or 0) for f in _listed(self.path, self.recursive)]
        return [_Some(found[a : a + 100]) for a in range(0, max(1, len(found)), 100)]

    def read(self, part: _Some) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        heads = []
        for path, _, _ in part.files:
            try:
                with fs.open_input_file(path) as f:
                    heads.append(f.read(TEXT_PROBE))
            except OSError:
                heads.append(None)
        paths, sizes, times = zip(*part.files) if part.files else ((), (), ())
        moment = pa.timestamp("us", "UTC")
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array([t // 1000 for t in times], pa.int64()).cast(moment), pa.array(heads, pa.binary())], ["path", "size", "mtime", "head"])


class FileHeads(DataSource):
    """``spark.read.format("fileheads").load(path)``: files with their first bytes (null: unreadable)."""

    @classmethod
    def name(cls) -> str:
        return "fileheads"

    def schema(self) -> str:
        return "path string, size long, mtime timestamp, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(self.options["path"], self.options.get("recursive", "true") == "true")


def opened(raw, path: str, size: int) -> tuple[str | None, object, list | None]:
    """The format, None for a binary file; a reader of its plain bytes, and the blocks that these lie in where each can be read by itself."""
    head = raw.read(TEXT_PROBE)
    kind = kind_of(path, head)
    if not kind and b"\0" in head:
        return None, raw, None
    raw.seek(0)
    if kind == "zstd" and (frames := zstd_frames(raw, size)) is not None:
        return kind, BlockStream(raw, frames, zstd_frame), frames
    if kind == "xz" and (found := xz_blocks(raw, size)) is not None:
        blocks, decode = found
        return kind, BlockStream(raw, blocks, decode), blocks
    raw.seek(0)
    return kind, raw if not kind else decompressed(raw, kind), None


class _Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int, first: int = 1) -> None:
        self.path, self.start, self.stop, self.size, self.first = path, start, stop, size, first


def _addressed(path: str, split: int, first: int, data: bytes, start: int, stop: int | None) -> tuple[pa.RecordBatch, int]:
    """The lines of ``data``, which lies at ``start``, that begin before ``stop``; and how many it has in all."""
    text = data.decode("utf-8", "replace")
    _, n, a, b, lines = split_lines(pa.array([text], pa.large_string()))
    if len(text.encode()) != len(data):  # not UTF-8: offsets from the bytes
        pieces = data.split(b"\n")
        pieces = pieces[:-1] if not pieces[-1] else pieces
        b = np.minimum(np.cumsum([len(p) + 1 for p in pieces]), len(data))
        a = np.concatenate([[0], b[:-1]])
    keep = len(n) if stop is None else int((a + start < stop).sum())
    return pa.RecordBatch.from_arrays([pa.array([path] * keep, pa.string()), pa.array([split] * keep, pa.int64()), pa.array(n[:keep] + first - 1), pa.array(a[:keep] + start), pa.array(b[:keep] + start), lines.slice(0, keep).cast(pa.string())], ["file_id", "split", "line_number", "start_offset", "end_offset", "line"]), len(n)


class _LineReader(DataSourceReader):
    """Splits are ranges of the files' own bytes; with ``ranges``, stretches of plain bytes that begin with a line; with ``splits``, some of the splits."""

    def __init__(self, path: str, size: int, ranges: str = "", splits: str = "") -> None:
        self.path, self.size = path, size
        self.ranges, self.some = (json.loads(x) if x else None for x in (ranges, splits))

    def partitions(self) -> list[_Split]:
        if self.some is not None:
            out = [_Split(*s) for s in self.some]
        else:
            sizes = {f.path: f.size for f in _listed(self.path)}
            if self.ranges is not None:
                out = [_Split(path, a, b, sizes[path], first) for path, a, b, first in self.ranges if path in sizes]
            else:
                out = splits_of(sizes, self.size)
        return out or [_Split("", 0, 0, 0)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the split; ``line_number`` is counted within it.

        Of a compressed file whose blocks can be read by themselves each split
        reads the blocks that begin in it; of another the first split reads all.
        Offsets of bzip2 are counted within the split too, since only reading
        tells what lies before.
        """
        if not split.path:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(split.path) as raw:
            kind, source, blocks = opened(raw, split.path, split.size)
            if kind is None:
                return
            if kind == "bz2" and self.ranges is None:
                yield from _bz_lines(raw, split)
                return
            start, stop = split.start, split.stop
            if blocks is not None:
                if self.ranges is None:
                    span = _span(blocks, split)
                    if span is None:
                        return
                    start, stop = span
            elif kind:
                if start and self.ranges is None:
                    return
                stop = None if self.ranges is None else stop
                skip = start
                while skip > 0 and (block := source.read(min(BLOCK, skip))):
                    skip -= len(block)
            if (not kind or blocks is not None) and start:
                source.seek(start - 1)
                while True:
                    block = source.read(BLOCK)
                    if not block:
                        return
                    cut = block.find(b"\n")
                    if cut >= 0:
                        start = source.tell() - len(block) + cut + 1
                        break
                source.seek(start)
            number, rest = 0, b""
            while stop is None or start < stop:
                block = source.read(BLOCK)
                data = rest + block
                if not data:
                    return
                cut = len(data) if not block else data.rfind(b"\n") + 1
                data, rest = data[:cut], data[cut:]
                if not data:
                    continue
                batch, n = _addressed(split.path, split.start, split.first + number, data, start, stop)
                yield batch
                number, start = number + n, start + len(data)
                if not block:
                    return


def splits_of(sizes: dict[str, int], split_bytes: int) -> list[_Split]:
    return [_Split(path, a, min(a + split_bytes, size), size) for path, size in sizes.items() for a in range(0, size, split_bytes)]


def _span(blocks: list, split: _Split) -> tuple[int, int] | None:
    """The plain bytes of the blocks that begin in a split."""
    mine = [f for f in blocks if split.start <= f[0] < split.stop]
    return (mine[0][2], mine[-1][2] + mine[-1][3]) if mine else None


def _bz_lines(raw, split: _Split) -> Iterator[pa.RecordBatch]:
    """The lines that begin behind the split's first plain byte (of the first split, also with it) and no later than behind its last."""
    started, rest, at, number = not split.start, b"", 0, 0
    for place, block in BzBlocks(raw, split.start, split.stop):
        own = place < split.stop
        if not own and not started:
            return
        data = rest + block
        if not started:
            cut = data.find(b"\n") + 1
            at, data = at + (cut or len(data)), data[cut:] if cut else b""
            started = bool(cut)
        cut = (data.rfind(b"\n") if own else data.find(b"\n")) + 1
        if cut:
            batch, n = _addressed(split.path, split.start, split.first + number, data[:cut], at, None)
            yield batch
            number, at = number + n, at + cut
            if not own:
                return
        rest = data[cut:]
    if started and rest:
        yield _addressed(split.path, split.start, split.first + number, rest, at, None)[0]


class LogLines(DataSource):
    """``spark.read.format("loglines").load(path)``: addressed lines of plain and compressed text files."""

    @classmethod
    def name(cls) -> str:
        return "loglines"

    def schema(self) -> str:
        return "file_id string, split long, line_number long, start_offset long, end_offset long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)), self.options.get("ranges", ""), self.options.get("splits", ""))


class _CountReader(_LineReader):
    """Of each split of a file with several, the lines that begin in it, and (bzip2) the plain bytes; from bytes alone."""

    def partitions(self) -> list[_Split]:
        return [s for s in super().partitions() if s.stop - s.start < s.size] or [_Split("", 0, 0, 0)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(split.path) as raw:
            kind, source, blocks = opened(raw, split.path, split.size)
            n = plain = 0
            if kind == "bz2":
                last = b""
                for place, block in BzBlocks(raw, split.start, split.stop):
                    if place >= split.stop:
                        last = b""  # something follows
                        break
                    n, plain, last = n + block.count(b"\n"), plain + len(block), block[-1:]
                n += (not split.start and plain > 0) - (last == b"\n")
            elif kind is not None and (not kind or blocks is not None):
                span = (split.start, split.stop) if blocks is None else _span(blocks, split)
                if span is not None:
                    at, stop = max(span[0] - 1, 0), span[1] - 1
                    n = int(span[0] == 0)
                    source.seek(at)
                    while at < stop and (block := source.read(min(BLOCK, stop - at))):
                        n, at = n + block.count(b"\n"), at + len(block)
            elif kind is None or split.start:
                return  # nothing is read of it, or all by its first split
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (split.path, split.start, n, plain)], ["file_id", "split", "n", "plain"])


class LineCounts(DataSource):
    """``spark.read.format("linecounts").load(path)``: lines by split, without decoding them."""

    @classmethod
    def name(cls) -> str:
        return "linecounts"

    def schema(self) -> str:
        return "file_id string, split long, n long, plain long"

    def reader(self, schema) -> DataSourceReader:
        return _CountReader(self.options["path"], int(self.options.get("splitBytes", 64 << 20)), "", self.options.get("splits", ""))


def split_counts(spark: SparkSession, path: str, split_bytes: int, splits: list[_Split], kept: str | None = None) -> DataFrame:
    """``file_id, split, n, plain`` of the splits of files with several.

    With ``kept``, a folder, counts of files that haven't changed since are
    taken from there, and others are added to it.
    """
    spark.dataSource.register(LineCounts)
    read = spark.read.format("linecounts").option("splitBytes", str(split_bytes))
    if kept is None:
        return read.load(path) if not splits else read.option("splits", _as_option(splits)).load(path)
    times = {f.path: f.mtime_ns or 0 for f in _listed(path)}
    state = spark.createDataFrame(sorted({(s.path, s.size, times[s.path], split_bytes) for s in splits if s.stop - s.start < s.size}), "file_id string, size long, mtime long, split_bytes long")
    keys = state.columns
    fs, inner = _open(kept)
    known = spark.read.parquet(kept) if fs.get_file_info(inner).type == pafs.FileType.Directory else state.limit(0).selectExpr("*", "0L AS split", "0L AS n", "0L AS plain")
    missing = {r["file_id"] for r in state.join(known.select(*keys).distinct(), keys, "left_anti").select("file_id").toLocalIterator()}
    if missing:
        fresh = read.option("splits", _as_option([s for s in splits if s.path in missing])).load(path).join(state, "file_id")
        fresh.select(*keys, "split", "n", "plain").write.mode("append").parquet(kept)
        known = spark.read.parquet(kept)
    return known.join(state, keys, "left_semi").select("file_id", "split", "n", "plain").distinct()


def _as_option(splits: list[_Split]) -> str:
    return json.dumps([(s.path, s.start, s.stop, s.size) for s in splits])


def numbered(part: DataFrame, counts: DataFrame, few: bool) -> DataFrame:
    """Lines of splits with their numbers and places in their files, by the counts of the splits before."""
    from pyspark.sql import Window

    by = Window.partitionBy("file_id").orderBy("split")
    before = counts.select("file_id", "split", (F.sum("n").over(by) - F.col("n")).alias("__before"), (F.sum("plain").over(by) - F.col("plain")).alias("__base"))
    joined = part.join(F.broadcast(before) if few else before, ["file_id", "split"], "left")
    base = F.coalesce("__base", F.lit(0))
    return joined.withColumns({"line_number": F.col("line_number") + F.coalesce("__before", F.lit(0)), "start_offset": F.col("start_offset") + base, "end_offset": F.col("end_offset") + base}).drop("__before", "__base")


def read_lines(spark: SparkSession, path: str, split_bytes: int = 64 << 20, kept_counts: str | None = None) -> DataFrame:
    """Lines of all text files below a path, with numbers from the start of each file; binary ones are left out.

    A split counts its own lines.  Only where a file has several splits are line
    feeds counted beforehand, without decoding; ``kept_counts`` names a folder
    where such counts are kept for later scans.  The counts, one row for each
    split, are sent to all tasks where they are few.
    """
    spark.dataSource.register(LogLines)
    part = spark.read.format("loglines").option("splitBytes", str(split_bytes)).load(path)
    splits = splits_of({f.path: f.size for f in _listed(path)}, split_bytes)
    if all(s.stop - s.start == s.size for s in splits):
        return part.select(*COLUMNS)
    few = len(splits) <= MOST_SENT_SPLITS
    counts = split_counts(spark, path, split_bytes, splits if kept_counts else [], kept_counts)
    return numbered(part, counts, few).select(*COLUMNS)


def read_splits(spark: SparkSession, path: str, splits: list[_Split]) -> DataFrame:
    """Lines of some splits, with ``split``; numbers are counted within each."""
    spark.dataSource.register(LogLines)
    return spark.read.format("loglines").option("splits", _as_option(splits)).load(path)


def read_ranges(spark: SparkSession, path: str, ranges: list[tuple[str, int, int, int]]) -> DataFrame:
    """Lines that begin in ranges of bytes below ``path``: file, start and end of a range, and the number of its first line.

    A range begins with a line.  Nothing else is read, but of compressed files
    that aren't seekable what lies before the range.
    """
    spark.dataSource.register(LogLines)
    return spark.read.format("loglines").option("ranges", json.dumps(ranges)).load(path).select(*COLUMNS)
