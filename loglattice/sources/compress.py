"""Files as seekable zstandard files: frames are cut and pressed in parallel, then put together file by file."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from .files import BLOCK, TEXT_PROBE, _LineReader, _open, _Split, kind_of
from .seekable import FRAME_BYTES, LEVEL, seek_table


class _PieceReader(_LineReader):
    """The plain files below a path in pieces that end with a line; those that are compressed already are left out."""

    def __init__(self, path: str, size: int, piece: int) -> None:
        super().__init__(path, size, "")
        self.piece = piece

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(split.path) as raw:
            if kind_of(split.path, raw.read(TEXT_PROBE)):
                return
            at = split.start
            if at:
                raw.seek(at - 1)
                at = self._behind_line(raw, at - 1)
            while at is not None and at < split.stop:
                raw.seek(at)
                data = raw.read(min(self.piece, split.stop - at))
                end = self._behind_line(raw, at + len(data) - 1) if data and not data.endswith(b"\n") else at + len(data)
                end = split.size if end is None else end
                if end > at + len(data):
                    raw.seek(at + len(data))
                    data += raw.read(end - at - len(data))
                yield pa.RecordBatch.from_arrays([pa.array([split.path]), pa.array([at], pa.int64()), pa.array([data], pa.binary())], ["file_id", "start", "content"])
                at = end

    @staticmethod
    def _behind_line(raw, at: int) -> int | None:
        """The place behind the first line feed from ``at`` on, None if there is none."""
        raw.seek(at)
        while block := raw.read(BLOCK):
            cut = block.find(b"\n")
            if cut >= 0:
                return raw.tell() - len(block) + cut + 1
        return None


class FilePieces(DataSource):
    """``spark.read.format("filepieces").load(path)``: pieces of plain files, one a row."""

    @classmethod
    def name(cls) -> str:
        return "filepieces"

    def schema(self) -> str:
        return "file_id string, start long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _PieceReader(self.options["path"], int(self.options["splitBytes"]), int(self.options["pieceBytes"]))


def compress_files(spark: SparkSession, path: str, out: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL, split_bytes: int = 64 << 20) -> DataFrame:
    """Write each plain file below ``path`` to ``out`` as a seekable file; ``file_id, output, plain_size, packed_size, frames`` of each.

    All tasks press frames.  A file's frames are then streamed in their order to
    its output, by one task that holds one of them; the output gets its name
    when it is whole, so a retried task leaves no half file under it.  Empty files
    give none.
    """
    spark.dataSource.register(FilePieces)
    pieces = spark.read.format("filepieces").option("splitBytes", str(split_bytes)).option("pieceBytes", str(frame_bytes)).load(path)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.column("content").to_pylist()
            packed = [zstandard.ZstdCompressor(level=level).compress(x) for x in plain]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("start"), pa.array([len(x) for x in plain], pa.int64()), pa.array(packed, pa.binary())], ["file_id", "start", "n", "packed"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream, sizes = None, None, []
        fs, top = _open(out)
        fs.create_dir(top, recursive=True)

        def finish() -> pa.RecordBatch:
            table = seek_table(sizes)
            stream.write(table)
            stream.close()
            whole = f"{top}/{os.path.basename(file)}.zst"
            fs.move(held, whole)
            row = (file, whole, sum(n for _, n in sizes), sum(n for n, _ in sizes) + len(table), len(sizes))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file_id", "output", "plain_size", "packed_size", "frames"])

        for batch in batches:
            for f, n, packed in zip(*(batch.column(c).to_pylist() for c in ("file_id", "n", "packed"))):
                if f != file:
                    if file is not None:
                        yield finish()
                    file, sizes, held = f, [], f"{top}/.{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(held)
                stream.write(packed)
                sizes.append((len(packed), n))
        if file is not None:
            yield finish()

    frames = pieces.mapInArrow(press, "file_id string, start long, n long, packed binary")
    ordered = frames.repartition("file_id").sortWithinPartitions("file_id", "start")
    return ordered.mapInArrow(join, "file_id string, output string, plain_size long, packed_size long, frames long")

