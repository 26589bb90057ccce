"""The relation all operators read: addressed lines.

``file_id, line_number, start_offset, end_offset, line``: numbers from 1, byte
offsets from 0, ``end_offset`` behind the line feed, ``line`` without its line
feed and without one carriage return before it.  A last line without a line
feed is a line; nothing after a final line feed is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["file_id", "line_number", "start_offset", "end_offset", "line"]


def split_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Owner, number, start, end and text of the lines of all texts, by Arrow kernels."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.split_pattern(texts, "\n")
    bounds = lists.offsets.to_numpy()
    bounds, flat = bounds - bounds[0], lists.flatten()
    size = pc.binary_length(flat).to_numpy().astype(np.int64)
    many = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), many)
    number = np.arange(len(flat)) - np.repeat(bounds[:-1], many) + 1
    last = np.zeros(len(flat), bool)
    last[bounds[1:] - 1] = True
    ends = np.cumsum(size + ~last)
    base = np.concatenate([[0], ends])[bounds[:-1]]
    end = ends - np.repeat(base, many)
    keep = np.flatnonzero(~(last & (size == 0)))
    text = pc.replace_substring_regex(flat.take(pa.array(keep)), "\r$", "")
    return owner[keep], number[keep], (end - size - ~last)[keep], end[keep], text


def lines_of(df: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """Lines of a column of whole texts, each row a file: one narrow map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                owner, number, start, end, text = split_lines(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("file_id").take(pa.array(owner)), pa.array(number), pa.array(start), pa.array(end), text.cast(pa.string())], COLUMNS)

    rows = df.select(F.col(file_col).alias("file_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["file_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"file_id {kind}, line_number long, start_offset long, end_offset long, line string")
