"""Lines of files by their places: tasks open the files there; no line is shuffled.

What is wanted is a distributed table, and each task reads its own rows' places.
Matches come out of a scan in the order of the files already, so nothing has to
be dealt out anew for their contexts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.places import Places
from .samples import CONTEXT, Request, asked_places, line_windows

#: Rows that are given out at once.
ROWS = 1000
_AROUND = "pattern_id string, file_id string, match_offset long, line_number long, line_offset long, line_text string"
_SAMPLE = "file_id string, key string, line_number long, start_offset long, line string, is_target boolean"


def _by_file(root: str, read: Callable[[Places, dict], Iterator[tuple]], schema: str) -> Callable:
    """A map over rows with ``file_id`` that gives what ``read`` makes of each; a file stays open while it goes on."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, out = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if row["file_id"] != held:
                        if place is not None:
                            place.close()
                        held, place = row["file_id"], Places(root, row["file_id"])
                    for made in read(place, row):
                        out.append(made)
                        if len(out) >= ROWS:
                            yield batch_of(out)
                            out = []
            if out:
                yield batch_of(out)
        finally:
            if place is not None:
                place.close()

    return run


def contexts(found: DataFrame, root: str, before: int, after: int) -> DataFrame:
    """As ``trace.contexts``, for matches in files below ``root``: each match's lines are read at its own place."""

    def read(file: Places, row: dict) -> Iterator[tuple]:
        starts = file.back(row["offset"], before)
        number = row["line_number"] - len(starts)
        for k, (start, _, text) in zip(range(len(starts) + 1 + after), file.lines(starts[0] if starts else row["offset"])):
            yield row["pattern_id"], row["file_id"], row["offset"], number + k, start, text

    return found.select("pattern_id", "file_id", "offset", "line_number").mapInArrow(_by_file(root, read, _AROUND), _AROUND)


def reconstruct(kept: DataFrame, root: str) -> DataFrame:
    """Kept matches (``pattern_id, file_id, offset, line_number``) with their lines, read at their places."""
    return contexts(kept, root, 0, 0).select("pattern_id", "file_id", F.col("match_offset").alias("offset"), "line_number", "line_text")


def _window(file: Places, row: dict, start: int, number: int) -> Iterator[tuple]:
    """Lines ``low`` to ``high`` of a request, from a line's place on."""
    for k, (at, _, text) in enumerate(file.lines(start)):
        if number + k > row["high"]:
            return
        if number + k >= row["low"]:
            yield row["file_id"], row["key"], number + k, at, text, number + k == row["target"]


def by_line(index: DataFrame, root: str, spec: str | list[Request], before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """As ``samples.by_line``, of files below ``root`` by their index (``file_id, line_count, line_index``; see ``index.build``).

    A window is read from the last checkpoint before it on; a place from the end
    near that end, too.
    """
    points = F.col("line_index")
    windows = line_windows(index.select("file_id", F.col("line_count").alias("n_lines"), points), spec, before, after, "line_index").filter("low <= n_lines")
    begin = F.element_at(F.filter(points, lambda p: p["line_number"] <= F.col("low")), -1)
    spots = windows.select("file_id", "key", "low", "high", "target", begin["byte_offset"].alias("start"), begin["line_number"].alias("first"))

    def read(file: Places, row: dict) -> Iterator[tuple]:
        return _window(file, row, row["start"], row["first"])

    return spots.mapInArrow(_by_file(root, read, _SAMPLE), _SAMPLE)


def by_offset(index: DataFrame, root: str, spec: str | list[Request], before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """As ``samples.by_offset``, of files below ``root`` by their index (with ``byte_count`` too).

    The line of a byte is found around that byte; its number is counted from the
    last checkpoint before it.
    """
    points = F.col("line_index")
    wanted = asked_places(index.select("file_id", F.col("line_count").alias("n_lines"), F.col("byte_count").alias("n_bytes"), points), spec, "line_index")
    near = lambda c: F.element_at(F.filter(points, lambda p: p["byte_offset"] <= F.col(c)), -1)
    spots = wanted.select("file_id", "key", "n_lines", "n_bytes", "a", "b", "single", *(near(c)[k].alias(f"{c}_{n}") for c in ("a", "b") for k, n in (("byte_offset", "start"), ("line_number", "first"))))

    def line_of(file: Places, row: dict, c: str) -> tuple[int, int]:
        """The number and place of the line that holds a byte, or those behind the last line."""
        start = file.start_of(row[c]) if row[c] < row["n_bytes"] else None
        return (row["n_lines"] + 1, row["n_bytes"]) if start is None else (row[f"{c}_first"] + file.count(row[f"{c}_start"], start), start)

    def read(file: Places, row: dict) -> Iterator[tuple]:
        number, start = line_of(file, row, "a")
        row["target"] = number
        row["high"] = number + after if row["single"] else line_of(file, row, "b")[0]
        starts = file.back(start, before) if row["single"] else []
        row["low"] = number - len(starts)
        return _window(file, row, starts[0] if starts else start, row["low"])

    return spots.mapInArrow(_by_file(root, read, _SAMPLE), _SAMPLE)


def tail(files: DataFrame, root: str, most: int) -> DataFrame:
    """``file_id, from_end, start_offset, line``: the last lines of files (``file_id, byte_count``), by the blocks before their ends alone; 1 is the last line."""
    schema = "file_id string, from_end long, start_offset long, line string"

    def read(file: Places, row: dict) -> Iterator[tuple]:
        end = row["byte_count"]
        # A last line without a line feed begins behind the last one.
        ends = file.read_at(end - 1, 1) == b"\n" if end else True
        starts = file.back(end if ends else end + 1, most)
        for k, (at, _, text) in zip(range(len(starts)), file.lines(starts[0]) if starts else ()):
            yield row["file_id"], len(starts) - k, at, text

    return files.select("file_id", "byte_count").mapInArrow(_by_file(root, read, schema), schema)
