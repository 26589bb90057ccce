"""Growing files as a stream of addressed lines.

A batch takes what has grown since the last one, whole lines only, so the offset
of the stream is one place a file.  Line numbers are state: of each file the
number of lines so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import _LineReader, _listed, _Split, kind_of
from ..sources.lines import COLUMNS
from ..sources.places import Places

SPLIT = 64 << 20


class _TailReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split
        self.seen: dict[str, tuple[int, int]] = {}  # size and end of the last whole line

    def initialOffset(self) -> dict:
        return {"ends": {}}

    def latestOffset(self, *_) -> dict:
        """Of each plain file the place behind its last line feed; only the blocks before a changed file's end are read."""
        for f in _listed(self.path):
            size, end = self.seen.get(f.path, (-1, 0))
            if f.size > size and not kind_of(f.path):
                place = Places(self.path, f.path)
                try:
                    tail = place.back(f.size + 1, 1) or [0]  # where a line without its line feed would begin
                finally:
                    place.close()
                self.seen[f.path] = f.size, max(end, tail[0])
        return {"ends": {p: end for p, (_, end) in sorted(self.seen.items()) if end}}

    def partitions(self, start: dict, end: dict) -> list[_Split]:
        out = []
        for path, stop in end["ends"].items():
            at = start["ends"].get(path, 0)
            out += [_Split(path, a, min(a + self.split, stop), stop) for a in range(at, stop, self.split)]
        return out or [_Split("", 0, 0, 0)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        yield from _LineReader(self.path, self.split).read(split)


class TailedLines(DataSource):
    """``spark.readStream.format("tailedlines").load(path)``: lines of plain files as they grow; numbers are counted within a batch's splits."""

    @classmethod
    def name(cls) -> str:
        return "tailedlines"

    def schema(self) -> str:
        return "file_id string, split long, line_number long, start_offset long, end_offset long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """Lines with their places; numbers are null (see ``numbered``).  A line comes once its line feed is there.

    A file that becomes shorter is left alone until it has grown beyond where it was read to.
    """
    spark.dataSource.register(TailedLines)
    lines = spark.readStream.format("tailedlines").option("splitBytes", str(split_bytes)).load(path)
    return lines.withColumn("line_number", F.lit(None).cast("long")).select(*COLUMNS)


def numbered(lines: DataFrame) -> DataFrame:
    """The stream's lines with their numbers in their files; the state is one number a file."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("start_offset")
        (before,) = state.get if state.exists else (0,)
        state.update((before + len(rows),))
        rows["line_number"] = range(before + 1, before + len(rows) + 1)
        yield rows[COLUMNS]

    shape = "file_id string, line_number long, start_offset long, end_offset long, line string"
    return lines.groupBy("file_id").applyInPandasWithState(run, shape, "n long", "append", GroupStateTimeout.NoTimeout)
