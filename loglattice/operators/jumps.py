"""Greedy choices along a file, over all tasks.

Items stand in the order of a file, each with a place ``at`` and the place
``next`` from which on the following item may be taken: the first item from a
given place on is taken, then the first from its ``next`` on, and so forth.
Which items of a stretch are taken hangs on the place at which the stretch is
entered; so each stretch is first made a table of the place at which it is left
by the place at which it is entered.  The tables, one row a stretch, are walked
file by file, and then all stretches are chosen from at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import STRETCH, with_stretch


def kind_of(rows: DataFrame, column: str = "file_id") -> str:
    return rows.schema[column].dataType.simpleString()


def by_stretch(rows: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, order: str = "line_number") -> DataFrame:
    """``run`` over the rows of each ``file_id`` and ``__stretch``, by ``order``; a task holds one stretch."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            files = batch.column("file_id").dictionary_encode()
            code, stretch = files.indices.to_numpy(zero_copy_only=False), batch.column("__stretch").to_numpy()
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (stretch[1:] != stretch[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                now = (batch.column("file_id")[a].as_py(), int(stretch[a]))
                if held and now != key:
                    yield from run(pa.Table.from_batches(held))
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(pa.Table.from_batches(held))

    return rows.repartition("file_id", "__stretch").sortWithinPartitions("file_id", "__stretch", order).mapInArrow(walk, schema)


def jump_table(at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entered at or before ``upto[k]`` (and behind the one before), a stretch is left at ``out[k]``."""
    n = len(at)
    follower = np.searchsorted(at, after)
    last = np.where(follower < n, np.minimum(follower, n - 1), np.arange(n))
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    out = after[last]
    edge = np.append(out[1:] != out[:-1], True)
    return at[edge], out[edge]


def follow(at: np.ndarray, after: np.ndarray, entry: int) -> list[int]:
    """The items that are taken from ``entry`` on."""
    out, i = [], int(np.searchsorted(at, entry))
    while i < len(at):
        out.append(i)
        i = int(np.searchsorted(at, after[i]))
    return out


def taken(items: DataFrame, entry: int) -> DataFrame:
    """The items (``file_id, __stretch, at, next`` and more) that are taken from ``entry`` on in each file.

    ``at`` rises with the stretches.  Items of first stretches need no table.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    first = by_stretch(items.filter("__stretch = 0"), _chooser(None, entry), schema, "at")
    later = items.filter("__stretch > 0")
    kind = kind_of(items)

    def table(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        upto, out = jump_table(rows.column("at").to_numpy(), rows.column("next").to_numpy())
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (upto, out)]
        yield pa.RecordBatch.from_arrays([*(pa.array(rows.column(c).to_pylist()[:1], rows.schema.field(c).type) for c in ("file_id", "__stretch")), *lists], ["file_id", "__stretch", "upto", "out"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place = None, entry
        for batch in batches:
            entries = []
            for f, upto, out in zip(*(batch.column(c).to_pylist() for c in ("file_id", "upto", "out"))):
                if f != file:
                    file, place = f, entry
                entries.append(place)
                k = int(np.searchsorted(np.array(upto), place))
                place = out[k] if k < len(out) else place
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("__stretch"), pa.array(entries, pa.int64())], ["file_id", "__stretch", "__entry"])

    # The first stretches of files with more than one take part in the walk.
    long = later.select("file_id").distinct()
    tables = by_stretch(items.join(long, "file_id", "left_semi"), table, f"file_id {kind}, __stretch long, upto array<long>, out array<long>", "at")
    entries = tables.repartition("file_id").sortWithinPartitions("file_id", "__stretch").mapInArrow(chain, f"file_id {kind}, __stretch long, __entry long")
    rest = by_stretch(later.join(entries, ["file_id", "__stretch"]).select(*items.columns, "__entry"), _chooser("__entry", entry), schema, "at")
    return first.unionByName(rest)


def _chooser(column: str | None, entry: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        place = entry if column is None else rows.column(column)[0].as_py()
        chosen = follow(rows.column("at").to_numpy(), rows.column("next").to_numpy(), place)
        kept = rows.take(pa.array(chosen, pa.int64()))
        yield from (kept if column is None else kept.drop_columns([column])).to_batches()

    return run


__all__ = ["STRETCH", "by_stretch", "follow", "jump_table", "kind_of", "taken", "with_stretch"]
