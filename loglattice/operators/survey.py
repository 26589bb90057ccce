"""One pass over lines that finds what indexes and detectors need of them.

Spark's expressions mark each line (lengths, kinds, a hash); only these numbers
go to Arrow batches, where a task keeps the few lines that can matter and sums up
the rest.  What comes out composes: of a run (lines that follow one another in a
batch) nothing is assumed about the lines before it.  So runs may end anywhere,
and lines may even come in any order; then more of them are kept.

=========  ======================================================================
family     rows
=========  ======================================================================
``stats``  a file's counts, its lengths with how often each occurs, the longest line
``point``  checkpoints of runs that begin a file
``jump``   of other runs: the place where each is left by the place where it is entered
``tail``   of runs that begin a file: the place where each is left
``python`` and so on: the lines from an opener to the first that ends its segment
``dump``   lines that can change the state of crash dumps
``json``   lines within a window behind a bare bracket
``repeat`` runs of equal lines that are long enough, or touch an end of a run
``long``   lines that may be far longer than others
``secret`` lines with a secret, with their text
=========  ======================================================================
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bracket_delta, indent, is_blank
from .jumps import follow, jump_table, kind_of
from .shapes import BITS, BRACKETS, DUMP_KINDS, DUMP_WHATS, KIND_SHIFT, LONG_FLOOR, MIN_RUN, SECRET, WHAT_SHIFT, bracket, dump_kind, dump_what

ENDING_BYTES = 64 << 10
SEGMENTS = ("python", "java", "go", "js")
DETECTING = (*SEGMENTS, "dump", "json", "repeat", "long", "secret")
_NAMES = ["file_id", "family", "line_number", "start_offset", "end_offset", "bits", "xs", "ys", "text"]
_SCHEMA = "family string, line_number long, start_offset long, end_offset long, bits int, xs array<long>, ys array<long>, text string"
_KERNEL, _BLANK, _SEGFAULT = DUMP_WHATS.index("kernel"), DUMP_WHATS.index("blank"), DUMP_KINDS.index("segfault")


def marked(lines: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """The numbers that the pass needs of each line; those of families that aren't asked for are null."""
    line, zero = F.col("line"), F.lit(0)
    marks = zero
    for family in (f for f in BITS if f in families):
        for bit, shape in BITS[family].values():
            marks = marks.bitwiseOR(F.when(shape(line), F.lit(bit)).otherwise(zero))
    if "dump" in families:
        marks = marks.bitwiseOR(F.shiftleft(dump_kind(line), KIND_SHIFT)).bitwiseOR(F.shiftleft(dump_what(line), WHAT_SHIFT))
    none = F.lit(None).cast("long")
    when = lambda asked, c: c.cast("long") if asked else none
    size = F.octet_length("line")
    full = F.when(~is_blank(line), F.octet_length(F.rtrim(line, F.lit("\r\n"))))
    bare = F.regexp_replace(line, "^[ \\t\\r]+|[ \\t\\r]+$", "")
    json, stats = "json" in families, "stats" in families
    return lines.select(
        "file_id", "line_number", "start_offset", "end_offset", size.cast("long").alias("size"), when(stats, full).alias("full"),
        when(stats, F.length("line") - F.length(F.replace(line, F.lit("\r"), F.lit("")))).alias("crs"),
        marks.cast("long").alias("bits"), when("repeat" in families, F.xxhash64("line")).alias("same"),
        when(json, indent(line)).alias("left"), when(json, bracket_delta(line)).alias("delta"),
        when(json, F.when(F.length(bare) == 1, bracket(bare)).otherwise(0)).alias("bare"), when(json, bracket(F.substring(bare, -1, 1))).alias("tail"),
        (F.when(line.rlike(SECRET), line) if "secret" in families else F.lit(None).cast("string")).alias("text"),
    )


class _Lists:
    """Rows to be given out, of any family."""

    def __init__(self, kind: pa.DataType) -> None:
        self.kind, self.parts = kind, []

    def add(self, family: str, files: pa.Array, number, start, end, bits=None, xs: list | None = None, ys: list | None = None, text: pa.Array | None = None) -> None:
        n = len(files)
        if not n:
            return
        longs = lambda x: pa.array(x, pa.int64()) if x is not None else pa.nulls(n, pa.int64())
        lists = lambda x: pa.nulls(n, pa.list_(pa.int64())) if x is None else _list_array(x) if isinstance(x, np.ndarray) else pa.array(x, pa.list_(pa.int64()))
        self.parts.append(pa.RecordBatch.from_arrays(
            [files, pa.array([family] * n), longs(number), longs(start), longs(end), pa.array(np.asarray(bits, np.int32)) if bits is not None else pa.nulls(n, pa.int32()), lists(xs), lists(ys), text if text is not None else pa.nulls(n, pa.string())], _NAMES))

    def take(self) -> list[pa.RecordBatch]:
        out, self.parts = self.parts, []
        return out


def _list_array(rows: np.ndarray) -> pa.Array:
    """A list cell of each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(rows, np.int64).ravel()))


class Rows:
    """A batch as numpy columns, with its runs."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.n = batch.num_rows
        self.files = batch.column("file_id")
        for name in ("line_number", "start_offset", "end_offset", "size", "bits"):
            setattr(self, name, batch.column(name).to_numpy())
        code = self.files.dictionary_encode().indices.fill_null(-1).to_numpy()
        number = self.line_number
        #: Rows that begin a run, and those that begin a row's file in it.
        self.new = np.concatenate([[True], (code[1:] != code[:-1]) | (number[1:] != number[:-1] + 1)])
        self.last = np.concatenate([self.new[1:], [True]])
        self.at_start = self.new & (number == 1)
        #: Rows that begin a run of which something may lie before.
        self.open = self.new & (number > 1)
        self.batch = batch

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy(zero_copy_only=False)

    def before(self, values: np.ndarray, unknown) -> np.ndarray:
        """The value of the line before; ``unknown`` at the start of a run."""
        return np.where(self.new, unknown, np.concatenate([values[:1], values[:-1]]))

    def reached(self, opens: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Rows from an opener, or a run's start, to the first later one that stops, itself included."""
        i = 3 * np.arange(self.n)
        opened = np.maximum.accumulate(np.maximum(np.where(self.open, i, -1), np.where(opens, i + 1, -1)))
        after = np.where(stops & ~opens, i + 2, -1)
        closed = np.maximum.accumulate(np.maximum(np.where(self.at_start, i, -1), np.concatenate([[-1], after[:-1]])))
        return opened > closed


def _segment_rows(rows: Rows, family: str) -> np.ndarray:
    has = {name: (rows.bits & bit) != 0 for name, (bit, _) in BITS[family].items()}
    if family != "go":
        return rows.reached(has["opens"], ~has["more"])
    empty = has["empty"]
    return rows.reached(has["opens"], np.where(empty, rows.before(empty, False), ~has["more"]))


def _dump_rows(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The lines that may change the state, and the kinds of the line before each (-1: unknown)."""
    codes = rows.bits >> KIND_SHIFT
    kind, what = codes & 15, codes >> (WHAT_SHIFT - KIND_SHIFT)
    before = rows.before(codes, -1)
    near = rows.reached(kind > 0, what == _BLANK)
    other = (what > 0) & (what != _KERNEL)
    changes = (kind > 0) | other | ((before & 15) == _SEGFAULT) | (((before >> 4) == _KERNEL) & (what != _KERNEL))
    return near & (changes | rows.new | rows.last), before


def _json_rows(rows: Rows, window: int) -> np.ndarray:
    bare = rows.column("bare")
    opens = (bare == BRACKETS.index("{")) | (bare == BRACKETS.index("["))
    i = np.arange(rows.n)
    near = np.maximum.accumulate(np.where(opens | rows.open, i, -1))
    return (near >= np.maximum.accumulate(np.where(rows.new, i, 0))) & (i - near <= window)


def _repeats(rows: Rows, least: int, out: _Lists) -> None:
    same = rows.column("same")
    begins = rows.new | (same != rows.before(same, 0)) | (rows.size != rows.before(rows.size, -1))
    first = np.flatnonzero(begins)
    last = np.append(first[1:] - 1, rows.n - 1)
    keep = (last - first + 1 >= least) | rows.open[first] | rows.last[last]
    first, last = first[keep], last[keep]
    out.add("repeat", rows.files.take(pa.array(first)), rows.line_number[first], rows.start_offset[first], rows.end_offset[last], xs=np.stack([rows.line_number[last], same[first], rows.size[first]], axis=1))


class _Stats:
    """Counts of one file: lines, blank ones, endings, the longest line and the lengths with their counts."""

    def __init__(self, counts: list[int], longest: tuple[int, int, int] | None, sizes: np.ndarray, many: np.ndarray, lines: int, end: int) -> None:
        self.counts, self.longest, self.sizes, self.many, self.lines, self.end = counts, longest, sizes, many, lines, end

    def add(self, other: _Stats) -> None:
        self.counts = [a + b for a, b in zip(self.counts, other.counts)]
        if other.longest is not None and (self.longest is None or (other.longest[0], -other.longest[1]) > (self.longest[0], -self.longest[1])):
            self.longest = other.longest
        self.sizes, at = np.unique(np.concatenate([self.sizes, other.sizes]), return_inverse=True)
        self.many = np.bincount(at, np.concatenate([self.many, other.many])).astype(np.int64)
        self.lines, self.end = max(self.lines, other.lines), max(self.end, other.end)


def _file_stats(rows: Rows) -> Iterator[tuple[int, _Stats]]:
    """The counts of each stretch of one file in the batch, with its first row."""
    code = rows.files.dictionary_encode().indices.fill_null(-1).to_numpy()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    owner = np.repeat(np.arange(len(first)), np.diff(first, append=rows.n))
    full = rows.batch.column("full")
    blank = full.is_null().to_numpy(zero_copy_only=False)
    size = full.fill_null(-1).to_numpy()
    sampled = rows.start_offset < ENDING_BYTES
    rest = np.where(sampled, rows.end_offset - rows.start_offset - rows.size, 0)
    crs = np.where(sampled, rows.column("crs"), 0)
    sums = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (np.ones(rows.n), blank, rest == 2, rest == 1, crs, sampled)], axis=1)
    order = np.lexsort((rows.line_number, -size, owner))
    best = order[first]  # stretches are as long after sorting
    lines, ends = np.maximum.reduceat(rows.line_number, first), np.maximum.reduceat(rows.end_offset, first)
    some = np.flatnonzero(~blank)
    width = int(size.max()) + 1 if rows.n else 1
    pairs, many = np.unique(owner[some] * max(width, 1) + size[some], return_counts=True)
    cuts = np.searchsorted(pairs, np.arange(len(first) + 1) * max(width, 1))
    for k, a in enumerate(first.tolist()):
        b = int(best[k])
        longest = (int(size[b]), int(rows.line_number[b]), int(rows.start_offset[b])) if size[b] >= 0 else None
        yield a, _Stats(sums[k].tolist(), longest, pairs[cuts[k] : cuts[k + 1]] % max(width, 1), many[cuts[k] : cuts[k + 1]], int(lines[k]), int(ends[k]))


class _Walk:
    """Checkpoints along one run, batch after batch: chosen where the run begins its file, else as a table of jumps."""

    def __init__(self, file, number: int, start: int, step: int) -> None:
        self.file, self.number, self.step = file, number, step
        self.place = step if number == 1 else None
        # The checkpoint before the run lies in it at a place less than a step behind its start.
        self.limit = start + step
        self.upto = self.out = np.empty(0, np.int64)
        self.next = number

    def points(self, number: np.ndarray, end: np.ndarray) -> list[int]:
        """Rows behind which a checkpoint lies."""
        self.next = int(number[-1]) + 1
        if self.place is not None:
            taken = follow(end, end + self.step, self.place)
            if taken:
                self.place = int(end[taken[-1]]) + self.step
            return taken
        upto, out = jump_table(end, end + self.step)
        at = np.searchsorted(upto, self.out)
        self.out = np.where(at < len(out), out[np.minimum(at, len(out) - 1)], self.out)
        more = np.searchsorted(upto, self.limit) + 1
        if not len(self.upto) or self.upto[-1] < self.limit:
            self.upto, self.out = np.concatenate([self.upto, upto[:more]]), np.concatenate([self.out, out[:more]])
        return []


def _found(file, kind: pa.DataType) -> pa.Array:
    return pa.array([file], kind)


def survey(lines: DataFrame, families: tuple[str, ...], step: int = 0, window: int = 0, least: int = MIN_RUN) -> DataFrame:
    """The rows of ``families`` (see above), in one pass over ``lines``.

    ``step`` is that of checkpoints, ``window`` the lines that a JSON blob may
    span, ``least`` the equal lines that are a run.
    """
    points = "point" in families

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, walk, held = None, None, None

        def close_walk() -> None:
            if walk is None:
                return
            file, none = _found(walk.file, kind), [0]
            if walk.place is not None:
                out.add("tail", file, [walk.number], none, none, xs=[[walk.place]])
            else:
                out.add("jump", file, [walk.number], none, none, xs=[walk.upto.tolist()], ys=[walk.out.tolist()])

        def close_stats() -> None:
            if held is not None:
                file, s = held
                longest = list(s.longest or (-1, 0, 0))
                out.add("stats", _found(file, kind), [s.lines], [0], [s.end], xs=[[*s.counts, *longest, *s.sizes.tolist()]], ys=[s.many.tolist()])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Rows(batch)
            kind = rows.files.type
            out = out or _Lists(kind)
            for family in SEGMENTS:
                if family in families:
                    _give(out, family, rows, _segment_rows(rows, family))
            if "dump" in families:
                keep, before = _dump_rows(rows)
                _give(out, "dump", rows, keep, np.stack([before], axis=1))
            if "json" in families:
                _give(out, "json", rows, _json_rows(rows, window), lambda k: np.stack([rows.column(c)[k] for c in ("left", "delta", "bare", "tail")], axis=1))
            if "repeat" in families:
                _repeats(rows, least, out)
            if "long" in families:
                _give(out, "long", rows, rows.size >= LONG_FLOOR, np.stack([rows.size], axis=1))
            if "secret" in families:
                hit = rows.batch.column("text").is_valid().to_numpy(zero_copy_only=False)
                if hit.any():
                    k = np.flatnonzero(hit)
                    out.add("secret", rows.files.take(pa.array(k)), rows.line_number[k], rows.start_offset[k], rows.end_offset[k], text=rows.batch.column("text").take(pa.array(k)))
            if "stats" in families:
                for a, s in _file_stats(rows):
                    file = rows.files[a].as_py()
                    if held is not None and held[0] == file:
                        held[1].add(s)
                    else:
                        close_stats()
                        held = (file, s)
            if points:
                starts = np.flatnonzero(rows.new).tolist()
                for a, b in zip(starts, [*starts[1:], rows.n]):
                    file, number = rows.files[a].as_py(), int(rows.line_number[a])
                    if walk is None or walk.file != file or walk.next != number:
                        close_walk()
                        walk = _Walk(file, number, int(rows.start_offset[a]), step)
                        if number == 1:
                            out.add("point", _found(file, kind), [1], [0], [0])
                    taken = a + np.array(walk.points(rows.line_number[a:b], rows.end_offset[a:b]), np.int64)
                    out.add("point", rows.files.take(pa.array(taken)), rows.line_number[taken] + 1, rows.end_offset[taken], rows.end_offset[taken])
            yield from _joined(out)
        close_walk()
        close_stats()
        if out is not None:
            yield from _joined(out)

    return marked(lines, families).mapInArrow(run, f"file_id {kind_of(lines)}, {_SCHEMA}")


def _joined(out: _Lists) -> list[pa.RecordBatch]:
    parts = out.take()
    return pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []


def _give(out: _Lists, family: str, rows: Rows, keep: np.ndarray, xs=None) -> None:
    k = np.flatnonzero(keep)
    if len(k):
        more = None if xs is None else xs(k) if callable(xs) else xs[k]
        out.add(family, rows.files.take(pa.array(k)), rows.line_number[k], rows.start_offset[k], rows.end_offset[k], rows.bits[k], more)
