"""Anomaly detectors over lines.

One pass over the lines keeps the few that matter to any detector (see
``survey``); detectors then work on these.  Most restart at an opening line
whatever came before.  So the lines from one opener to the next form a segment,
and what is reported follows from the least or greatest numbers of certain lines
in the segment: partial aggregates.  The number of the last opener is a running
maximum in two levels, so no task holds a file.  Crash dumps restart only in some
states; after a blank line the state is none, so they fold over the few lines
between two such that can change it.  A JSON blob ends by the numbers of brackets
within a window of lines, whatever came before; which openers begin one is then
a greedy choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import stats_of
from .jumps import STRETCH, by_stretch, kind_of, taken, with_stretch
from .running import previous_row, running
from .shapes import BITS, BRACKETS, DUMP_KINDS, DUMP_WHATS, KIND_SHIFT, LONG_BONUS, LONG_FLOOR, LONG_TIMES, MIN_RUN, SECRET, WHAT_SHIFT
from .stored import kept
from .survey import survey
from .trace import submatches

ANOMALY = ["file_id", "detector", "category", "severity", "start_line", "end_line", "start_offset", "end_offset", "description"]
WINDOW_LINES, MOST_WINDOW_LINES = 128, 2048


def _has(family: str, name: str) -> Column:
    """Whether a line of the pass has a shape."""
    return F.col("bits").bitwiseAND(BITS[family][name][0]) != 0


def _rows(parts: DataFrame, family: str) -> DataFrame:
    return parts.filter(F.col("family") == family)


def _report(rows: DataFrame, detector: str, category: str, severity: float, description: Column) -> DataFrame:
    return rows.select("file_id", F.lit(detector).alias("detector"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), "start_line", "end_line", "start_offset", "end_offset", description.alias("description"))


def _count() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


def _segments(lines: DataFrame, opener: Column) -> DataFrame:
    """``lines`` from the first opener on, with ``opened``, the number of the last opener."""
    return running(lines, opened=("max", F.when(opener, F.col("line_number")))).filter("opened is not null")


def _spans(segments: DataFrame, last: DataFrame) -> DataFrame:
    """Offsets of the spans in ``last`` (``file_id, opened, end_line``)."""
    at = segments.groupBy("file_id", "opened").agg(F.min("start_offset").alias("start_offset"))
    ends = segments.select("file_id", "opened", F.col("line_number").alias("end_line"), "end_offset")
    return last.join(at, ["file_id", "opened"]).join(ends, ["file_id", "opened", "end_line"]).withColumnRenamed("opened", "start_line")


def _until(segments: DataFrame, goes_on: Column) -> DataFrame:
    """``file_id, opened, end_line``: each segment up to its first line (opener aside) that doesn't go on."""
    stop = F.min(F.when((F.col("line_number") > F.col("opened")) & ~goes_on, F.col("line_number")))
    ends = segments.groupBy("file_id", "opened").agg(stop.alias("stop"), F.max("line_number").alias("top"))
    return ends.select("file_id", "opened", F.coalesce(F.col("stop") - 1, F.col("top")).alias("end_line"))


def _python(parts: DataFrame) -> DataFrame:
    segments = _segments(_rows(parts, "python"), _has("python", "opens"))
    body = _until(segments, _has("python", "more"))
    nxt = segments.filter(_has("python", "exception")).select("file_id", "opened", (F.col("line_number") - 1).alias("end_line"), F.lit(1).alias("one"))
    # An exception line right behind the frames belongs to the traceback.
    last = body.join(nxt, ["file_id", "opened", "end_line"], "left").select("file_id", "opened", (F.col("end_line") + F.coalesce("one", F.lit(0))).alias("end_line"))
    return _report(_spans(segments, last), "traceback-python", "log-traceback", 0.7, F.format_string("Python traceback, %d lines", _count()))


def _java(parts: DataFrame) -> DataFrame:
    segments = _segments(_rows(parts, "java"), _has("java", "opens"))
    return _report(_spans(segments, _until(segments, _has("java", "more"))), "traceback-java", "log-traceback", 0.7, F.format_string("Java stack trace, %d lines", _count()))


def _go(parts: DataFrame) -> DataFrame:
    """One blank line may stand between parts; two end the trace, as does an exit status, which belongs to it."""
    rows = previous_row(_rows(parts, "go"), F.struct("line_number", _has("go", "empty").alias("empty")), "before")
    rows = rows.withColumns({"blank": _has("go", "empty"), "after_blank": F.coalesce((F.col("before.line_number") == F.col("line_number") - 1) & F.col("before.empty"), F.lit(False))})
    segments = _segments(rows, _has("go", "opens")).filter("line_number >= opened")
    later = F.col("line_number") > F.col("opened")
    broken = (F.col("blank") & F.col("after_blank")) | (~F.col("blank") & ~_has("go", "more"))
    stop = segments.groupBy("file_id", "opened").agg(F.min(F.when(later & broken, F.struct("line_number", (_has("go", "status") & ~F.col("after_blank")).alias("status")))).alias("stop"))
    with_stop = segments.join(stop, ["file_id", "opened"]).filter(F.col("stop").isNull() | (F.col("line_number") < F.col("stop.line_number")) | ((F.col("line_number") == F.col("stop.line_number")) & F.col("stop.status")))
    last = with_stop.filter(~F.col("blank")).groupBy("file_id", "opened").agg(F.max("line_number").alias("end_line"))
    return _report(_spans(segments, last), "traceback-go", "log-traceback", 0.8, F.format_string("Go traceback, %d lines", _count()))


def _js(parts: DataFrame) -> DataFrame:
    segments = _segments(_rows(parts, "js"), _has("js", "opens"))
    last = _until(segments, _has("js", "more")).filter("end_line > opened")
    return _report(_spans(segments, last), "traceback-js", "log-traceback", 0.6, F.format_string("JavaScript stack trace, %d lines", _count()))


def _long(parts: DataFrame) -> DataFrame:
    stats = stats_of(parts).select("file_id", "line_length_median", "line_length_p99")
    threshold = F.greatest(F.lit(LONG_FLOOR), F.floor("line_length_p99") + LONG_BONUS, LONG_TIMES * F.floor("line_length_median"))
    size = F.col("xs")[0]
    rows = _rows(parts, "long").join(stats, "file_id").withColumn("threshold", threshold).filter(size >= F.col("threshold"))
    rows = rows.withColumns({"start_line": F.col("line_number"), "end_line": F.col("line_number")})
    return _report(rows, "long-line", "format", 0.3, F.format_string("line is %d bytes (threshold %d)", size, F.col("threshold")))


def _repeat(parts: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """Runs of equal lines, blank ones too; of what the pass kept, those that meet at the ends of its runs are one."""
    rows = _rows(parts, "repeat").select("file_id", "line_number", "start_offset", "end_offset", F.col("xs")[0].alias("upto"), F.struct(F.col("xs")[1].alias("same"), F.col("xs")[2].alias("size")).alias("what"))
    rows = previous_row(rows, F.struct("upto", "what"), "before")
    goes_on = F.coalesce((F.col("before.upto") == F.col("line_number") - 1) & (F.col("before.what") == F.col("what")), F.lit(False))
    runs = running(rows, run=("max", F.when(~goes_on, F.col("line_number")))).groupBy("file_id", "run").agg(F.max("upto").alias("end_line"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"))
    rows = runs.filter(F.col("end_line") - F.col("run") + 1 >= least).withColumnRenamed("run", "start_line")
    return _report(rows, "repeat-identical", "repetition", 0.4, F.format_string("%d consecutive identical lines", _count()))


def _secret(parts: DataFrame) -> DataFrame:
    """One row for each occurrence, with the bytes of the occurrence itself."""
    hits = _rows(parts, "secret").withColumn("s", F.explode(submatches(F.col("text"), SECRET)))
    rows = hits.select("file_id", F.col("line_number").alias("start_line"), F.col("line_number").alias("end_line"), (F.col("start_offset") + F.col("s.start")).alias("start_offset"), (F.col("start_offset") + F.col("s.end")).alias("end_offset"), F.col("s.text").alias("text"))
    kind = F.when(F.col("text").startswith("AKIA"), "AWS access key id").when(F.col("text").startswith("ghp_"), "GitHub token").when(F.col("text").startswith("xox"), "Slack token").when(F.col("text").startswith("eyJ"), "JSON web token").otherwise("private key header")
    return _report(rows, "secrets-scan", "secrets", 1.0, kind)


class Span(NamedTuple):
    kind: str
    first: int
    last: int | None  # None: the file's last line
    start: int
    end: int | None


def fold_dumps(rows: Iterator[tuple[int, int, int, str, str]]) -> Iterator[Span]:
    """Crash dumps, from the lines that can change the state (number, start, end, kind of opener, what else it is)."""
    held: Span | None = None
    for number, start, end, kind, what in rows:
        if held is not None:
            grown, before = held._replace(last=number, end=end), held._replace(last=number - 1, end=start)
            if held.kind == "segfault":
                yield grown if what == "core" else held._replace(last=held.first, end=start)
                held = None
                if what == "core":
                    continue
            elif held.kind == "kernel":
                if what == "kernel" or kind == "kernel":
                    continue
                yield before
            elif what != "blank" and kind in ("", held.kind):
                if what == {"asan": "asan-end", "stack-smash": "aborted"}[held.kind]:
                    yield grown
                    held = None
                continue
            else:
                yield before
            held = None
        if kind:
            held = Span(kind, number, None, start, None)
    if held is not None:
        yield held


def _dump(parts: DataFrame) -> DataFrame:
    names = lambda code, of: F.element_at(F.array(*map(F.lit, of)), code + 1)
    kind_of_code = lambda code: names(code.bitwiseAND(15), DUMP_KINDS)
    what_of_code = lambda code: names(F.shiftright(code, WHAT_SHIFT - KIND_SHIFT), DUMP_WHATS)
    code = F.shiftright("bits", KIND_SHIFT)
    rows = _rows(parts, "dump").select("file_id", "line_number", "start_offset", "end_offset", kind_of_code(code).alias("kind"), what_of_code(code).alias("what"), code.alias("code"), F.col("xs")[0].cast("int").alias("own"))
    # The line before is known but at the start of a run.
    rows = previous_row(rows, F.struct("line_number", "code"), "row")
    near = F.when(F.col("row.line_number") == F.col("line_number") - 1, F.col("row.code"))
    code = F.when(F.col("own") >= 0, F.col("own")).otherwise(F.coalesce(near, F.lit(0)))
    rows = rows.withColumn("before", F.struct(kind_of_code(code).alias("kind"), what_of_code(code).alias("what")))
    kind, blank, number = F.col("kind"), F.col("what") == "blank", F.col("line_number")
    rows = running(rows, opened=("max", F.when(kind != "", number)), closed=("max", F.when(blank, number)))
    # A blank line belongs to the part that it ends.
    rows = previous_row(rows, F.struct("closed"), "row").withColumn("part", F.coalesce("row.closed", F.lit(0)))
    ends_kernel = (F.col("before.what") == "kernel") & (F.col("what") != "kernel")
    changes = (kind != "") | (blank & (F.col("opened") > F.col("part"))) | F.col("what").isin("asan-end", "aborted") | (F.col("before.kind") == "segfault") | ends_kernel
    few = rows.filter(changes & (F.col("opened") > F.col("part"))).select("file_id", F.col("part").alias("__stretch"), "line_number", "start_offset", "end_offset", "kind", "what")

    def fold(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = (table.column(c).to_pylist() for c in ("line_number", "start_offset", "end_offset", "kind", "what"))
        spans = list(fold_dumps(zip(*columns)))
        if spans:
            cols = [pa.array(c, t) for c, t in zip(zip(*spans), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([table.column("file_id")[0].as_py()] * len(spans), table.schema.field("file_id").type), *cols], columns_out)

    columns_out = ["file_id", "kind", "start_line", "end_line", "start_offset", "end_offset"]
    spans = by_stretch(few, fold, f"file_id {kind_of(parts)}, kind string, start_line long, end_line long, start_offset long, end_offset long")
    # What is open at the end of a part is so at the end of its file.
    sizes = _rows(parts, "stats").groupBy("file_id").agg(F.max("line_number").alias("n_lines"), F.max("end_offset").alias("n_bytes"))
    spans = spans.join(sizes, "file_id").withColumns({"end_line": F.coalesce("end_line", F.when(F.col("kind") == "segfault", F.col("start_line")), "n_lines"), "end_offset": F.coalesce("end_offset", "n_bytes")})
    label = F.create_map(*[F.lit(x) for kv in {"segfault": "segfault", "asan": "AddressSanitizer", "kernel": "kernel", "stack-smash": "stack smashing"}.items() for x in kv])
    return _report(spans, "coredump-unix", "log-crash", 0.9, F.format_string("%s crash dump, %d lines", label[F.col("kind")], _count()))


def blob_ends(depth: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each opener (a place in ``depth``, sums of brackets up to and with each line) the first later line with a lesser sum; the length if there is none."""
    n = len(depth)
    out, waiting = np.full(n, n, np.int64), []
    for j, d in enumerate(depth.tolist()):
        while waiting and waiting[-1][0] > d:
            out[waiting.pop()[1]] = j
        waiting.append((d, j))
    return out[at]


def _window(window: int) -> int:
    return max(1, min(window, MOST_WINDOW_LINES))


def _json(parts: DataFrame, window: int, size: int = STRETCH) -> DataFrame:
    """Blobs that an opening bracket alone on its line begins, through at most ``window`` lines more."""
    size = max(size, window + 1)
    names = ("left", "delta", "bare", "tail")
    rows = with_stretch(_rows(parts, "json"), size).select("file_id", "__stretch", "line_number", "start_offset", "end_offset", *(F.col("xs")[k].alias(n) for k, n in enumerate(names)), F.lit(False).alias("halo"))
    # A blob may end within the first lines of the next stretch.
    ahead = rows.filter((F.col("__stretch") > 0) & (F.col("line_number") - 1 - F.col("__stretch") * size <= window)).withColumns({"__stretch": F.col("__stretch") - 1, "halo": F.lit(True)})
    curly, square = BRACKETS.index("{"), BRACKETS.index("[")

    def blobs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number, start, end, left, delta, bare, tail = (table.column(c).to_numpy() for c in ("line_number", "start_offset", "end_offset", *names))
        at = np.flatnonzero(((bare == curly) | (bare == square)) & ~table.column("halo").to_numpy(zero_copy_only=False))
        if not len(at):
            return
        n, depth = len(number), np.cumsum(delta)
        closed = blob_ends(depth, at)
        # All lines behind an opener are there up to the edge of its window, or to the file's end.
        edge = np.searchsorted(number, number[at] + window)
        reached = (edge < n) & (number[np.minimum(edge, n - 1)] == number[at] + window)
        closes = closed < edge
        last = np.minimum(np.minimum(closed, edge), n - 1)
        right = closes & (depth[last] == depth[at] - 1) & (tail[last] == bare[at] + 1) & (left[last] == left[at])
        kind = np.select([right, closes, reached], ["clean", "", "window"], "eof")
        eof = kind == "eof"
        last_line, last_end = np.where(eof, number[at], number[last]), np.where(eof, start[at], end[last])
        after = np.where(eof, np.iinfo(np.int64).max, number[last] + 1)
        head = [pa.array(table.column(c).to_pylist()[:1] * len(at), table.schema.field(c).type) for c in ("file_id", "__stretch")]
        yield pa.RecordBatch.from_arrays([*head, pa.array(number[at]), pa.array(after), pa.array(kind.tolist(), pa.string()), pa.array(last_line), pa.array(start[at]), pa.array(last_end)], columns_out)

    columns_out = ["file_id", "__stretch", "at", "next", "kind", "end_line", "start_offset", "end_offset"]
    openers = by_stretch(rows.unionByName(ahead), blobs, f"file_id {kind_of(parts)}, __stretch long, at long, next long, kind string, end_line long, start_offset long, end_offset long")
    rows = taken(openers, 1).filter("kind != ''").withColumnRenamed("at", "start_line")
    text = F.when(F.col("kind") == "clean", F.format_string("multi-line JSON blob, %d lines", _count())).when(F.col("kind") == "window", F.format_string("truncated: blob opened at line %d, aborted at window edge after %d lines", "start_line", _count())).otherwise(F.format_string("truncated: blob opened at line %d, unclosed at EOF", "start_line"))
    return _report(rows, "json-blob-multiline", "format", 0.3, text)


def traceback_python(lines: DataFrame) -> DataFrame:
    return _python(survey(lines, ("python",)))


def traceback_java(lines: DataFrame) -> DataFrame:
    return _java(survey(lines, ("java",)))


def traceback_go(lines: DataFrame) -> DataFrame:
    return _go(survey(lines, ("go",)))


def traceback_js(lines: DataFrame) -> DataFrame:
    return _js(survey(lines, ("js",)))


def coredump(lines: DataFrame) -> DataFrame:
    return _dump(survey(lines, ("dump", "stats")))


def json_blob(lines: DataFrame, window: int = WINDOW_LINES, size: int = STRETCH) -> DataFrame:
    window = _window(window)
    return _json(survey(lines, ("json",), window=window), window, size)


def long_line(lines: DataFrame) -> DataFrame:
    return _long(survey(lines, ("long", "stats")))


def repeat_identical(lines: DataFrame, least: int = MIN_RUN) -> DataFrame:
    return _repeat(survey(lines, ("repeat",), least=least), least)


def secrets(lines: DataFrame) -> DataFrame:
    hits = lines.filter(F.col("line").rlike(SECRET))  # needs nothing but the line itself
    return _secret(hits.select("file_id", "line_number", "start_offset", F.col("line").alias("text"), F.lit("secret").alias("family")))


#: Every detector by name, with its category and what it looks for.
DETECTORS: dict[str, tuple[Callable[[DataFrame], DataFrame], str, str]] = {
    "traceback-python": (traceback_python, "log-traceback", "Python tracebacks"),
    "traceback-java": (traceback_java, "log-traceback", "Java stack traces"),
    "traceback-go": (traceback_go, "log-traceback", "Go runtime tracebacks"),
    "traceback-js": (traceback_js, "log-traceback", "JavaScript stack traces"),
    "coredump-unix": (coredump, "log-crash", "Unix crash dumps"),
    "json-blob-multiline": (json_blob, "format", "JSON objects over several lines"),
    "long-line": (long_line, "format", "Lines far longer than the file's others"),
    "repeat-identical": (repeat_identical, "repetition", "Runs of equal lines"),
    "secrets-scan": (secrets, "secrets", "Strings shaped like credentials"),
}
#: The scale of severities: from (included), to (excluded, but for the last), label (fixed values).
BANDS = [(0.0, 0.4, "low"), (0.4, 0.6, "medium"), (0.6, 0.8, "high"), (0.8, 1.0, "critical")]


def window_lines(*wanted: int | str | None) -> int:
    """The window size by the first source that names one (request, command line, environment), within its bounds."""
    for w in wanted:
        if w not in (None, "") and int(w) > 0:
            return min(int(w), MOST_WINDOW_LINES)
    return WINDOW_LINES


#: The families of rows that a detector needs, and what it makes of them (with the window).
_STEPS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame, int], DataFrame]]] = {
    "traceback-python": (("python",), lambda parts, _: _python(parts)),
    "traceback-java": (("java",), lambda parts, _: _java(parts)),
    "traceback-go": (("go",), lambda parts, _: _go(parts)),
    "traceback-js": (("js",), lambda parts, _: _js(parts)),
    "coredump-unix": (("dump", "stats"), lambda parts, _: _dump(parts)),
    "json-blob-multiline": (("json",), lambda parts, window: _json(parts, window)),
    "long-line": (("long", "stats"), lambda parts, _: _long(parts)),
    "repeat-identical": (("repeat",), lambda parts, _: _repeat(parts)),
    "secrets-scan": (("secret",), lambda parts, _: _secret(parts)),
}


def families_of(names: list[str] | None = None) -> tuple[str, ...]:
    """What the pass has to keep for the named detectors."""
    return tuple(dict.fromkeys(f for name in names or DETECTORS for f in _STEPS[name][0]))


def anomalies_of(parts: DataFrame, names: list[str] | None = None, window: int | None = None) -> DataFrame:
    """The anomalies that the named detectors (default: all) find in the rows of one pass, without repeats."""
    out = None
    for name in names or DETECTORS:
        found = _STEPS[name][1](parts, _window(window_lines(window)))
        out = found if out is None else out.unionByName(found)
    return dedup(out)


def analyze(lines: DataFrame, names: list[str] | None = None, window: int | None = None) -> DataFrame:
    """The anomalies that the named detectors (default: all) find, without repeats; ``window`` as in ``window_lines``.

    The lines are read once, when this is called.
    """
    parts = kept(survey(lines, families_of(names), window=_window(window_lines(window))))
    return anomalies_of(parts, names, window)


def dedup(anomalies: DataFrame, order: str = "start_offset") -> DataFrame:
    """One row for each file, detector, first and last line: the one that comes first by ``order``."""
    rows = anomalies.withColumn("__n", F.row_number().over(Window.partitionBy("file_id", "detector", "start_line", "end_line").orderBy(order, "end_offset", "description")))
    return rows.filter("__n = 1").drop("__n")


def summary(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("file_id", "detector").agg(F.count("*").alias("n"))


def band(severity: Column) -> Column:
    out = F.when(severity < BANDS[0][1], BANDS[0][2])
    for _, top, label in BANDS[1:-1]:
        out = out.when(severity < top, label)
    return out.otherwise(BANDS[-1][2])


def registry(spark) -> DataFrame:
    rows = [(k, name, category, text) for k, (name, (_, category, text)) in enumerate(DETECTORS.items())]
    return spark.createDataFrame(rows, "ordinal int, detector string, category string, description string")


def by_category(anomalies: DataFrame) -> DataFrame:
    """Each category of the registry that anomalies fall under, with their detectors by name and their number."""
    known = F.broadcast(registry(anomalies.sparkSession).select("detector", F.col("category").alias("__category")))
    counts = anomalies.groupBy("detector").agg(F.count("*").alias("n")).join(known, "detector")
    return counts.groupBy(F.col("__category").alias("category")).agg(F.array_join(F.sort_array(F.collect_set("detector")), ",").alias("detectors"), F.sum("n").alias("n"))
