"""Random access: lines by number or by byte, with the lines around them."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 3
#: Lines of one key where windows meet the lines in them.
BUCKET = 1 << 12
_REQUESTS = "array<struct<key:string,first:bigint,last:bigint>>"


class Request(NamedTuple):
    key: str
    first: int
    last: int | None  # None: a single place


def parse(spec: str) -> list[Request]:
    """``5, -3, 10-20``: places, places from the end, ranges of two places that aren't negative."""
    out = []
    for part in (p.strip() for p in spec.split(",")):
        single, span = re.fullmatch(r"-?\d+", part), re.fullmatch(r"(\d+)-(\d+)", part)
        if single:
            out.append(Request(part, int(part), None))
        elif span and int(span[1]) <= int(span[2]):
            out.append(Request(f"{int(span[1])}-{int(span[2])}", int(span[1]), int(span[2])))
        else:
            raise ValueError(f"not a place or a range: {part!r}")
    return out


def _asked(files: DataFrame, spec: str | list[Request]) -> DataFrame:
    """``files`` with ``key, first, last`` of each request; the requests are one literal of the plan."""
    wanted = parse(spec) if isinstance(spec, str) else spec
    text = json.dumps([r._asdict() for r in wanted])
    return files.withColumn("__r", F.explode(F.from_json(F.lit(text), _REQUESTS))).select(*files.columns, "__r.*")


def _sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_id").agg(F.max("line_number").alias("n_lines"), F.max("end_offset").alias("n_bytes"))


def _windows(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Lines of ``windows`` (``file_id, key, low, high, target``), and whether each is the target.

    Both sides meet by file and bucket of lines, so a large file is no single key.
    """
    windows = windows.filter("low <= high").withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor(F.col("high") / BUCKET))))
    own = lines.withColumn("__bucket", F.floor(F.col("line_number") / BUCKET)).join(windows, ["file_id", "__bucket"]).filter("line_number between low and high")
    return own.withColumn("is_target", F.col("line_number").eqNullSafe(F.col("target"))).select("file_id", "key", "line_number", "start_offset", "line", "is_target")


def by_line(lines: DataFrame, spec: str | list[Request], before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """``file_id, key, line_number, start_offset, line, is_target`` of the requests, in every file.

    A single place comes with its context; a range has none.  A negative place
    counts from the last line and is renamed to the place it means.
    """
    return _windows(lines, line_windows(_sizes(lines), spec, before, after))


def line_windows(sizes: DataFrame, spec: str | list[Request], before: int, after: int, *more: str) -> DataFrame:
    """``file_id, key, low, high, target`` of the requests, from ``file_id, n_lines``."""
    place = F.when(F.col("first") < 0, F.greatest(F.lit(1), F.col("n_lines") + F.col("first") + 1)).otherwise(F.col("first"))
    single = F.col("last").isNull()
    return _asked(sizes, spec).select(
        "file_id", *(["n_lines", *more] if more else []),
        F.when(F.col("first") < 0, place.cast("string")).otherwise(F.col("key")).alias("key"),
        F.when(single, F.greatest(F.lit(1), place - before)).otherwise(F.col("first")).alias("low"),
        F.when(single, place + after).otherwise(F.col("last")).alias("high"),
        F.when(single, place).alias("target"),
    )


def asked_places(sizes: DataFrame, spec: str | list[Request], *more: str) -> DataFrame:
    """``file_id, n_lines, n_bytes, key, a, b, single`` of the requests by byte, from ``file_id, n_lines, n_bytes``."""
    byte = F.when(F.col("first") < 0, F.greatest(F.lit(0), F.col("n_bytes") + F.col("first"))).otherwise(F.col("first"))
    return _asked(sizes, spec).select("file_id", "n_lines", "n_bytes", *more, F.when(F.col("first") < 0, byte.cast("string")).otherwise(F.col("key")).alias("key"), byte.alias("a"), F.coalesce("last", byte).alias("b"), F.col("last").isNull().alias("single"))


def by_offset(lines: DataFrame, spec: str | list[Request], before: int = CONTEXT, after: int = CONTEXT) -> DataFrame:
    """The same by byte: the line that holds a byte, or the lines from one byte's to another's.

    A negative byte counts from the end; one beyond the end means the place
    behind the last line.
    """
    asked = asked_places(_sizes(lines), spec)
    inside = lambda c: (F.col("start_offset") <= F.col(c)) & (F.col(c) < F.col("end_offset"))
    found = asked.join(lines.select("file_id", "line_number", "start_offset", "end_offset"), "file_id").filter(inside("a") | inside("b"))
    places = found.groupBy("file_id", "key", "single").agg(F.max(F.when(inside("a"), F.col("line_number"))).alias("x"), F.max(F.when(inside("b"), F.col("line_number"))).alias("y"))
    placed = asked.join(places.select("file_id", "key", "x", "y"), ["file_id", "key"], "left")
    x, y = F.coalesce("x", F.col("n_lines") + 1), F.coalesce("y", F.col("n_lines") + 1)
    windows = placed.select(
        "file_id",
        "key",
        F.when(F.col("single"), F.greatest(F.lit(1), x - before)).otherwise(x).alias("low"),
        F.when(F.col("single"), x + after).otherwise(y).alias("high"),
        x.alias("target"),
    )
    return _windows(lines, windows)


def grouped(samples: DataFrame) -> DataFrame:
    """One row for each file and request: its lines in order, and the byte at which its target begins (-1: none)."""
    out = samples.groupBy("file_id", "key").agg(F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("l"), F.max(F.when(F.col("is_target"), F.col("start_offset"))).alias("o"))
    return out.select("file_id", "key", F.col("l.line").alias("lines"), F.coalesce("o", F.lit(-1)).alias("offset"))


def in_order(rows: DataFrame) -> DataFrame:
    """By the number that a key begins with, then by the key and, where there are several, by file."""
    return rows.orderBy(F.regexp_extract("key", r"^-?\d+", 0).cast("long"), "key", *(c for c in ("file_id",) if c in rows.columns))


def render(rows: DataFrame, regex: str | None = None) -> DataFrame:
    """``file_id, key, text``: numbered lines, the target marked, matches of ``regex`` highlighted."""
    from ..functions.text import highlight

    line = F.col("line") if regex is None else highlight(F.col("line"), regex)
    one = F.concat(F.when(F.col("is_target"), "> ").otherwise("  "), F.col("line_number").cast("string"), F.lit(": "), line)
    out = rows.groupBy("file_id", "key").agg(F.array_sort(F.collect_list(F.struct("line_number", one.alias("t")))).alias("l"))
    return out.select("file_id", "key", F.array_join("l.t", "\n").alias("text"))
