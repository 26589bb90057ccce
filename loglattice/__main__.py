"""``python -m loglattice trace|samples|index|compress``: the operators from a shell."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.patterns import PatternSet
from .operators import caches, detectors, early, index, samples, seek, trace
from .operators.stored import kept
from .sources import compress, files, seekable

#: Exit codes (fixed values).
OK, FAILED, USAGE, NOT_FOUND, DENIED, BAD_REGEX = range(6)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loglattice")
    sub = parser.add_subparsers(dest="command", required=True)
    t = sub.add_parser("trace", help="search")
    t.add_argument("path")
    t.add_argument("-e", "--regexp", action="append", required=True)
    t.add_argument("-B", "--before", type=int, default=0)
    t.add_argument("-A", "--after", type=int, default=0)
    t.add_argument("-m", "--max-results", type=int, help="the first matches only; files behind them aren't read")
    t.add_argument("--cache", help="folder where the matches of whole searches are kept")
    for flag in ("-i", "-w", "-x", "-F", "-P", "--case-sensitive"):
        t.add_argument(flag, action="append_const", dest="flags", const=flag, default=[])
    s = sub.add_parser("samples", help="lines by number or byte")
    s.add_argument("path")
    one = s.add_mutually_exclusive_group(required=True)
    one.add_argument("-l", "--lines")
    one.add_argument("-b", "--offsets")
    s.add_argument("-B", "--before", type=int, default=0, help=f"0: {samples.CONTEXT}")
    s.add_argument("-A", "--after", type=int, default=0, help=f"0: {samples.CONTEXT}")
    s.add_argument("--cache", help="folder where indexes are kept; files without one get it, and only the bytes around the lines are read")
    i = sub.add_parser("index", help="line index, with anomalies on demand")
    i.add_argument("path")
    i.add_argument("-a", "--analyze", action="store_true")
    i.add_argument("--step", type=int, default=index.STEP)
    i.add_argument("--threshold", type=int, default=index.LARGE_FILE, help="bytes from which a file gets an index; all do with --analyze")
    i.add_argument("--window", type=int, help="lines that a JSON blob spans at most; else LOGLATTICE_WINDOW_LINES")
    i.add_argument("--cache", help="folder where indexes are kept")
    i.add_argument("--force", action="store_true", help="build also what is kept")
    i.add_argument("--info", action="store_true")
    i.add_argument("--delete", action="store_true")
    c = sub.add_parser("compress", help="plain files as seekable zstandard files")
    c.add_argument("path")
    c.add_argument("out")
    c.add_argument("--level", type=int, default=seekable.LEVEL)
    c.add_argument("--frame-size", type=int, default=seekable.FRAME_BYTES)
    for x in (t, s, i, c):
        x.add_argument("--json", action="store_true", help="one JSON object a row")
    return parser


def _write(rows: DataFrame, text, as_json: bool) -> int:
    """Rows as JSON or as lines of text; their number."""
    n = 0
    for row in (rows.select(F.to_json(F.struct("*")).alias("j")) if as_json else rows).toLocalIterator():
        sys.stdout.write((row["j"] if as_json else text(row)) + "\n")
        n += 1
    return n


def _trace(spark: SparkSession, args: argparse.Namespace) -> None:
    patterns = PatternSet.of(*args.regexp, flags=tuple(args.flags))
    names = dict(zip(patterns.ids, patterns.patterns))
    if args.max_results is not None:
        out = early.first_matches(spark, args.path, patterns, args.max_results).rows
    elif args.cache:
        listed = files.catalog(spark, args.path).filter("text")
        out = trace.ordered(caches.search(spark, args.path, listed, patterns, args.cache))
    else:
        out = trace.ordered(trace.matches(files.read_lines(spark, args.path), patterns))
    if args.before or args.after:
        around = seek.contexts(out, args.path, args.before, args.after)
        _write(around.orderBy("file_id", "match_offset", "line_number"), lambda r: f"{r['file_id']}:{r['line_number']}: {r['line_text']}", args.json)
        return
    n = _write(out, lambda r: f"{r['file_id']}: [{names[r['pattern_id']]}] offset={r['offset']} line={r['line_number']} {r['line_text']}", args.json)
    if not args.json:
        listed = files.catalog(spark, args.path)
        left_out, of = files.skipped(listed).count(), listed.count()
        sys.stdout.write(f"--- {n} matches in {of - left_out} files (skipped {left_out}) ---\n" if n else f"no matches in {of} files\n")


def _samples(spark: SparkSession, args: argparse.Namespace) -> None:
    around = args.before or samples.CONTEXT, args.after or samples.CONTEXT
    if args.cache:
        find = seek.by_line if args.lines else seek.by_offset
        found = find(_indexed(spark, args.path, args.cache), args.path, args.lines or args.offsets, *around)
    else:
        find = samples.by_line if args.lines else samples.by_offset
        found = find(files.read_lines(spark, args.path), args.lines or args.offsets, *around)
    _write(samples.grouped(found) if args.json else samples.in_order(samples.render(found)), lambda r: f"{r['file_id']} {r['key']}\n{r['text']}", args.json)


def _indexed(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """The kept indexes of all text files below a path; those that lack one get it first."""
    listed = files.catalog(spark, path).filter("text")
    try:
        missing = caches.to_build(listed, caches.load_index(spark, cache, listed))
    except AnalysisException:
        missing = listed  # nothing is kept yet
    if not missing.isEmpty():
        lines = files.read_lines(spark, path).join(missing.select(F.col("path").alias("file_id")), "file_id", "left_semi")
        caches.save_index(index.build(lines, files=missing), cache)
    return caches.load_index(spark, cache, listed)


def _index(spark: SparkSession, args: argparse.Namespace) -> int:
    listed = files.catalog(spark, args.path).filter("text")
    if args.info or args.delete:
        if not args.cache:
            raise ValueError("--info and --delete need --cache")
        try:
            if args.delete:
                return OK if _write(caches.delete_index(spark, args.cache, listed), lambda r: f"deleted index for {r['path']}", args.json) else NOT_FOUND
            _write(caches.index_info(spark, args.cache, listed), lambda r: f"{r['path']}: {r['index_entries']} entries, analysis={r['analyzed']}" if r["kept_at"] else f"{r['path']}: no index exists", args.json)
        except AnalysisException:
            return NOT_FOUND
        return OK
    began = time.time()
    wanted = listed.filter(index.needs_index(F.col("size"), args.analyze, args.threshold))
    if args.cache:
        try:
            wanted = caches.to_build(wanted, caches.load_index(spark, args.cache, listed), args.analyze, args.force)
        except AnalysisException:
            pass  # nothing is kept yet
    wanted = kept(wanted.select("path", "size", "mtime"))  # what is kept later must not change it
    lines = files.read_lines(spark, args.path).join(wanted.select(F.col("path").alias("file_id")), "file_id", "left_semi")
    window = detectors.window_lines(args.window, os.environ.get("LOGLATTICE_WINDOW_LINES"))
    built = index.build(lines, args.step, args.analyze, wanted, window)
    if args.cache:
        caches.save_index(built, args.cache)
        built = caches.load_index(spark, args.cache, wanted)
    n = _write(built, lambda r: f"  {r['path']}: {r['line_count']} lines, {len(r['line_index'])} checkpoints", args.json)
    if not args.json:
        sys.stdout.write(f"{'indexed and analyzed' if args.analyze else 'index built for'} {n} files in {time.time() - began:.1f}s\n" if n else "no files indexed\n")
    return OK


def _compress(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = compress.compress_files(spark, args.path, args.out, args.frame_size, args.level)
    _write(rows, lambda r: f"wrote {r['output']} ({r['plain_size']} bytes -> {r['packed_size']} bytes, {r['plain_size'] / max(r['packed_size'], 1):.2f}x) in {r['frames']} frames", args.json)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)  # leaves with USAGE by itself
    spark = SparkSession.builder.appName("loglattice").getOrCreate()
    try:
        if args.command == "trace":
            PatternSet.of(*args.regexp, flags=tuple(args.flags)).check(spark)
    except ValueError as e:
        sys.stderr.write(f"{e}\n")
        return BAD_REGEX
    try:
        if "://" not in args.path and not os.path.exists(args.path):
            raise FileNotFoundError(args.path)
        return {"trace": _trace, "samples": _samples, "index": _index, "compress": _compress}[args.command](spark, args) or OK
    except FileNotFoundError as e:
        code, said = NOT_FOUND, f"no such file: {e}"
    except PermissionError as e:
        code, said = DENIED, f"access denied: {e}"
    except ValueError as e:
        code, said = USAGE, str(e)
    sys.stderr.write(said + "\n")
    return code


if __name__ == "__main__":
    sys.exit(main())
