import random
import statistics

import pytest

from loglattice.operators.survey import survey
from loglattice.operators import caches, frames, index, samples
from loglattice.operators.samples import Request, parse
from pyspark.sql import functions as F

from .helpers import lines_frame, rows


def test_line_stats(spark):
    text = "aaaa\n\n  \nbb\nccccccc\nddddddd\n"
    r = index.line_stats(lines_frame(spark, {"f": text})).first()
    sizes = [4, 2, 7, 7]
    assert (r["line_count"], r["empty_line_count"], r["line_length_max"], r["max_line_number"], r["max_byte_offset"]) == (6, 2, 7, 5, 12)
    assert r["line_length_avg"] == statistics.mean(sizes) and r["line_length_stddev"] == pytest.approx(statistics.stdev(sizes))
    assert r["line_length_median"] == 5.5
    blank = index.line_stats(lines_frame(spark, {"f": "\n\n"})).first()
    assert (blank["line_length_max"], blank["line_length_stddev"], blank["max_line_number"]) == (0, 0.0, None)


@pytest.mark.parametrize("text, kind", [("a\nb\n", "LF"), ("a\r\nb\r\n", "CRLF"), ("a\rb\rc", "CR"), ("a\r\nb\n", "mixed"), ("a", "LF")])
def test_line_endings(spark, text, kind):
    assert index.line_endings(lines_frame(spark, {"f": text})).first()["line_ending"] == kind


def greedy(ends, step):
    out, due = [(1, 0)], step
    for n, end in enumerate(ends, 1):
        if end >= due:
            out.append((n + 1, end))
            due = end + step
    return out


def test_checkpoints(spark, monkeypatch):
    rng = random.Random(3)
    files = {f"f{k}": "".join("x" * rng.randrange(30) + "\n" for _ in range(rng.randrange(1, 200))) for k in range(20)}
    want = []
    for f, t in files.items():
        at, ends = 0, []
        for line in t.split("\n")[:-1]:
            at += len(line) + 1
            ends.append(at)
        want += [(f, *p) for p in greedy(ends, 256)]
    for parts in (1, 6):
        assert rows(index.checkpoints(lines_frame(spark, files, parts), 256), "file_id", "line_number", "byte_offset") == sorted(want)
    lines = lines_frame(spark, files, 6)
    # Lines in any order: every one of them is a part of its own.
    assert rows(index.checkpoints(lines.repartition(3).cache(), 256), "file_id", "line_number", "byte_offset") == sorted(want)
    monkeypatch.setattr(index, "MOST_SENT", 10)
    assert rows(index.checkpoints(lines.repartition(3).cache(), 256), "file_id", "line_number", "byte_offset") == sorted(want)


def test_statistics_from_one_pass(spark):
    """As from the lines themselves, whatever the batches and parts."""
    rng = random.Random(6)
    files = {f"f{k}": "".join(rng.choice(["", " ", "é" * rng.randrange(9), "x" * rng.randrange(40), "a\rb"]) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(rng.randrange(1, 90))) for k in range(15)} | {"blank": "\n \n", "one": "x"}
    lines = lines_frame(spark, files, 4)
    want = index.line_stats(lines).join(index.line_endings(lines), "file_id")
    for batch, parts in ((10_000, 4), (5, 4), (10_000, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = index.stats_of(survey(lines_frame(spark, files, parts), ("stats",)))
        assert got.schema.simpleString() == want.schema.simpleString()
        plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert plain(got) == plain(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_indexes_are_merged_without_lines(spark):
    """Exact statistics of a directory from the indexes of its files."""
    rng = random.Random(9)
    files = {f"{d}/f{k}": "".join("x" * rng.randrange(60) + "\n" for _ in range(rng.randrange(1, 90))) for d in "ab" for k in range(4)} | {"b/blank": "\n\n"}
    lines = lines_frame(spark, files, 3)
    built = index.build(lines, 512, lengths=True).withColumn("dir", F.substring("file_id", 1, 1))
    columns = ("line_count", "empty_line_count", "line_length_max", "line_length_avg", "line_length_median", "line_length_p95", "line_length_p99")
    each = index.line_stats(lines.withColumn("file_id", F.substring("file_id", 1, 1)))
    assert rows(index.merged(built, "dir"), "dir", *columns) == rows(each, "file_id", *columns)
    assert rows(index.merged(built), *columns) == rows(index.line_stats(lines.withColumn("file_id", F.lit("all"))), *columns)


def test_index_of_parts(spark, tmp_path):
    """Files in several splits: the source is read twice, with all detectors, and rows equal those of whole files."""
    from loglattice.plans.corpus import KINDS
    from loglattice.sources.files import read_lines

    rng = random.Random(2)
    for k in range(3):
        (tmp_path / f"f{k}.log").write_text("".join(rng.choice(KINDS[rng.choice(list(KINDS))]) + "\n" for _ in range(600)))
    whole = index.build(read_lines(spark, str(tmp_path)), 500, analyze=True)
    parts = index.build(read_lines(spark, str(tmp_path), split_bytes=900), 500, analyze=True)
    assert whole.orderBy("file_id").collect() == parts.orderBy("file_id").collect()
    assert {x["detector"] for r in whole.collect() for x in r["anomalies"]} >= {"traceback-python", "traceback-java", "traceback-go", "coredump-unix", "json-blob-multiline"}


class Reads:
    """Counts the times that a table's lines are made, over all tasks."""

    def __init__(self, spark, lines):
        self.total = spark.sparkContext.accumulator(0)
        total = self.total

        def run(batches):
            for batch in batches:
                total.add(batch.num_rows)
                yield batch

        self.lines = lines.mapInArrow(run, lines.schema)


def test_lines_are_read_once_or_twice(spark):
    files = {f"f{k}": "".join(f"line {i} of {k}\n" for i in range(200)) for k in range(5)}
    lines = lines_frame(spark, files)
    once = Reads(spark, lines)
    index.build(once.lines, 256, analyze=True).collect()
    assert once.total.value == 1000
    twice = Reads(spark, lines)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    index.build(twice.lines.repartitionByRange(7, "file_id", "line_number").sortWithinPartitions("file_id", "line_number"), 256, analyze=True).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    # The range shuffle samples its input: it makes the lines once more for each of the two passes.
    assert twice.total.value <= 4000


def test_checkpoint_lookup(spark):
    points = spark.createDataFrame([("f", 1, 0), ("f", 10, 100), ("f", 20, 200)], "file_id string, line_number long, byte_offset long")
    wanted = spark.createDataFrame([("f", 1), ("f", 9), ("f", 10), ("f", 99)], "file_id string, line_number long")
    assert rows(index.nearest_checkpoint(wanted, points), "line_number", "checkpoint_line") == [(1, 1), (9, 1), (10, 10), (99, 20)]
    by_byte = index.nearest_checkpoint(spark.createDataFrame([("f", 150)], "file_id string, byte_offset long"), points, "byte_offset")
    assert rows(by_byte, "checkpoint_line") == [(10,)]


def test_parse():
    assert parse("5, -3,10-20") == [Request("5", 5, None), Request("-3", -3, None), Request("10-20", 10, 20)]
    for bad in ("", "a", "5-3", "-5--1", "1,,2"):
        with pytest.raises(ValueError):
            parse(bad)


TEXT = "".join(f"line {k}\n" for k in range(1, 11))


def test_by_line(spark):
    got = samples.grouped(samples.by_line(lines_frame(spark, {"f": TEXT}), "1, -1, 4-5, 99", 1, 1)).collect()
    by = {r["key"]: (r["lines"], r["offset"]) for r in got}
    assert by == {"1": (["line 1", "line 2"], 0), "10": (["line 9", "line 10"], 63), "4-5": (["line 4", "line 5"], -1)}


def test_by_offset(spark):
    got = samples.by_offset(lines_frame(spark, {"f": TEXT}), "0, 7, 8-20, -1", 0, 0)
    assert rows(got, "key", "line_number") == [("0", 1), ("7", 2), ("70", 10), ("8-20", 2), ("8-20", 3)]


def test_frames(spark):
    made = frames.frame_table(spark.createDataFrame([("f", 0, 5, 100), ("f", 1, 6, 50), ("f", 2, 7, 10)], "file_id string, frame int, compressed_size long, decompressed_size long"))
    assert rows(made, "frame", "compressed_offset", "decompressed_offset") == [(0, 0, 0), (1, 5, 100), (2, 11, 150)]
    ranges = spark.createDataFrame([("f", 99, 101), ("f", 150, 150)], "file_id string, low long, high long")
    assert rows(frames.overlapping(made, ranges), "low", "frame") == [(99, 0), (99, 1)]
    offs = spark.createDataFrame([("f", 0), ("f", 149), ("f", 150)], "file_id string, offset long")
    assert rows(frames.locate(made, offs), "offset", "frame", "within") == [(0, 0, 0), (149, 1, 49), (150, 2, 0)]


def test_cache_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("/a", 1, 1), ("/b", 2, 2)], "path string, size long, mtime long")
    caches.save_index(files.filter("path = '/a'").withColumn("analyzed", F.lit(False)), str(tmp_path / "i"))
    kept = caches.load_index(spark, str(tmp_path / "i"), files)
    assert rows(kept, "path") == [("/a",)]
    assert rows(caches.to_build(files, kept), "path") == [("/b",)]
    assert caches.to_build(files, kept, analyze=True).count() == caches.to_build(files, kept, force=True).count() == 2
    changed = spark.createDataFrame([("/a", 1, 9)], "path string, size long, mtime long")
    assert caches.load_index(spark, str(tmp_path / "i"), changed).count() == 0
