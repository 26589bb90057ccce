import bz2
import gzip
import lzma
import random
import socket

import pytest
import zstandard

from loglattice.functions import text as fn
from loglattice.sources import files, guards, seekable
from pyspark.sql import functions as F

from .helpers import rows
from .test_lines import plain_lines

TEXT = "".join(f"line {k} é\n" for k in range(300)) + "end"


@pytest.fixture
def folder(tmp_path):
    data = TEXT.encode()
    for name, packed in {"a.log": data, "b.log.gz": gzip.compress(data), "c.bz2": bz2.compress(data), "d.xz": lzma.compress(data), "e.zst": zstandard.compress(data)}.items():
        (tmp_path / name).write_bytes(packed)
    return tmp_path


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_read_lines(spark, folder, split):
    got = files.read_lines(spark, str(folder), split)
    for name in ("a.log", "b.log.gz", "c.bz2", "d.xz", "e.zst"):
        mine = got.filter(F.col("file_id").endswith(name))
        assert rows(mine, "line_number", "start_offset", "end_offset", "line") == plain_lines(TEXT)


@pytest.mark.parametrize("split", [20_000, 90_000, 1 << 20])
@pytest.mark.parametrize("end", ["", "\n"])
def test_large_compressed_files_are_split_by_blocks(spark, tmp_path, split, end):
    """Blocks of bzip2, of several streams too, and of xz; lines longer than blocks and splits without any begin."""
    rng = random.Random(3)
    text = "".join(f"{k} {rng.random()} é\r\n" if k % 5 else f"{k}\n" for k in range(30_000)) + "x" * 300_000 + "\n" + "\n" * 50 + "last" + end
    data = text.encode()
    (tmp_path / "a.bz2").write_bytes(bz2.compress(data, 1))
    (tmp_path / "b.bz2").write_bytes(b"".join(bz2.compress(data[a : a + 150_001], 2) for a in range(0, len(data), 150_001)))
    (tmp_path / "c.xz").write_bytes(b"".join(lzma.compress(data[a : a + 100_003]) for a in range(0, len(data), 100_003)))
    (tmp_path / "d.bz2").write_bytes(bz2.compress(b"one"))
    got = files.read_lines(spark, str(tmp_path), split)
    want = plain_lines(text)
    for name in ("a.bz2", "b.bz2", "c.xz"):
        assert rows(got.filter(F.col("file_id").endswith(name)), "line_number", "start_offset", "end_offset", "line") == want
    assert rows(got.filter(F.col("file_id").endswith("d.bz2")), "line_number", "line") == [(1, "one")]
    if split < 100_000:
        tasks = files.read_splits(spark, str(tmp_path), files.splits_of({str(tmp_path / n): (tmp_path / n).stat().st_size for n in ("a.bz2", "c.xz")}, split))
        assert all(r["n"] > 2 for r in tasks.groupBy("file_id").agg(F.countDistinct("split").alias("n")).collect())


def test_counts_of_splits_are_kept(spark, folder, tmp_path_factory):
    """Without decoding; a later scan reads no counts anew, a changed file's are counted again."""
    kept = str(tmp_path_factory.mktemp("counts") / "c")
    for _ in range(2):
        got = files.read_lines(spark, str(folder), 100, kept)
        assert rows(got.filter(F.col("file_id").endswith("a.log")), "line_number", "start_offset", "end_offset", "line") == plain_lines(TEXT)
    n = spark.read.parquet(kept).count()
    (folder / "a.log").write_bytes(b"new\n" * 90)
    assert rows(files.read_lines(spark, str(folder), 100, kept).filter(F.col("file_id").endswith("a.log")), "line_number") == [(k,) for k in range(1, 91)]
    assert spark.read.parquet(kept).count() == n + 4
    one = files.read_lines(spark, str(folder / "a.log"))  # a single split needs no counts
    assert "linecounts" not in one._jdf.queryExecution().toString().lower() and one.count() == 90


def test_catalog(spark, folder):
    (folder / "z.bin").write_bytes(b"a\0b")
    (folder / "noext").write_bytes(gzip.compress(b"x"))
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["text"]) for r in files.catalog(spark, str(folder)).collect()}
    assert got == {"a.log": ("", True), "b.log.gz": ("gzip", True), "c.bz2": ("bz2", True), "d.xz": ("xz", True), "e.zst": ("zstd", True), "z.bin": ("", False), "noext": ("gzip", True)}


def test_reader_leaves_binaries_out_and_knows_formats(spark, folder):
    (folder / "z.bin").write_bytes(b"a\0b\n")
    (folder / "noext").write_bytes(gzip.compress(b"one\ntwo\n"))
    (folder / "t.tar.gz").write_bytes(gzip.compress(b"x\0y\n", mtime=0))
    got = files.read_lines(spark, str(folder), 64)
    assert {f.rsplit("/", 1)[1] for (f,) in got.select("file_id").distinct().collect()} == {"a.log", "b.log.gz", "c.bz2", "d.xz", "e.zst", "noext"}
    assert rows(got.filter(F.col("file_id").endswith("noext")), "line_number", "line") == [(1, "one"), (2, "two")]
    assert {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in files.skipped(files.catalog(spark, str(folder))).collect()} == {("z.bin", "binary"), ("t.tar.gz", "binary")}


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_seekable_files_are_split_by_frames(spark, tmp_path, split):
    """Frames that end with a line, and frames that don't."""
    data = TEXT.encode()
    press = zstandard.ZstdCompressor().compress
    for name, pieces in {"lines.zst": seekable.cut_frames(data, 200), "bytes.zst": [data[a : a + 137] for a in range(0, len(data), 137)]}.items():
        packed = [press(p) for p in pieces]
        (tmp_path / name).write_bytes(b"".join(packed) + seekable.seek_table([(len(a), len(b)) for a, b in zip(packed, pieces)]))
    got = files.read_lines(spark, str(tmp_path), split)
    for name in ("lines.zst", "bytes.zst"):
        assert rows(got.filter(F.col("file_id").endswith(name)), "line_number", "start_offset", "end_offset", "line") == plain_lines(TEXT)


def test_ranges_and_indexed_samples(spark, folder):
    from loglattice.operators import index, samples, seek

    lines = files.read_lines(spark, str(folder))
    built = index.build(lines, 512)
    want = samples.by_line(lines, "3, 40-44, 250, -2")
    got = seek.by_line(built, str(folder), "3, 40-44, 250, -2")
    columns = ("file_id", "key", "line_number", "start_offset", "line", "is_target")
    assert rows(got, *columns) == rows(want, *columns)
    for spec, before, after in (("0, 700, 2999, -1, -400", 2, 3), ("100-900, 9999, 3000-99999", 1, 1), ("5", 0, 0)):
        assert rows(seek.by_offset(built, str(folder), spec, before, after), *columns) == rows(samples.by_offset(lines, spec, before, after), *columns)
    places = {r["line_number"]: r["start_offset"] for r in lines.filter(F.col("file_id").endswith("a.log")).collect()}
    some = files.read_ranges(spark, str(folder), [(str(folder / "a.log"), places[50], places[60], 50)])
    assert rows(some, "line_number") == [(k,) for k in range(50, 60)]


def test_matches_are_read_at_their_places(spark, folder):
    """Contexts and kept matches over plain and compressed files equal those by a join; no shuffle in the plan."""
    from loglattice.functions.patterns import PatternSet
    from loglattice.operators import seek, trace

    lines = files.read_lines(spark, str(folder), 500)
    found = trace.matches(lines, PatternSet.of("1[0-9] ", "^line 0", "end"))
    for before, after in ((0, 0), (2, 3), (400, 400)):
        got = seek.contexts(found, str(folder), before, after)
        columns = ("pattern_id", "file_id", "match_offset", "line_number", "line_offset", "line_text")
        assert rows(got, *columns) == rows(trace.contexts(found, lines, before, after), *columns)
    kept = spark.createDataFrame(found.select("pattern_id", "file_id", "offset", "line_number").collect(), "pattern_id string, file_id string, offset long, line_number long")
    again = seek.reconstruct(kept, str(folder))
    assert rows(again, "pattern_id", "file_id", "offset", "line_number", "line_text") == rows(found, "pattern_id", "file_id", "offset", "line_number", "line_text")
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("packed", [lambda d: d, gzip.compress, lambda d: b"".join(lzma.compress(d[a : a + 90_000]) for a in range(0, len(d), 90_000))])
def test_places_read_little(tmp_path, packed, monkeypatch):
    """Any line, from any place; of files that can be entered only what lies around it."""
    from loglattice.sources import places

    monkeypatch.setattr(places, "HELD", 70_000)
    rng = random.Random(4)
    text = "".join("x" * rng.choice([0, 3, 70, 70_000 if rng.random() < 0.01 else 5]) + rng.choice(["\n", "\r\n", "é\n"]) for _ in range(6000)) + rng.choice(["", "tail"])
    data = text.encode()
    (tmp_path / "f").write_bytes(packed(data))
    want = [(a, b, line) for _, a, b, line in plain_lines(text)]
    file = places.Places(str(tmp_path), str(tmp_path / "f"))
    starts = [a for a, _, _ in want]
    assert list(file.lines(0)) == want
    for _ in range(60):
        k = rng.randrange(len(want))
        assert file.start_of(rng.randrange(want[k][0], want[k][1])) == starts[k]
        back = rng.choice([0, 1, 5, 900])
        assert file.back(starts[k], back) == starts[max(0, k - back) : k]
        assert [x for _, x in zip(range(3), file.lines(starts[k]))] == want[k : k + 3]
    assert file.start_of(len(data)) is None
    file.bytes_read = 0
    file.back(len(data), 5), next(file.lines(starts[-3]))
    assert file.bytes_read < 300_000 < len(data)


def test_tail(spark, folder):
    from loglattice.operators import seek

    (folder / "feed.log").write_bytes(b"a\n\nb\n")
    (folder / "empty.log").write_bytes(b"")
    listed = files.catalog(spark, str(folder)).filter("path like '%.log'").select(F.col("path").alias("file_id"), F.col("size").alias("byte_count"))
    got = seek.tail(listed, str(folder), 2)
    assert rows(got.filter("file_id like '%/a.log'"), "from_end", "line") == [(1, "end"), (2, "line 299 é")]
    assert rows(got.filter("file_id like '%/feed.log'"), "from_end", "start_offset", "line") == [(1, 3, "b"), (2, 2, "")]
    assert got.filter("file_id like '%/empty.log'").count() == 0 and seek.tail(listed, str(folder), 99).filter("file_id like '%feed.log'").count() == 3


def test_search_ends_early(spark, tmp_path):
    """The rows of a whole search, from as few splits as hold them."""
    from loglattice.functions.patterns import PatternSet
    from loglattice.operators import early, trace

    for k in range(6):
        (tmp_path / f"f{k}").write_text("".join(f"line {i} {'error ' * (i % 9 == k % 3)}{'warn' * (i % 7 == 0)}\n" for i in range(500)))
    (tmp_path / "f6.bz2").write_bytes(bz2.compress(b"error\n" * 500))
    patterns = PatternSet.of("error", "warn")
    whole = trace.ordered(trace.matches(files.read_lines(spark, str(tmp_path)), patterns))
    want = [tuple(r) for r in whole.collect()]
    read = []
    for most in (1, 40, 300, 5000):
        first = early.first_matches(spark, str(tmp_path), patterns, most, split_bytes=2000, wave=1)
        assert [tuple(r) for r in first.rows.collect()] == want[:most]
        read.append(first.splits_read)
    assert read[0] == 1 and read[1] <= 3 and read == sorted(read) and read[-1] == first.splits > 15
    assert early.first_matches(spark, str(tmp_path), PatternSet.of("zzz"), 5).rows.count() == 0
    (tmp_path / "none").mkdir()
    assert early.first_matches(spark, str(tmp_path / "none"), patterns, 5).rows.count() == 0


def test_decode_frames_and_ranges(spark):
    data = TEXT.encode()
    packed = seekable.encode(spark.createDataFrame([("f", bytearray(data)), ("g", bytearray(data[:100]))], "path string, content binary"), frame_bytes=300)
    pieces = seekable.cut_frames(data, 300)
    wanted = spark.createDataFrame([("f", 2), ("f", 0), ("f", 99), ("g", 0)], "file_id string, frame int")
    assert {(r["file_id"], r["frame"]): bytes(r["content"]) for r in seekable.decode(packed, wanted).collect()} == {("f", 2): pieces[2], ("f", 0): pieces[0], ("g", 0): data[:100]}
    assert rows(seekable.frame_line_counts(packed).filter("file_id = 'f'"), "frame", "lines") == [(k, p.count(b"\n")) for k, p in enumerate(pieces)]
    ranges = spark.createDataFrame([("f", 10, 1500), ("f", 290, 310), ("g", 0, 1000)], "file_id string, low long, high long")
    assert {(r["file_id"], r["low"]): bytes(r["content"]) for r in seekable.decode_range(packed, ranges).collect()} == {("f", 10): data[10:1500], ("f", 290): data[290:310], ("g", 0): data[:100]}


def test_frames_of_files(spark, tmp_path):
    """Frames read at their places, without whole files in cells."""
    from loglattice.operators import frames

    data = TEXT.encode()
    pieces = seekable.cut_frames(data, 300)
    packed = [zstandard.compress(p) for p in pieces]
    (tmp_path / "a.zst").write_bytes(b"".join(packed) + seekable.seek_table([(len(a), len(b)) for a, b in zip(packed, pieces)]))
    (tmp_path / "b.zst").write_bytes(zstandard.compress(data))
    (tmp_path / "c").write_bytes(b"x")
    table = frames.of_files(files.catalog(spark, str(tmp_path)).select(F.col("path").alias("file_id")), str(tmp_path))
    assert {r[0].rsplit("/", 1)[1] for r in table.select("file_id").distinct().collect()} == {"a.zst"} and table.count() == len(pieces)
    ranges = spark.createDataFrame([(str(tmp_path / "a.zst"), 250, 700)], "file_id string, low long, high long")
    wanted = table.join(frames.overlapping(table, ranges).select("file_id", "frame"), ["file_id", "frame"])
    assert {r["frame"]: bytes(r["content"]) for r in frames.content(wanted, str(tmp_path)).collect()} == dict(enumerate(pieces[:3]))
    assert rows(frames.line_counts(table, str(tmp_path)), "frame", "lines") == [(k, p.count(b"\n")) for k, p in enumerate(pieces)]


@pytest.mark.parametrize("split", [100, 1 << 20])
def test_compress_files(spark, folder, tmp_path_factory, split):
    """Frames from many splits, in order; compressed files are left out."""
    from loglattice.sources.compress import compress_files

    (folder / "empty.log").write_bytes(b"")
    (folder / "crlf.log").write_bytes(b"a\r\n" * 200)
    out = tmp_path_factory.mktemp("out")
    made = compress_files(spark, str(folder), str(out), 150, 3, split).collect()
    assert {f.name for f in out.iterdir() if not f.name.startswith(".")} == {"a.log.zst", "crlf.log.zst"}
    assert not [f for f in out.iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]
    for name, data in (("a.log", TEXT.encode()), ("crlf.log", b"a\r\n" * 200)):
        stored = (out / f"{name}.zst").read_bytes()
        assert zstandard.ZstdDecompressor().stream_reader(stored, read_across_frames=True).read() == data
        frames = seekable.read_seek_table(stored)
        (row,) = [r for r in made if r["file_id"].endswith(name)]
        assert (row["plain_size"], row["packed_size"], row["frames"]) == (len(data), len(stored), len(frames)) and len(frames) > 3
    assert rows(files.read_lines(spark, str(out), 64).filter(F.col("file_id").endswith("a.log.zst")), "line_number", "line") == [(n, line) for n, _, _, line in plain_lines(TEXT)]


def test_shell(spark, folder, tmp_path_factory, capsys):
    from loglattice.__main__ import main

    kept = str(tmp_path_factory.mktemp("kept") / "index")
    said = lambda *args: (main(list(args)), capsys.readouterr().out)
    code, out = said("trace", str(folder / "a.log"), "-e", "line 7 ")
    assert code == 0 and "[line 7 ] offset=" in out and out.endswith("--- 1 matches in 1 files (skipped 0) ---\n")
    assert said("trace", str(folder / "a.log"), "-e", "zzz") == (0, "no matches in 1 files\n")
    assert said("trace", str(folder), "-e", "(")[0] == 5 and said("trace", str(folder / "none"), "-e", "x")[0] == 3
    assert said("samples", str(folder / "a.log"), "-l", "x")[0] == 2
    assert "> 5: line 4 é" in said("samples", str(folder / "a.log"), "-l", "5")[1]
    assert said("index", str(folder), "--cache", kept) == (0, "no files indexed\n")
    code, out = said("index", str(folder / "a.log"), "--cache", kept, "--analyze")
    assert code == 0 and "301 lines, 1 checkpoints" in out
    assert "no files indexed" in said("index", str(folder / "a.log"), "--cache", kept, "--analyze")[1]
    assert "index built" not in said("index", str(folder / "a.log"), "--cache", kept, "--analyze", "--force")[1]
    assert "1 entries, analysis=True" in said("index", str(folder / "a.log"), "--cache", kept, "--info")[1]
    assert said("index", str(folder / "a.log"), "--cache", kept, "--delete") == (0, f"deleted index for {folder}/a.log\n")
    assert "no index exists" in said("index", str(folder / "a.log"), "--cache", kept, "--info")[1]


def test_shell_uses_what_is_kept(spark, folder, tmp_path_factory, capsys):
    """The same output with a cache, at first and again, and after a file has changed."""
    from loglattice.__main__ import main

    cache = str(tmp_path_factory.mktemp("kept") / "c")
    said = lambda *args: (main(list(args)), capsys.readouterr().out)
    path = str(folder)
    searches = [("trace", path, "-e", "line 7", "-e", "é"), ("trace", path, "-e", "zzz"), ("trace", path, "-e", "line 29[0-9]", "-B", "1"), ("samples", path, "-l", "5, -2, 20-24"), ("samples", path, "-b", "700, 100-300", "-A", "1")]
    for _ in range(2):
        for args in searches:
            want = said(*args)
            for _ in range(2):
                assert said(*args, "--cache", f"{cache}-{args[0]}") == want
        (folder / "a.log").write_text("line 7 é\n" * 300)
    assert said("trace", path, "-e", "é", "-e", "line 7", "--cache", f"{cache}-trace")[1].count("[line 7]") == said(*searches[0])[1].count("[line 7]")
    first = said("trace", path, "-e", "line", "-m", "7")[1].splitlines()
    assert len(first) == 8 and first[:7] == said("trace", path, "-e", "line")[1].splitlines()[:7]


def test_seekable_round_trip(spark):
    data = TEXT.encode()
    plain = spark.createDataFrame([("f", bytearray(data)), ("empty", bytearray(b""))], "path string, content binary")
    packed = seekable.encode(plain, frame_bytes=500)
    assert rows(seekable.frame_lines(packed).filter("file_id = 'f'"), "line_number", "start_offset", "end_offset", "line") == plain_lines(TEXT)
    table = seekable.frames(packed).filter("file_id = 'f'")
    assert table.count() > 5 and table.agg(F.sum("decompressed_size")).first()[0] == len(data)
    content = packed.filter("file_id = 'f'").first()["content"]
    assert seekable.is_seekable(content)
    assert zstandard.ZstdDecompressor().stream_reader(bytes(content), read_across_frames=True).read() == data
    for bad in (b"", b"123456789", b"x" * 40):
        with pytest.raises(ValueError):
            seekable.read_seek_table(bad)


def test_paths(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "link").symlink_to("/etc")
    assert guards.within_roots(f"{tmp_path}/in/new/file", [f"{tmp_path}/in"])
    for bad in (f"{tmp_path}/in/../x", f"{tmp_path}/in/link/passwd", f"{tmp_path}/inside"):
        with pytest.raises(PermissionError):
            guards.within_roots(bad, [f"{tmp_path}/in"])


def test_webhooks():
    public = lambda *a: [(socket.AF_INET, 0, 0, "", ("93.184.216.34", 80))]
    inner = lambda *a: [(socket.AF_INET, 0, 0, "", ("10.0.0.1", 80))]
    assert guards.check_webhook("https://example.org/x", public)
    for url, resolve in (("ftp://example.org", public), ("http://127.0.0.1/", public), ("http://[::1]/", public), ("http://100.64.0.1/", public), ("http://example.org/", inner)):
        with pytest.raises(ValueError):
            guards.check_webhook(url, resolve)
    assert guards.effective(None, "a", False) == "a" and guards.effective("", "a", False) is None and guards.effective("b", "a", True) == "a"


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert [value(fn.human_size(F.lit(n))) for n in (0, 1536, -2048, 5 << 20)] == ["0.00 B", "1.50 KB", "-2.00 KB", "5.00 MB"]
    assert [value(fn.shell_quote(F.lit(x))) for x in ("", "a/b", "a b", "it's")] == ["''", "a/b", "'a b'", "'it'\"'\"'s'"]
    assert [value(fn.frame_size(F.lit(x))) for x in ("4M", "1.5 gb", "300", "7B", "x", "")] == [4 << 20, 3 << 29, 300, 7, None, None]
    assert value(fn.bracket_delta(F.lit('{"a": "}\\"{", [ "x'))) == 2
    assert value(fn.trim_newline(F.lit("a\r\n"))) == "a" and value(fn.is_blank(F.lit(" \t"))) and value(fn.indent(F.lit("\t a"))) == 2
    assert value(fn.patterns_hash(["b", "a"], ["-i"])) == value(fn.patterns_hash(["a", "b"], ["--color", "-i"])) != value(fn.patterns_hash(["a", "b"], []))
