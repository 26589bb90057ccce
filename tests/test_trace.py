import random
import re

import pytest

from loglattice.functions.patterns import PatternSet
from loglattice.operators import trace

from .helpers import lines_frame, rows

TEXT = "an error occurred\nfine\nERROR é error\nwarn: error\n\nlast warn"


def found(spark, *patterns, flags=()):
    return rows(trace.matches(lines_frame(spark, {"f": TEXT}), PatternSet.of(*patterns, flags=flags)), "pattern_id", "line_number", "offset")


def test_attribution(spark):
    assert found(spark, "error", "warn") == [("p1", 1, 0), ("p1", 3, 23), ("p1", 4, 38), ("p2", 4, 38), ("p2", 6, 51)]


def test_shadowed_pattern_is_not_reported(spark):
    assert found(spark, "error", "error occurred") == [("p1", 1, 0), ("p1", 3, 23), ("p1", 4, 38)]
    assert found(spark, "error occurred", "error")[0] == ("p1", 1, 0)


def test_flags(spark):
    assert [r[1] for r in found(spark, "ERROR", flags=("-i",))] == [1, 3, 4]
    assert [r[1] for r in found(spark, "err", flags=("-w",))] == []
    assert [r[1] for r in found(spark, "fine", flags=("-x",))] == [2]
    assert [r[1] for r in found(spark, "warn:", flags=("-F",))] == [4]
    assert [r[1] for r in found(spark, "w.rn", flags=("-F",))] == []


def test_submatches_are_bytes(spark):
    line = "é ab ü ab"
    got = trace.matches(lines_frame(spark, {"f": line}), PatternSet.of("ab", "ü")).filter("pattern_id = 'p1'").first()["submatches"]
    data = line.encode()
    assert [(s["text"], s["start"], s["end"]) for s in got] == [(m[0].decode(), m.start(), m.end()) for m in re.finditer("ab|ü".encode(), data)]


def test_context_and_limit(spark):
    lines = lines_frame(spark, {"f": TEXT, "f10": TEXT, "f2": TEXT})
    hits = trace.matches(lines, PatternSet.of("warn"))
    around = trace.contexts(hits.filter("file_id = 'f' and line_number = 4"), lines, 2, 1)
    assert [r[0] for r in rows(around, "line_number")] == [2, 3, 4, 5]
    assert [(r["file_id"], r["line_number"]) for r in trace.ordered(hits, 4).collect()] == [("f", 4), ("f", 6), ("f10", 4), ("f10", 6)]
    assert len(trace.context_map(trace.contexts(hits, lines, 0, 0)).collect()) == 6


@pytest.mark.parametrize("flags", [(), ("-i",), ("-w",), ("-F",), ("-i", "-x")])
def test_many_patterns_give_the_rows_of_few(spark, monkeypatch, flags):
    """Patterns with and without known texts, shadowed ones, other alphabets, empty lines."""
    rng = random.Random(len(flags))
    parts = ["ab", "abc", "b+c", "(?:ca|bb)", "a.c", "[ab]{2}", "é", "c?", "x|ca", "(ab)+c", "K", "ſs", "a{2,}b", "^ab", "ca$", "\\bab", "\\Qa.b\\E", "(?i)AB", "."]
    patterns = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(30)]
    text = "\n".join("".join(rng.choice("aabbcc éKkſsS\u212a.") for _ in range(rng.randint(0, 14))) for _ in range(300))
    lines = lines_frame(spark, {"f": text, "g": "", "h": "\n\nab"}, 3)
    monkeypatch.setattr(trace, "MANY", 1000)
    columns = ("pattern_id", "file_id", "line_number", "offset", "line_text", "submatches")
    want = rows(trace.matches(lines, PatternSet.of(*patterns, flags=flags)), *columns)
    monkeypatch.setattr(trace, "MANY", 1)
    for piece in (1 << 20, 40):
        monkeypatch.setattr("loglattice.operators.prefilter.PIECE", piece)
        assert rows(trace.matches(lines, PatternSet.of(*patterns, flags=flags)), *columns) == want
    assert want or flags == ("-F",)


def test_required_texts():
    from loglattice.functions.literals import required

    assert required("error: (\\d+) at line") == (" at line",) and required("(?:foo|barx)[0-9]") == ("barx", "foo")
    assert required("(warn|fatal)+ing") == ("fatal", "warn") and required("a?b*") is None and required("x") is None
    assert required("a.b", fixed=True) == ("a.b",) and required("ÄBCd", fold=True) == ("bcd",)
    for foreign in ("\\Qabc\\E", "(?i)abc", "[a-z&&[abc]]xyz", "abc\\vdef", "\\p{L}abc", "(abc", "\\habc"):
        assert required(foreign) is None
    rng = random.Random(1)
    for _ in range(3000):
        p = "".join(rng.choice(["a", "b", "ab", "c", "(a|bc)", "(?:ab)?", "[ab]", "b+", "(ca){2}", ".", "|", "^", "$", "(?:b|)"]) for _ in range(rng.randint(1, 6)))
        texts = required(p)
        for _ in range(5 if texts else 0):
            x = "".join(rng.choice("abc") for _ in range(8))
            assert not re.search(p, x) or any(t in x for t in texts), (p, x, texts)


def test_bad_pattern(spark):
    with pytest.raises(ValueError, match="p2"):
        trace.matches(lines_frame(spark, {"f": TEXT}), PatternSet.of("a", "(")).collect()
    with pytest.raises(ValueError):
        PatternSet.of()


def test_stream_gives_the_batch_rows(spark, tmp_path):
    from loglattice.streaming import trace as live

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text(TEXT)
    out = live.trace(live.read(spark, str(tmp_path / "in")), PatternSet.of("error", "warn"))
    q = out.select("pattern_id", "line_text").writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("live").collect()) == sorted((p, TEXT.split("\n")[n - 1]) for p, n, _ in found(spark, "error", "warn"))


def test_growing_files(spark, tmp_path):
    """Files that grow by pieces cut anywhere, over a restart, give the lines and matches of the whole files."""
    from loglattice.sources.files import read_lines
    from loglattice.streaming import tail
    from loglattice.streaming import trace as live

    rng = random.Random(7)
    texts = {f"f{k}.log": "".join(rng.choice(["an error é", "warn", "", "x" * rng.randint(0, 40), "crlf\r"]) + "\n" for _ in range(150)).encode() for k in range(3)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "old.gz").write_bytes(b"\x1f\x8b")
    at, out = dict.fromkeys(texts, 0), str(tmp_path / "out")
    for _ in range(3):
        lines = tail.numbered(tail.read(spark, str(tmp_path / "in"), split_bytes=300))
        query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
        for _ in range(2):
            for name, data in texts.items():
                more = rng.randint(0, len(data) // 3)
                with open(tmp_path / "in" / name, "ab") as f:
                    f.write(data[at[name] : at[name] + more])
                at[name] += more
            query.processAllAvailable()
        query.stop()
    got = spark.read.schema("file_id string, line_number long, start_offset long, end_offset long, line string").parquet(out)
    (tmp_path / "in" / "old.gz").unlink()
    whole = read_lines(spark, str(tmp_path / "in"))
    # A last line without its line feed hasn't come yet.
    open_ = {str(tmp_path / "in" / n): d[: at[n]].rfind(b"\n") + 1 for n, d in texts.items()}
    columns = ("file_id", "line_number", "start_offset", "end_offset", "line")
    want = [r for r in rows(whole, *columns) if r[2] < open_[r[0]]]
    assert rows(got, *columns) == want and len(want) > 100
    hits = lambda x: rows(live.trace(x, PatternSet.of("error", "warn")), "pattern_id", "file_id", "line_number", "offset")
    assert hits(got) == [h for h in hits(whole) if h[3] < open_[h[1]]]
