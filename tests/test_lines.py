import random

import pytest

from loglattice.sources.lines import COLUMNS

from .helpers import lines_frame, rows


def plain_lines(text):
    out, at = [], 0
    data = (text or "").encode()
    pieces = data.split(b"\n")
    for k, p in enumerate(pieces):
        last = k == len(pieces) - 1
        if last and not p:
            break
        end = at + len(p) + (not last)
        line = p[:-1] if p.endswith(b"\r") else p
        out.append((k + 1, at, end, line.decode()))
        at = end
    return out


@pytest.mark.parametrize("text", ["", None, "a", "a\n", "\n", "\n\n", "é\nß\n\nx", "a\r\nb\r\n", "x\n" * 500 + "end"])
def test_edges(spark, text):
    got = rows(lines_frame(spark, {"f": text}), *COLUMNS[1:])
    assert got == plain_lines(text)


def test_many_files_and_partitions(spark):
    rng = random.Random(1)
    files = {f"f{k}": "".join(rng.choice("ab é\n\r") for _ in range(rng.randrange(80))) for k in range(60)}
    want = sorted((f, *line) for f, t in files.items() for line in plain_lines(t))
    for parts in (1, 4, 17):
        assert rows(lines_frame(spark, files, parts), *COLUMNS) == want


def test_empty_table(spark):
    assert lines_frame(spark, {"f": "a"}).filter("false").count() == 0
