"""Repair of conversations against a search through all edits, and against SQL."""

import hashlib
import heapq
import random
import re

import duckdb
import pytest

from loglattice.llm import conversation as c

NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def search(rows, costs):
    """The cheapest audit, ASCII-least of these, and its turns: best first over all edits, step by step."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\r\x0b\x0c")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        initials = "".join(t[:1] for t in made)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, made, faults
        if not re.fullmatch("s?(ua)*u?", initials) or (at, audit) in done or len(made) > len(rows) + 2:
            continue
        done.add((at, audit))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + costs.insert, audit + "I", at, (*made, f"{name}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + costs.delete, audit + "D", at + 1, made))
            if faults[at] not in ("blank", "duplicate"):
                more = costs.truncated * (faults[at] == "truncated")
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*made, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + costs.rerole, audit + "R", at + 1, (*made, f"{name}:{text}")))


def conversation(rng, n):
    return sorted((rng.randint(0, n), rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(["yes.", "no!", "so", "", " ", f"text {rng.randint(0, 9)}?"])) for _ in range(n))


def test_cheapest_and_least():
    rng = random.Random(5)
    for case in range(400):
        costs = c.Costs() if case % 2 else c.Costs(rng.randint(1, 4), rng.randint(1, 6), rng.randint(1, 4), rng.randint(0, 6))
        rows = conversation(rng, rng.randint(0, 5))
        cost, audit, made, faults = search(rows, costs)
        got = c.repair_one(rows, costs)
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        assert got[5:] == (cost, audit, digest)
        assert got[1:4] == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert got[4] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))


def frame(spark, rows, parts):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, place long, key string").repartition(parts)


def test_over_many_ranges_and_stretches(spark, monkeypatch):
    """Long conversations lie in many ranges; results equal those of one task."""
    rng = random.Random(8)
    rows = [(k, *r) for k, n in enumerate([200, 1, 90, 3, 400, 2, 2, 150]) for r in conversation(rng, n)]
    rows += [(None, t, r, x) for t, r, x in conversation(rng, 60)] + [(9, None, "user", "one."), (9, None, None, None), (9, 4, "assistant", "two.")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in c.repair(frame(spark, rows, 7), size=16).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for key in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows if k == key]
        want[key] = c.repair_one(sorted(mine, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:])), c.Costs())
    assert got == want


@pytest.mark.parametrize("parts", [1, 5])
def test_damage_and_repair_equal_sql(spark, tmp_path, parts):
    rng = random.Random(parts)
    some = lambda x: None if rng.random() < 0.05 else x
    rows = [(some(k), some(t), some(r), some(x)) for k in range(60) for t, r, x in conversation(rng, rng.randint(0, 9))]
    frame(spark, rows, parts).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(c.SQL)
    order = lambda r: tuple((v is not None, v) for v in r)
    got = [tuple(r[n] for n in want.columns) for r in c.op13_conversations(spark, str(tmp_path)).collect()]
    assert sorted(got, key=order) == sorted(want.fetchall(), key=order)


def test_empty(spark):
    assert c.repair(frame(spark, [(1, 1, "user", "a.")], 1).filter("false")).count() == 0
