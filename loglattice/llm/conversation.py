"""Repair of the structure of conversations by the cheapest edits, the ASCII-least of these.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``.  An
automaton with four states reads that; what stands next is then known, so an
inserted or re-roled turn needs no name.  A macro edit is a run of insertions
with the edit of one turn: ``D, ID, K, R, IK`` and so forth.  These codes are
prefix-free, so of two audits over the same turns neither begins the other, and
the order of two that differ stays as it is whatever follows.  A layer (the turns
so far) hence keeps of each state its cost, the rank of its audit among the
layer's and a pointer; audits are read off the pointers at the end.

For the same reason stretches compose: of each the costs and ranks by state of
entry and of exit are all that the next needs.  Rows are dealt by ranges of
conversation and turn.  A conversation that lies within a range is repaired
there; of those at a range's ends, which may span many, stretches are tabled,
chained, one row each, and edited by all tasks.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.jumps import by_stretch
from .common import write_shared

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: By state: the state that a kept turn leads to, by its initial; and the one that an inserted or re-roled turn leads to.
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
MADE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NAMES = ("user", "user", "assistant", "user")
#: Insertions that lead from a state to the end.
TO_END = {START: 0, AFTER_S: 2, AFTER_U: 1, AFTER_A: 0}
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
#: Two insertions lead as far as any number of them.
CODES = tuple(sorted("I" * i + edit for i in range(3) for edit in "DKR"))
#: Turns of a conversation that one task edits, where it spans ranges.
STRETCH = 1 << 16
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


Moves = tuple[tuple[int, int, int, int], ...]


@functools.lru_cache(maxsize=256)
def moves(initial: str, fault: int, costs: Costs) -> Moves:
    """From which state a macro edit of such a turn leads to which, at what cost: of equal ends the best one, with its code's place."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state, (k, code) in itertools.product(range(4), enumerate(CODES)):
        at, cost = state, costs.insert * (len(code) - 1)
        for _ in code[:-1]:
            at = MADE[at]
        if code[-1] == "D":
            cost += costs.delete
        elif fault in (BLANK, DUPLICATE) or (code[-1] == "K" and (at, initial) not in KEPT):
            continue
        else:
            cost += costs.truncated * (fault == TRUNCATED) + costs.rerole * (code[-1] == "R")
            at = KEPT[at, initial] if code[-1] == "K" else MADE[at]
        best[state, at] = min(best.get((state, at), (cost, k)), (cost, k))
    return tuple((a, b, *v) for (a, b), v in best.items())


Layer = list[tuple[int, int] | None]


def forward(turns: Iterable[Moves], entry: int, pointers: bytearray | None = None) -> Layer:
    """Cost and rank of each state after the turns, None where none leads there; ``pointers`` gets a byte for each turn and state."""
    layer: Layer = [None] * 4
    layer[entry] = (0, 0)
    for options in turns:
        best: list[tuple[int, int, int, int] | None] = [None] * 4
        for a, b, cost, code in options:
            held = layer[a]
            if held is not None:
                key = (held[0] + cost, held[1], code, a)
                if best[b] is None or key < best[b]:
                    best[b] = key
        order = sorted({x[1:3] for x in best if x is not None})
        layer = [None if x is None else (x[0], order.index(x[1:3])) for x in best]
        if pointers is not None:
            pointers += bytes(255 if x is None else x[3] * len(CODES) + x[2] for x in best)
    return layer


def backward(pointers: bytearray, last: int) -> list[tuple[int, str]]:
    """The state before each turn, and the turn's code, on the best way to the state ``last``."""
    out = []
    for k in range(len(pointers) // 4 - 1, -1, -1):
        last, code = divmod(pointers[4 * k + last], len(CODES))
        out.append((last, CODES[code]))
    return out[::-1]


def ending(layer: Layer, costs: Costs) -> tuple[int, int]:
    """The least cost of a conversation, and the state that its last turn leads to."""
    cost, _, _, state = min((held[0] + costs.insert * TO_END[s], held[1], TO_END[s], s) for s, held in enumerate(layer) if held is not None)
    return cost, state


def produced(state: int, code: str, role: str = "", text: str = "") -> list[str]:
    """The turns that a macro edit leaves, as ``role:text``."""
    out = []
    for edit in code:
        if edit == "D":
            continue
        out.append(f"{NAMES[state]}:" if edit == "I" else f"{role}:{text}" if edit == "K" else f"{NAMES[state]}:{text}")
        state = KEPT[state, role[:1]] if edit == "K" else MADE[state]
    return out


def own_fault(text: str) -> int:
    """What is wrong with a text by itself."""
    bare = text.strip(SPACE)
    return BLANK if not bare else SOUND if bare[-1] in STOPS else TRUNCATED


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in LEGAL for a, b in itertools.pairwise(roles))


def repair_one(rows: list[tuple[int | None, str, str]], costs: Costs) -> tuple:
    """The result columns of one conversation, from its turns in order (number, role, text)."""
    seen, faults = set(), []
    for _, role, text in rows:
        fault = own_fault(text)
        if fault != BLANK:
            if (role, text) in seen:
                fault = DUPLICATE
            seen.add((role, text))
        faults.append(fault)
    pointers = bytearray()
    cost, last = ending(forward((moves(role[:1], f, costs) for (_, role, _), f in zip(rows, faults)), START, pointers), costs)
    way = backward(pointers, last)
    made = [x for (state, code), (_, role, text) in zip(way, rows) for x in produced(state, code, role, text)] + produced(last, "I" * TO_END[last])
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    audit = "".join(code for _, code in way) + "I" * TO_END[last]
    counts = (faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal_pairs([r for _, r, _ in rows]))
    return gaps, *counts, cost, audit, hashlib.sha256("\n".join(made).encode("utf-8", "replace")).hexdigest()


def _columns(made: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*made)) or [()] * 8
    return [*(pa.array(c, pa.int64()) for c in cols[:6]), *(pa.array(c, pa.string()) for c in cols[6:])]


_NAMES = ["gaps", *_COUNTS, "cost", "audit", "repaired_sha256"]
_ROW = ["place", "turn", "role", "text"]


def _within_ranges(costs: Costs):
    """Results of the conversations inside a range; the turns of its first and last one as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 33, 0
        key, held, first = None, [], True

        def out(keys: list, made: list[tuple], turns: list[tuple]) -> pa.RecordBatch:
            many = len(keys)
            raw = list(zip(*turns)) or [()] * 4
            done = [pa.concat_arrays([c, pa.nulls(len(turns), c.type)]) for c in _columns(made)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            rest = [pa.concat_arrays([pa.nulls(many, t), pa.array(c, t)]) for c, t in zip(raw, types)]
            return pa.RecordBatch.from_arrays([pa.array(keys + [key] * len(turns), pa.string()), *done, *rest], ["key", *_NAMES, *_ROW])

        for batch in batches:
            keys, made = [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "turn", "role", "text")]
            for k, *row in zip(*columns):
                if k != key and key is not None:
                    if first:
                        yield out([], [], held)
                        first = False
                    else:
                        keys.append(key)
                        made.append(repair_one([r[1:] for r in held], costs))
                    held = []
                key = k
                held.append((base + n, *row))
                n += 1
                if first and len(held) >= 4096:  # needn't wait for its end
                    yield out([], [], held)
                    held = []
            if keys:
                yield out(keys, made, [])
        if held:
            yield out([], [], held)

    return run


def _over_ranges(rows: DataFrame, costs: Costs, size: int) -> DataFrame:
    """``key`` and the result columns of conversations (``key, place, turn, role, text``) that may span ranges."""
    fault_of = F.when(F.regexp_extract("text", r"[^\x20\x09-\x0D]", 0) == "", BLANK).when(F.rtrim(F.col("text"), F.lit(SPACE)).rlike(r"[.!?]\z"), SOUND).otherwise(TRUNCATED)
    place, whole = F.col("place"), F.sha2(F.concat_ws("\0", F.octet_length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumns({"own": fault_of, "same": whole})
    before = rows.filter(F.col("own") != BLANK).groupBy("key", "same").agg(F.min("place").alias("first"))
    rows = rows.join(before, ["key", "same"], "left").withColumn("fault", F.when(place > F.col("first"), DUPLICATE).otherwise(F.col("own")))
    # Places rise by one within a range; a stretch lies in one.
    rows = rows.select(F.col("key").alias("file_id"), F.floor(place / size).alias("__stretch"), *_ROW, "fault")
    rows = write_shared(rows, "conversation-turns")

    def table(turns: pa.Table) -> Iterator[pa.RecordBatch]:
        roles, faults = turns.column("role").to_pylist(), turns.column("fault").to_pylist()
        options = [moves(r[:1], f, costs) for r, f in zip(roles, faults)]
        cells = [x for e in range(4) for held in forward(options, e) for x in (held or (None, None))]
        numbers = [t for t in turns.column("turn").to_pylist() if t is not None]
        counts = [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal_pairs(roles)]
        ends = [min(numbers, default=None), max(numbers, default=None), len(set(numbers))]
        key = turns.column("file_id")[0].as_py(), turns.column("__stretch")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([cells], pa.list_(pa.int64())), *(pa.array([x], pa.int64()) for x in counts + ends), pa.array([roles[0][:1]]), pa.array([roles[-1][:1]])], _TABLE)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretch by stretch: the way through a conversation, and its counts in the row of its last stretch."""
        held: list[dict] = []

        def finish() -> pa.RecordBatch:
            layer: Layer = [(0, 0), None, None, None]
            came = []
            for row in held:
                best: list[tuple[int, int, int, int] | None] = [None] * 4
                for e, b in itertools.product(range(4), range(4)):
                    cost, rank = row["cells"][8 * e + 2 * b : 8 * e + 2 * b + 2]
                    if layer[e] is not None and cost is not None:
                        key = (layer[e][0] + cost, layer[e][1], rank, e)
                        best[b] = key if best[b] is None else min(best[b], key)
                order = sorted({x[1:3] for x in best if x is not None})
                layer = [None if x is None else (x[0], order.index(x[1:3])) for x in best]
                came.append([None if x is None else x[3] for x in best])
            cost, last = ending(layer, costs)
            exits = [last]
            for row in came[:0:-1]:
                exits.append(row[exits[-1]])
            exits.reverse()
            entries = [START, *exits[:-1]]
            sums = [sum(r[c] for r in held) for c in _COUNTS]
            numbered = [r for r in held if r["low"] is not None]
            shared = 0
            for a, b in itertools.pairwise(held):
                sums[3] += a["last"] + b["first"] not in LEGAL
            for a, b in itertools.pairwise(numbered):
                shared += a["high"] == b["low"]
            gaps = numbered[-1]["high"] - numbered[0]["low"] + 1 - sum(r["distinct"] for r in numbered) + shared if numbered else 0
            total = [None] * (len(held) - 1)
            return pa.RecordBatch.from_arrays([pa.array([r["file_id"] for r in held]), pa.array([r["__stretch"] for r in held], pa.int64()), pa.array(entries, pa.int32()), pa.array(exits, pa.int32()), *(pa.array([*total, x], pa.int64()) for x in (gaps, *sums, cost))], _WAY)

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["file_id"] != row["file_id"]:
                    yield finish()
                    held = []
                held.append(row)
        if held:
            yield finish()

    def edit(turns: pa.Table) -> Iterator[pa.RecordBatch]:
        roles, texts, faults = (turns.column(c).to_pylist() for c in ("role", "text", "fault"))
        pointers, entry, last = bytearray(), turns.column("entry")[0].as_py(), turns.column("exit")[0].as_py()
        forward((moves(r[:1], f, costs) for r, f in zip(roles, faults)), entry, pointers)
        way = backward(pointers, last)
        made = [produced(s, code, r, t) for (s, code), r, t in zip(way, roles, texts)]
        audits = [code for _, code in way]
        if turns.column("cost")[0].as_py() is not None:  # the conversation's last stretch
            made[-1] += produced(last, "I" * TO_END[last])
            audits[-1] += "I" * TO_END[last]
        yield from pa.Table.from_arrays([turns.column("file_id"), turns.column("place"), pa.array(audits), pa.array(made, pa.list_(pa.string()))], ["file_id", "place", "audit", "made"]).to_batches(max_chunksize=1000)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A digest takes bytes in their order, so this is one task a conversation; it holds a letter or two for each turn."""
        key, audit, digest, some = None, [], hashlib.sha256(), False
        finish = lambda: pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["file_id", "audit", "repaired_sha256"])  # noqa: E731
        for batch in batches:
            for k, letters, made in zip(*(batch.column(c).to_pylist() for c in ("file_id", "audit", "made"))):
                if k != key:
                    if key is not None:
                        yield finish()
                    key, audit, digest, some = k, [], hashlib.sha256(), False
                audit.append(letters)
                for turn in made:
                    digest.update((b"\n" if some else b"") + turn.encode("utf-8", "replace"))
                    some = True
        if key is not None:
            yield finish()

    tables = by_stretch(rows, table, "file_id string, __stretch long, cells array<long>, blank long, duplicate long, truncated long, illegal long, low long, high long, distinct long, first string, last string", "place")
    ways = write_shared(tables.repartition("file_id").sortWithinPartitions("file_id", "__stretch").mapInArrow(chain, "file_id string, __stretch long, entry int, exit int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"), "conversation-ways")
    edited = by_stretch(rows.join(ways.select("file_id", "__stretch", "entry", "exit", "cost"), ["file_id", "__stretch"]), edit, "file_id string, place long, audit string, made array<string>", "place")
    whole = edited.repartition("file_id").sortWithinPartitions("file_id", "place").mapInArrow(assemble, "file_id string, audit string, repaired_sha256 string")
    return whole.join(ways.filter("cost is not null"), "file_id").select(F.col("file_id").alias("key"), *_NAMES)


_TABLE = ["file_id", "__stretch", "cells", *_COUNTS, "low", "high", "distinct", "first", "last"]
_WAY = ["file_id", "__stretch", "entry", "exit", "gaps", *_COUNTS, "cost"]


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), size: int = STRETCH) -> DataFrame:
    """``<id_col>, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    Turns stand by number, nulls first, equal numbers by role and text.  Null
    roles and texts count as one space, a null id as a conversation of its own;
    an empty role is no initial that may stay.  Repeated rows are duplicates of
    the first.  Empty texts are blank; a very long text only has to fit in
    memory.  Other columns are left out, whatever their names.  An empty table
    gives no row.  ``costs`` must be positive but for ``truncated``.
    """
    kind = rows.schema[id_col].dataType
    key = F.when(F.col(id_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(id_col).cast("string")))
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    turns = rows.select(key.alias("key"), F.col(turn_col).cast("long").alias("turn"), fill(role_col).alias("role"), fill(text_col).alias("text"))
    # The bounds hold the beginnings of texts only; order within a range is by all of them.
    dealt = turns.repartitionByRange("key", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("key", "turn", "role", "text")
    made = write_shared(dealt.mapInArrow(_within_ranges(costs), f"key string, {_RESULT}, place long, turn long, role string, text string"), "conversation-ranges")
    inside = made.filter("place is null").select("key", *_NAMES)
    out = inside.unionByName(_over_ranges(made.filter("place is not null").select("key", *_ROW), costs, size))
    return out.select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(kind).alias(id_col), *_NAMES)


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults of the contract, by the checksum of conversation and turn (nulls: one space)."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    case = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn"))) % 20
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.select("conv_id", "turn", fill("role").alias("role"), fill("text").alias("text"), case.alias("case")).filter(F.col("case") != 0)
    made = made.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("case") == 3, 2).otherwise(1).alias("n"))
    return made.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``, damaged and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = repair(damage(rows)).withColumnRenamed("conv_id", "__conv")
    ids = rows.select("conv_id").distinct()
    none = {n: F.coalesce(n, F.lit(0)) for n in _NAMES[:6]} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").withColumns(none).select("conv_id", *_NAMES)


_CHECKSUM = "xor(list_reduce(list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, j: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"
#: The same rows in DuckDB: audits as strings, turn by turn.
SQL = rf"""
WITH RECURSIVE hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CHECKSUM} % 20 AS k FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, (VALUES (1), (2)) c(n) WHERE k <> 0 AND (n = 1 OR k = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier,
    CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
         WHEN regexp_extract(text, '([^ 	-])[ 	-]*$', 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault
  FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pos > 1 AND concat(earlier, initial) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM judged GROUP BY conv_id),
inserts(src, mid, code, made) AS (VALUES
  (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
  (2, 2, '', []), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, '', []), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])),
edits(mid, dst, letter, initial, name) AS (VALUES
  (0, 1, 'K', 's', ''), (0, 2, 'K', 'u', ''), (1, 2, 'K', 'u', ''), (2, 3, 'K', 'a', ''), (3, 2, 'K', 'u', ''), (0, 2, 'R', '', 'user'), (1, 2, 'R', '', 'user'),
  (2, 3, 'R', '', 'assistant'), (3, 2, 'R', '', 'user'), (0, 0, 'D', '', ''), (1, 1, 'D', '', ''), (2, 2, 'D', '', ''), (3, 3, 'D', '', '')),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS best FROM damaged
  UNION ALL
  SELECT w.conv_id, j.pos, e.dst, min({{
    'c': w.best.c + 5 * length(i.code) + CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.letter <> 'D' AND j.fault = 3 THEN 5 ELSE 0 END,
    'a': w.best.a || i.code || e.letter,
    't': list_concat(w.best.t, i.made, CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [e.name || ':' || j.text] END)}})
  FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.pos = w.pos + 1 JOIN inserts i ON i.src = w.state
    JOIN edits e ON e.mid = i.mid AND (e.letter <> 'K' OR e.initial = j.initial) AND (e.letter = 'D' OR j.fault NOT IN (1, 2))
  GROUP BY w.conv_id, j.pos, e.dst),
ends(state, code, made) AS (VALUES (0, '', []::VARCHAR[]), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])),
mended AS (
  SELECT w.conv_id, min({{'c': w.best.c + 5 * length(e.code), 'a': w.best.a || e.code, 't': list_concat(w.best.t, e.made)}}) AS best
  FROM walk w JOIN counted n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.pos JOIN ends e ON e.state = w.state GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(m.best.c, 0)::BIGINT AS cost, coalesce(m.best.a, '') AS audit, sha256(coalesce(array_to_string(m.best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
"""
