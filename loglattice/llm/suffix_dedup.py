"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A sort of all suffixes would shuffle one row for each byte.  So candidates are
thinned first: of each window of ``length`` bytes the 50-byte gram with the
least hash is its *anchor*, and all windows with one anchor are one *block*.
Equal windows have equal anchors at equal offsets, so only blocks with equal
grams can share a window; there is about one in 75 bytes, and one for each byte
where a text repeats a single byte.  This loses nothing.

What is left is sorted most significant digit first, and what stands alone
leaves after each pass:

* First digit: the anchor gram.  Grams with one block leave; equal blocks are
  equal through ``length`` bytes in all their windows, so these are repeated.
* Then, within grams that have several different blocks, the suffixes that
  start at each window, by 8 bytes a pass through ``length`` bytes: groups of
  two or more that are left are exactly the repeated windows.

The second part runs within a task, which holds one run of whole grams at a
time.  A gram with over ``GROUP_BLOCKS`` blocks is sorted over all tasks
instead, by digits that are whole cells of windows, 16, 4, and 1 wide, with
counts as partial aggregates and joins on 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_shared, give_back, release_shuffles, slices, small_batches, text_of, write_shared

LENGTH = 200
GRAM = 50
#: Blocks of one gram that a task compares by itself; more are compared over all tasks.
GROUP_BLOCKS = 256
#: Windows in a cell, pass by pass, where blocks are compared over all tasks.
CELLS = (16, 4, 1)
#: Bytes that are hashed, or sorted, at once; positions in them fit the low bits of a key.
RUN = 1 << 18
_POSITION_BITS = 23
_BASE = 0x5851F42D4C957F2D  # odd multipliers of 64 bits
_STIR = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, RUN + 1024)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), RUN + 1024)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _POWER[: len(data)], dtype=np.uint64)])
    x = (run[gram:] - run[:-gram]) * _INVERSE[: len(data) - gram + 1]
    x ^= x >> np.uint64(32)
    x *= _STIR
    x ^= x >> np.uint64(29)
    return x


def anchors(data: np.ndarray, length: int, gram: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, distance from the first window, and gram hash of each anchor.

    ``starts`` are the ascending starts of the windows.  An anchor is the
    leftmost gram with the least hash in a window.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_hashes(data, gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    at = (least[starts] & low).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    return starts[first], np.diff(first, append=len(at)), at[first] - starts[first], hashes[at[first]]


def runs(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several texts, or of a part of a long one, with the starts of their windows.

    Also gives, for each start, the text it belongs to, and for each text its
    first byte's place in the run.
    """
    held, size = [], 0

    def out(held: list[tuple[int, int, bytes]]):
        many = np.array([max(0, len(b) - length + 1) for _, _, b in held], np.int64)
        place = np.cumsum([0, *(len(b) for _, _, b in held)])[:-1]
        owner = np.repeat(np.arange(len(held)), many)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        text = np.array([k for k, _, _ in held], np.int64)
        shift = np.array([s for _, s, _ in held], np.int64) - place
        return b"".join(b for _, _, b in held), place[owner] + within, text[owner], shift[owner]

    for k, text in enumerate(texts):
        for s in range(0, max(1, len(text) - length + 1), RUN // 2):
            part = text[s : s + RUN // 2 + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > RUN:
                yield out(held)
                held, size = [], 0
            held.append((k, s, part))
            size += len(part)
    if held:
        yield out(held)


KEYS = ["id", "key"]
SPANS = "id long, key long, first long, many int"


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Documents by their id (null as the least number) and a hash of their text."""
    text = text_of(docs, text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), *more)


def repeated_windows(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``id, key, first, many``: runs of windows of a text that also start anywhere else."""

    def first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "text", RUN // 2):
            ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
            for data, starts, owner, shift in runs([t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()], length):
                at, many, lead, grams = anchors(np.frombuffer(data, np.uint8), length, gram, starts)
                where = np.searchsorted(starts, at)
                blocks = np.array([digest(data[a:b]) for a, b in zip(at.tolist(), (at + many + length - 1).tolist())], np.uint64)
                own = owner[where]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array(keys[own]), pa.array(at + shift[where]), pa.array(many.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(blocks.view(np.int64))],
                    ["id", "key", "first", "many", "lead", "gram", "block"],
                )

    def block_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for i, key, text, todo in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "text", "todo"))):
                data = text.encode("utf-8", "replace")
                rows += [(t["gram"], t["block"], t["several"], t["open"], i, key, t["first"], t["lead"], data[t["first"] : t["first"] + t["many"] + length - 1]) for t in todo]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            del rows

    names = ["gram", "block", "several", "open", "id", "key", "first", "lead", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    digits = write_shared(keyed.mapInArrow(first_digits, "id long, key long, first long, many int, lead int, gram long, block long"), "anchor-digits")
    blocks = write_shared(digits.groupBy("gram", "block").agg(F.count("*").alias("n")), "anchor-blocks")
    # Grams with several blocks, one of which stands alone: their windows are compared.
    several = blocks.groupBy("gram").agg(F.count("*").alias("several"), F.min("n").alias("least")).filter("several > 1 and least = 1").select("gram", "several")
    status = write_shared(blocks.join(several, "gram", "left").filter("n > 1 or several is not null"), "anchor-status")
    marked = write_shared(digits.join(status, ["gram", "block"]), "anchor-marks")
    for done in (digits, blocks, status):
        drop_shared(done)
    release_shuffles(keyed.sparkSession)
    settled = marked.filter("n > 1").select(*KEYS, "first", "many")
    todo = marked.filter("several is not null").groupBy("gram", "block").agg(F.min("several").alias("several"), (F.min("n") == 1).alias("open"), F.min(F.struct(*KEYS, "first", "many", "lead")).alias("one"))
    todo = todo.groupBy("one.id", "one.key").agg(F.collect_list(F.struct("gram", "block", "several", "open", "one.first", "one.many", "one.lead")).alias("todo"))
    held = write_shared(keyed.join(todo, KEYS).mapInArrow(block_bytes, "gram long, block long, several long, open boolean, id long, key long, first long, lead int, bytes binary"), "anchor-bytes")
    release_shuffles(keyed.sparkSession)
    few = held.filter(F.col("several") <= GROUP_BLOCKS).repartition("gram").sortWithinPartitions("gram", "block").mapInArrow(_within_groups(length), SPANS)
    many = _across_tasks(held.filter(F.col("several") > GROUP_BLOCKS).dropDuplicates(["gram", "block"]), length)
    return settled.union(few) if many is None else settled.union(few).union(many)


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Whether the ``depth`` bytes from each start on are also those of another start of its group.

    A radix sort from the most significant digit of 8 bytes on; a suffix leaves
    as soon as it stands alone.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    digits = np.zeros(len(data), np.uint64)
    for k in range(8):
        digits = (digits << np.uint64(8)) | padded[k : k + len(data)]
    left = np.arange(len(starts))
    for at in range(0, depth, 8):
        digit = digits[starts[left] + at] >> np.uint64(8 * max(0, at + 8 - depth))
        order = np.lexsort((digit, group))
        left, digit, group = left[order], digit[order], group[order]
        first = np.ones(len(left), bool)
        first[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        together = ~(first & np.append(first[1:], True))
        group = np.cumsum(first)[together]
        left = left[together]
        if not len(left):
            break
    out = np.zeros(len(starts), bool)
    out[left] = True
    return out


def _within_groups(length: int):
    """Repeated windows of the open blocks of each gram, with rows in the order of grams and blocks; whole grams are sorted together."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        gram, _, is_open, ids, keys, firsts, data = (list(c) for c in zip(*rows))
        many = np.array([len(d) - length + 1 for d in data], np.int64)
        size = many + length - 1
        owner = np.repeat(np.arange(len(rows)), many)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(np.cumsum(size) - size, many) + within
        hit = repeated_suffixes(np.frombuffer(b"".join(data), np.uint8), starts, np.array(gram, np.int64)[owner], length) & np.array(is_open)[owner]
        edge = np.diff(hit.astype(np.int8), prepend=0)
        inner = hit & ((edge == 1) | np.append(True, owner[1:] != owner[:-1]))
        first = np.flatnonzero(inner)
        run = np.cumsum(inner)[hit] - 1
        own = owner[first]
        return _span_batch([np.array(ids, np.int64)[own], np.array(keys, np.int64)[own], np.array(firsts, np.int64)[own] + within[first], np.bincount(run, minlength=len(first))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "block", "open", "id", "key", "first", "bytes"))):
                if held and row[:2] == held[-1][:2]:
                    continue  # of a row that is repeated
                if size > RUN and row[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield spans(held)
        del held
        give_back()

    return run


def _span_batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["id", "key", "first", "many"])


def _cell_hashes(size: int, length: int):
    """Hashes of the cells of blocks: of the bytes that all windows of the whole cell share, and of the bytes of the cell's own windows.

    A window's offset is the anchor's distance from its start, so equal
    windows of different blocks have equal offsets and lie in equal cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for lo, lead, data in zip(*(batch.column(c).to_pylist() for c in ("lo", "lead", "bytes"))):
                low, high = max(lo, lead - len(data) + length), min(lo + size - 1, lead)
                core = data[max(0, lead - lo) : max(0, lead - lo - size + 1 + length)]
                rows.append((low, high, digest(core), digest(data[lead - high : lead - low + length])))
            if rows:
                low, high, core, own = zip(*rows)
                cols = [pa.array(low, pa.int32()), pa.array(high, pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (core, own))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("gram", "block", "open", "lo")), *cols], ["gram", "block", "open", "lo", "low", "high", "core", "own"])
        give_back()

    return run


def _across_tasks(held: DataFrame, length: int) -> DataFrame | None:
    """The same for grams with more blocks, over all tasks: cells of ever fewer windows, down to one.

    A cell whose own bytes another block has, at the same offsets, is settled.
    One whose shared bytes no other block has holds no repeated window.  What
    is left is cut into smaller cells, together with one block for each
    settled cell that could still match.
    """
    held = write_shared(held, "cell-bytes")
    if held.isEmpty():
        return None
    lowest = F.col("lead") - F.octet_length("bytes") + length
    size = CELLS[0]
    cells = held.select("gram", "block", F.explode(F.sequence((F.floor(lowest / size) * size).cast("int"), F.col("lead"), F.lit(size))).alias("lo"))
    bytes_of, found = held.select("gram", "block", "open", "lead", "bytes"), None
    for k, size in enumerate(CELLS):
        hashed = cells.join(bytes_of, ["gram", "block"]).mapInArrow(_cell_hashes(size, length), "gram long, block long, open boolean, lo int, low int, high int, core long, own long")
        hashed = write_shared(hashed, "cell-digits")
        by_own = hashed.groupBy("gram", "low", "high", "own").agg((F.count("*") == 1).alias("alone"), F.min("block").alias("one"))
        marked = write_shared(hashed.join(by_own, ["gram", "low", "high", "own"]), "cell-marks")
        part = marked.filter("open and not alone").select("gram", "block", "low", "high")
        found = part if found is None else found.union(part)
        if k + 1 < len(CELLS):
            again = marked.groupBy("gram", "lo", "core").agg(F.count("*").alias("n"), F.max(F.col("open") & F.col("alone")).alias("wanted")).filter("n > 1 and wanted").select("gram", "lo", "core")
            left = marked.filter("alone or block = one").join(again, ["gram", "lo", "core"], "left_semi")
            step = CELLS[k + 1]
            starts = F.sequence(F.floor(F.col("low") / step).cast("int") * step, F.col("high"), F.lit(step))
            cells = left.select("gram", "block", F.explode(starts).alias("lo"))
    places = held.select("gram", "block", *KEYS, "first", "lead")
    return found.join(places, ["gram", "block"]).select(*KEYS, (F.col("first") + F.col("lead") - F.col("high")).alias("first"), (F.col("high") - F.col("low") + 1).alias("many"))


def merge_spans(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Disjoint, ascending byte ranges that runs of windows cover."""
    out: list[tuple[int, int]] = []
    for first, many in sorted(spans):
        end = first + many - 1 + length
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc`` (a row's columns) and ``spans``, the runs of windows in its text that also start elsewhere (null: none).

    Two rows that agree in id and text count as two places; they have the same
    spans, which are gathered once.  A null text is empty; texts under
    ``length`` bytes repeat nothing.
    """
    small_batches(docs.sparkSession)
    found = repeated_windows(_keyed(docs, id_col, text_col), length, gram)
    spans = found.groupBy(*KEYS).agg(F.collect_set(F.struct("first", "many")).alias("spans"))
    keyed = _keyed(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).drop("text")
    return keyed.join(spans, KEYS, "left").select("doc", "spans")


def _cut(batches: Iterator[pa.RecordBatch], text_col: str, length: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[tuple[int, int]]]]]:
    """Small batches with their texts and the byte ranges to remove."""
    for batch in slices(batches, "doc", 1 << 20, text_col):
        texts = batch.column("doc").field(text_col).cast(pa.string()).to_pylist()
        spans = batch.column("spans").to_pylist()
        yield batch, [(t or "").encode("utf-8", "replace") for t in texts], [merge_spans([(s["first"], s["many"]) for s in x or []], length) for x in spans]


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    A null text is empty: nothing removed, the hash of no bytes.  Rows that agree
    in id and text count as two places and give two rows.  A very long text is
    worked on in runs of ``RUN`` bytes.  Other columns are left out, whatever their
    names.  An empty table gives no row.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, cuts in _cut(batches, "text", length):
            rows = [(len(t), sum(b - a for a, b in c), len(c), hashlib.sha256(_without(t, c)).hexdigest()) for t, c in zip(texts, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc").field("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return with_spans(narrow, length=length, gram=gram).mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _without(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in cut)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in cut), len(data)]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with all repeated bytes taken out of the text; other columns stay.

    Removed ranges hold whole bytes; a character that is cut in two goes as a
    whole.  Rows whose text has nothing but white space left, and lost
    something, are dropped.
    """
    source = with_spans(docs, id_col, text_col, length, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, cuts in _cut(batches, text_col, length):
            left = [_without(t, c).decode("utf-8", "ignore") if c else None for t, c in zip(texts, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(left, pa.string()), pa.array([bool(c) for c in cuts])], ["doc", "text", "cut"])

    done = source.mapInArrow(cut, f"doc {source.schema['doc'].dataType.simpleString()}, text string, cut boolean")
    done = done.filter(~F.col("cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col("cut"), F.col("text")).otherwise(F.col(f"doc.`{text_col}`"))
    return done.select(*[text.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(documents(spark, sf_dir))
