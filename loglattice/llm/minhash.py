"""MinHash fingerprints of documents, and near copies by bands of them.

A text's words (A-Z as a-z) form shingles of five, fewer words one of all of
them.  All hashing is done by numpy over blocks of texts: words by a sum over
their bytes, shingles by a sum over their words, and each of the permutations by
a multiplication and an addition of 64 bits, of which the upper half counts.  Of
each least value 16 bits are kept, so texts with nothing in common agree in one
of 65,536.

Near copies: texts that agree in a whole band meet there.  What their sizes and bit
maps don't rule out is compared by true shingle sets, unless it is joined already.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simhash
from .common import documents, drop_shared, give_back, slices, small_batches, text_of, write_shared
from .components import components
from .near_copies import bit_map

SHINGLE = 5
PERMUTATIONS = 128
#: Two sets with a similarity of 0.8 agree in none of so many bands with a probability of 0.00005.
BANDS, BAND_SIZE = 25, 5
PERCENT = 80
#: Shingles that are permuted at once; they stay in a core's cache.
BLOCK = 1 << 14
#: Bytes of texts that are hashed at once.
SLICE_BYTES = 2 << 20
#: In each further round so many times as many pairs are taken from a band.
HUBS = 8
#: Texts of a band that one task compares with one another, about.
CROWD = 4096
#: Bits of the map of texts that are compared; texts that share a bit with them are dealt out as well.
MAP_BITS = 1 << 22
#: Rows of classes that are sent to all tasks; more are shuffled.
MAX_SENT = 500_000
_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KIND = "id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


@functools.lru_cache(maxsize=1)
def _numbers() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers of the hashes, the same everywhere: by byte (0: white space), by place in a word, by place in a shingle, and the permutations."""
    draw = np.random.Generator(np.random.PCG64(20_240_229))
    odd = lambda n: draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    of_byte = odd(256)
    of_byte[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = of_byte[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)]
    of_byte[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 0
    return of_byte, odd(1 << 12), odd(SHINGLE), odd(PERMUTATIONS), odd(PERMUTATIONS)


def _mixed(x: np.ndarray) -> np.ndarray:
    for multiplier in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(multiplier)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, text by text, and where each text's begin (with the end)."""
    of_byte, of_place, of_word, _, _ = _numbers()
    # A space stands between texts, so that no word crosses.
    value = of_byte[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    inside = value != 0
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    size = np.diff(starts, append=len(value))
    place = np.arange(starts[0], len(value)) - np.repeat(starts, size)
    words = _mixed(np.add.reduceat(value[starts[0] :] * of_place[place % len(of_place)], starts - starts[0]))
    last = np.searchsorted(starts, ends)
    first = np.concatenate([[0], last[:-1]])
    many = last - first
    count = np.where(many, np.maximum(many - SHINGLE + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first, count)
    stop = np.repeat(last, count)
    total = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(of_word):
        here = at + k < stop
        total += np.where(here, words[np.minimum(at + k, len(words) - 1)] * factor, 0)
    return _mixed(total), bounds


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of 16-bit numbers for each text, the highest ones for a text without words."""
    _, _, _, factors, terms = _numbers()
    hashes, bounds = shingles(texts)
    least = np.full((PERMUTATIONS, len(texts)), (1 << 32) - 1, np.uint64)
    filled = np.flatnonzero(np.diff(bounds))
    begin = bounds[filled]
    for a in range(0, len(hashes), BLOCK):
        block = hashes[a : a + BLOCK]
        i, j = np.searchsorted(begin, a, "right") - 1, np.searchsorted(begin, a + len(block))
        cuts = np.maximum(begin[i:j] - a, 0)
        mine, buffer = filled[i:j], np.empty_like(block)
        for k in range(PERMUTATIONS):
            np.multiply(block, factors[k], out=buffer)
            np.add(buffer, terms[k], out=buffer)
            np.right_shift(buffer, np.uint64(32), out=buffer)
            least[k, mine] = np.minimum(least[k, mine], np.minimum.reduceat(buffer, cuts))
    return np.ascontiguousarray(least.T).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of permutations that agree, row by row."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def edited(own: str, after: str) -> str:
    """``own`` with the beginning of ``after`` in place of its second half."""
    half = len(own) // 2
    return own[: len(own) - half] + after[:half]


def _results(ids: list, own: list[str], after: list[str], fp: np.ndarray, next_fp: np.ndarray) -> list[pa.Array]:
    changed = [edited(a, b).encode("utf-8", "replace") for a, b in zip(own, after)]
    edited_fp = fingerprints(changed)
    cells = lambda x: pa.array([r.astype(">u2").tobytes() for r in x], pa.binary())
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()), cells(fp), cells(edited_fp), pa.array(likeness(fp, edited_fp)), pa.array(likeness(fp, next_fp))]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document with the next; a range's first and last one also with their texts, since the last one's next lies elsewhere."""
    part, held, held_fp = TaskContext.get().partitionId(), None, None

    def out(results: list[pa.Array], keys: list[int], kind: int, texts: list[str] | None = None) -> pa.RecordBatch:
        n = len(keys)
        return pa.RecordBatch.from_arrays([*results, pa.array(keys, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(texts or [None] * n, pa.string())], [*_NAMES, "key", "kind", "part", "text"])

    def edge(kind: int, row: tuple) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        return out([pa.array([row[0]], pa.int64()), *none], [row[1]], kind, [row[2]])

    for batch in slices(batches, "text", SLICE_BYTES):
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("id", "key", "text"))))
        fp = fingerprints([t.encode("utf-8", "replace") for _, _, t in rows])
        if held is None:
            yield edge(1, rows[0])
        else:
            rows, fp = [held, *rows], np.concatenate([held_fp, fp])
        held, held_fp = rows[-1], fp[-1:]
        if len(rows) > 1:
            texts = [t for _, _, t in rows]
            yield out(_results([i for i, _, _ in rows[:-1]], texts[:-1], texts[1:], fp[:-1], fp[1:]), [k for _, k, _ in rows[:-1]], 0)
    if held is not None:
        yield edge(2, held)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE_BYTES):
        own, after = (batch.column(c).to_pylist() for c in ("text", "after"))
        fp, next_fp = (fingerprints([t.encode("utf-8", "replace") for t in x]) for x in (own, after))
        yield pa.RecordBatch.from_arrays([*_results(batch.column("id").to_pylist(), own, after, fp, next_fp), batch.column("key")], [*_NAMES, "key"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the fingerprint columns and ``key``, a hash of the text, of each document beside the next one by falling id; written to the shared folder.

    Nulls come last, rows with one id stand in the order of their texts' hashes.
    The last is beside the first, a single one beside itself.  Ranges of
    documents are walked by all tasks; the driver gets the number of each range
    that isn't empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    order = [F.desc_nulls_last("id"), F.col("key")]
    walked = write_shared(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(_walk, f"{_KIND}, key long, kind int, part int, text string"), "minhash-ranges")
    parts = sorted(r["part"] for r in walked.filter("kind = 1").select("part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, after_part int")
    first = walked.filter("kind = 1").select(F.col("part").alias("after_part"), F.col("text").alias("after"))
    last = walked.filter("kind = 2").select("id", "key", "text", "part").join(F.broadcast(follows), "part").join(first, "after_part")
    return walked.filter("kind = 0").select(*_NAMES, "key").unionByName(last.select("id", "key", "text", "after").mapInArrow(_across, f"{_KIND}, key long"))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            fp = np.frombuffer(b"".join(part.column("fingerprint").to_pylist()), ">u2").reshape(-1, PERMUTATIONS)
            node = part.column("key").to_numpy()
            value = np.empty((len(fp), BANDS), np.uint64)
            for b in range(BANDS):
                held = np.full(len(fp), b, np.uint64)
                for k in range(BAND_SIZE):
                    held = _mixed(held * np.uint64(0x9E3779B97F4A7C15) + fp[:, b * BAND_SIZE + k])
                value[:, b] = held
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64).ravel()), pa.array(np.repeat(node, BANDS))], ["band", "key"])
    give_back()


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets (sorted, distinct) have such a Jaccard similarity; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[int, np.ndarray] = {}
    press = zstandard.ZstdDecompressor()

    def of(key: int, packed: bytes) -> np.ndarray:
        if key not in sets:
            if len(sets) > 64:
                sets.clear()
            sets[key] = np.unique(shingles([press.decompress(packed)])[0])
        return sets[key]

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("key", "hub", "packed", "hub_packed")))
        good = [(k, h) for k, h, t, u in rows if similar(of(k, t), of(h, u))]
        keys, hubs = zip(*good) if good else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hubs, pa.int64())], ["key", "hub"])
    give_back()


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, hub``: those of ``pairs`` whose ``texts`` (``key, packed``) are similar; written to the shared folder.

    Plain joins: Spark deals a hub that many texts are compared with to several tasks.
    """
    texts = texts.select("key", "packed")
    members = pairs.join(texts, "key").join(texts.select(F.col("key").alias("hub"), F.col("packed").alias("hub_packed")), "hub")
    return write_shared(members.select("key", "hub", "packed", "hub_packed").mapInArrow(_verified, "key long, hub long"), "minhash-links")


def _texts_of(docs: DataFrame, text_col: str, keys: DataFrame) -> DataFrame:
    """``key, packed, n, bits`` of the texts with one of ``keys``, and a few more: pressed, their sets' sizes and bit maps; written to the shared folder.

    All tasks get a map of bits of a fixed size, so most other texts aren't shuffled.
    """
    marked = np.zeros(MAP_BITS, bool)
    marked[[r["m"] for r in keys.select(F.pmod("key", F.lit(MAP_BITS)).alias("m")).distinct().toLocalIterator()]] = True
    marks = np.packbits(marked)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, press = np.unpackbits(marks).astype(bool), zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text", SLICE_BYTES):
            part = batch.filter(pa.array(known[batch.column("key").to_numpy() % MAP_BITS]))
            texts = [t.encode("utf-8", "replace") for t in part.column("text").to_pylist()]
            hashes, bounds = shingles(texts)
            sets = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
            cells = [pa.array([press.compress(t) for t in texts], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(list(map(bit_map, sets)), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("key"), *cells], ["key", "packed", "n", "bits"])

    text = text_of(docs, text_col)
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(some, "key long, packed binary, n int, bits binary")
    return write_shared(texts.groupBy("key").agg(F.first(F.struct("packed", "n", "bits")).alias("x")).select("key", "x.*"), "minhash-texts")


def tried(key: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, failed: list, block: np.ndarray | None = None, most: int = 1, percent: int = PERCENT) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of a band's texts to compare, the greater key first, and whether others may be left; ``key`` ascends.

    Pairs of one root are joined already, those in ``failed`` (of each text, lesser
    keys) are known to be unlike, and sizes or bit maps rule others out for sure.
    Of all that are left, one suffices for each two groups that it would join; if
    ``most`` is over 1, up to so many are taken between a text and each root, as
    if none were alike.  With ``block`` only pairs across blocks count.
    """
    _, group = np.unique(root, return_inverse=True)
    out, more = [], False
    for i in range(1, len(key)):
        left = group[:i] != group[i]
        if block is not None:
            left &= block[:i] != block[i]
        left = np.flatnonzero(left)
        left = left[100 * np.minimum(n[left], n[i]) >= percent * np.maximum(n[left], n[i])]
        if not len(left):
            continue
        apart = np.bitwise_count(bits[left] ^ bits[i]).sum(axis=1, dtype=np.int64)
        left = left[(100 + percent) * apart <= (100 - percent) * (n[left] + n[i])]
        if failed[i] is not None and len(left):
            left = left[~np.isin(key[left], failed[i])]
        if not len(left):
            continue
        met = np.unique(group[left])
        for g in met.tolist():
            mine = left[group[left] == g]
            more |= len(mine) > most
            out += [(int(key[i]), int(k)) for k in key[mine[:most]]]
        if most == 1:
            # Pairs within what is joined here are passed over, unless nothing comes after.
            more |= i + 1 < len(key)
            group[np.isin(group, met)] = group[i]
    return out, more


def _tries(most: int):
    """``band, key, hub, more``: what ``tried`` takes from each band, or pair of a band's blocks; rows come in the order of these and of keys."""
    order = ["band", "low", "high"]

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        band, low, high, block, key, root, n = (table.column(c).to_numpy().astype(np.int64) for c in [*order, "block", "key", "root", "n"])
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
        failed = table.column("failed").to_pylist()
        cuts = np.flatnonzero((np.diff(band) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        pairs = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            some, more = tried(key[a:b], root[a:b], n[a:b], bits[a:b], failed[a:b], block[a:b] if low[a] != high[a] else None, most)
            pairs += [(int(band[a]), *pair, more) for pair in some]
        if pairs:
            *cells, more = zip(*pairs)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cells), pa.array(more, pa.bool_())], ["band", "key", "hub", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            one = pa.Table.from_batches([batch])
            held = one if held is None else pa.concat_tables([held, one])
            names = [held.column(c).to_numpy() for c in order]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0))
            # The last group may go on in the next batch.
            if len(new):
                end = int(new[-1]) + 1
                yield from found(held.slice(0, end))
                held = held.slice(end)
        if held is not None:
            yield from found(held)
        give_back()

    return run


def _to_try(members: DataFrame, texts: DataFrame, failed: DataFrame | None, most: int) -> DataFrame:
    """Pairs of ``members`` (``band, key, many, root``) to compare, with the bands that ask for them; written to the shared folder.

    A crowd of over ``CROWD`` texts is dealt to tasks by pairs of blocks.
    """
    rows = members.join(texts.select("key", "n", "bits"), "key")
    if failed is None:
        rows = rows.withColumn("failed", F.lit(None).cast("array<long>"))
    else:
        rows = rows.join(failed.groupBy("key").agg(F.collect_list("hub").alias("failed")), "key", "left")
    blocks = F.ceil(F.col("many") / F.lit(CROWD)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "root", "n", "bits", "failed")
    rows = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "key")
    return write_shared(rows.mapInArrow(_tries(most), "band long, key long, hub long, more boolean"), "minhash-pairs")


def near_groups(fingered: DataFrame, docs: DataFrame, text_col: str = "text", also: DataFrame | None = None) -> DataFrame:
    """``node, root`` of the keys of texts linked by a true similarity of 0.8 or more, of all that meet in a band.

    ``also`` gives further bands (``band, key``).  In rounds, tasks take pairs to
    compare from each band (``tried``): enough to join all that their sizes and
    bit maps allow.  A band is taken up again, with more pairs each time, only
    if one of its own pairs turned out unlike and others are left; so no two that
    meet are left apart unseen, a crowd of copies takes about one comparison a
    member, and bands that are settled aren't read again.
    """
    nodes = fingered.groupBy("key").agg(F.first("fingerprint").alias("fingerprint"))
    bands = nodes.mapInArrow(_bands, "band long, key long")
    bands = write_shared(bands if also is None else bands.unionByName(also), "minhash-bands")
    # Of bands in which the same texts meet one goes on.
    met = bands.groupBy("band").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("many"), F.bit_xor(F.xxhash64("key")).alias("all")).filter("first < last")
    met = met.groupBy("first", "last", "many", "all").agg(F.min("band").alias("band")).select("band", "many")
    state = write_shared(bands.join(met, "band").select("band", "key", "many"), "minhash-met")
    drop_shared(bands)
    texts = _texts_of(docs, text_col, state.select("key"))
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    members, links, failed, most = state.withColumn("root", F.col("key")), None, None, 1
    while True:
        fresh = _to_try(members, texts, failed, most)
        if fresh.isEmpty():
            break
        good = _compared(fresh.select("key", "hub").distinct(), texts)
        unlike = write_shared(fresh.join(good, ["key", "hub"], "left_anti"), "minhash-unlike")
        if not good.isEmpty():
            links = good if links is None else links.unionByName(good)
            roots = write_shared(components(links.toDF("a", "b")), "minhash-roots")
        drop_shared(fresh)
        # A band all of whose own pairs are alike is joined as far as can be, and one without further pairs is done.
        open_ = unlike.filter("more").select("band").distinct()
        if open_.isEmpty():
            break
        pairs = unlike.select("key", "hub").distinct()
        failed, most = pairs if failed is None else failed.unionByName(pairs), most * HUBS
        again = state.join(open_, "band", "left_semi")
        members = again.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    drop_shared(texts)
    drop_shared(state)
    return roots


def classes(fingered: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key, class_id``: of each text that has copies or near copies the least id among all that are linked with it."""
    least = fingered.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    roots = near_groups(fingered, docs, text_col).withColumnRenamed("node", "key")
    # Texts without others need no row.
    some = write_shared(least.join(roots, "key", "left").filter("n > 1 or root is not null").select("key", F.coalesce("root", "key").alias("root"), "least"), "minhash-classes")
    return some.select("key", "root").join(some.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("key", "class_id")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id`` of each document.

    ``near_next`` is the likeness to the next document by falling id, ``near_edited``
    that to the document with the next one's beginning in place of its second half;
    ``class_id`` the least id among a document's copies and near copies, linked
    by a true similarity of 0.8 or more of five-word shingle sets, among all texts
    that agree in a band.

    Null texts are empty; texts without words agree with one another and with no
    other.  Rows with one id are documents of their own.  A very long text needs
    memory in proportion to its length.  Other columns are left out, whatever
    their names.  An empty table gives no row.
    """
    fingered = with_next(docs, id_col, text_col)
    found = write_shared(classes(fingered, docs, text_col), "minhash-found")
    if found.count() <= MAX_SENT:
        found = F.broadcast(found)
    out = fingered.join(found, "key", "left")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", *(F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")), "near_edited", "near_next", F.coalesce("class_id", "id").alias("class_id"))


def _by_simhash(fingered: DataFrame) -> DataFrame:
    """``band, key``: texts (``key, fp``) whose SimHash fingerprints are linked, directly or by others, meet in a band."""
    roots = write_shared(components(simhash.links(fingered.select("fp").distinct())), "simhash-roots")
    marked = fingered.select("key", "fp").distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return marked.select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("band"), "key")


def keep_one_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of copies and near copies: that with the least id, null last, then the least hash of its text.

    Groups are those of ``near_groups``: a true similarity of 0.8 or more of
    five-word shingle sets, among texts whose SimHash fingerprints lie in one
    component of links of three bits or fewer, or that agree in a MinHash band.  Texts without a word
    are equal.  Of wholly repeated rows one stays.  A very long text needs memory
    in proportion to its length.  All columns pass unchanged.  An empty table
    gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            cells = [pa.array([r.astype(">u2").tobytes() for r in fingerprints(texts)], pa.binary()), pa.array(simhash.fingerprints(texts, SHINGLE).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *cells], ["id", "key", "fingerprint", "fp"])

    small_batches(docs.sparkSession)
    text = text_of(docs, text_col)
    key = F.xxhash64(text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), text.alias("text"))
    fingered = write_shared(rows.mapInArrow(run, "id long, key long, fingerprint binary, fp long"), "minhash-documents")
    roots = near_groups(fingered, docs, text_col, _by_simhash(fingered)).withColumnRenamed("node", "key")
    firsts = fingered.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("one"))
    rooted = firsts.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # Rows without an id are told apart by their text alone.
    name = lambda i, k: [F.coalesce(i, F.lit(0)).alias("own_id"), k.alias("own_key"), i.isNull().alias("own_none")]
    kept = write_shared(rooted.groupBy("root").agg(F.min("one").alias("one")).select(*name(F.col("one.id"), F.col("one.key"))), "minhash-kept")
    drop_shared(fingered)
    if kept.count() <= MAX_SENT:
        kept = F.broadcast(kept)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *name(F.col(id_col).cast("long"), key))
    keys = ["own_id", "own_key", "own_none"]
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select("doc.*")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, with classes by all links, which the contract doesn't ask for."""
    return fingerprint(documents(spark, sf_dir))
