"""Near copies by true similarity: all pairs of texts whose word shingles have a Jaccard similarity of a limit or more.

Two sets that are so similar share a member among the first ``n - ceil(limit *
n) + 1`` of each, in any order that is the same for all sets.  Shingles that
many texts share come last in that order, so few texts meet at one.  Pairs that
meet, and may reach the limit by their sizes and places, are compared by bit
maps in which each member flips one bit: sets differ in as many members as bits,
at least.  What is left is verified on whole sets; so no pair is missed, and
none is taken for the likeness of its sketches.

Where many texts meet, each is first compared with one of them only; later the
others are, if these links haven't joined them yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, release_shuffles, slices, text_of, write_shared
from .components import components

SHINGLE = 5
#: Least similarity in percent.
PERCENT = 80
#: One text in so many is looked at to find common shingles; that sets their order alone, no result.
ORDER_SAMPLE = 16
#: Common shingles that are put last at most.
MAX_COMMON = 100_000
#: Sets that meet and are all compared at once at most.
SMALL = 8
#: Bits of a set's map.
MAP_BITS = 1024
#: Texts up to which their keys, or the roots of their links, are sent to all tasks; more are shuffled.
MAX_SENT = 500_000
#: Shingles that one task holds, about: 24 bytes each.
TASK_ROWS = 2_000_000
_ROWS = "h long, node long, n int, place int"


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The sorted XXH64 of all word shingles; fewer words are one shingle, none gives the empty set."""
    words = text.lower().split()
    if len(words) > shingle:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    else:
        grams = [b" ".join(words)] if words else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, 42) for g in grams], np.uint64).view(np.int64))


def node_of(members: np.ndarray) -> int:
    """A hash of the whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(members.tobytes())).view(np.int64))


def bit_map(members: np.ndarray) -> bytes:
    """Of each bit whether an odd number of members fall on it."""
    odd = np.bincount(members.view(np.uint64) % np.uint64(MAP_BITS), minlength=MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _texts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text", 2 << 20):
        yield batch, [shingle_set(t.encode("utf-8", "replace"), shingle) for t in batch.column("text").to_pylist()]


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in ascending order, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _texts(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["h"])

    some = rows.filter(F.pmod("key", F.lit(ORDER_SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 3")
    found = sorted((r["h"], r["n"]) for r in counts.orderBy(F.desc("n"), "h").limit(MAX_COMMON).collect())
    return np.array([h for h, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def _heads(common: tuple[np.ndarray, np.ndarray], shingle: int, percent: int):
    """Of each text its set's node and size, and the first members by order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = common
        for batch, sets in _texts(batches, shingle):
            heads = []
            for s in sets:
                count = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    count = np.where(known[at] == s, counts[at], 0)
                many = len(s) * (100 - percent) // 100 + 1
                heads.append(s[np.argsort(count, kind="stable")[:many]].tobytes())
            nodes, sizes = [node_of(s) for s in sets], [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(heads, pa.binary()), pa.array(list(map(bit_map, sets)), pa.binary())], ["id", "key", "node", "n", "head", "bits"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "head", 1 << 20):
        heads = [np.frombuffer(h, np.int64) for h in batch.column("head").to_pylist()]
        many = np.array([len(h) for h in heads], np.int64)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        rest = (np.repeat(batch.column(c).to_numpy(), many) for c in ("node", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), *map(pa.array, rest), pa.array(place.astype(np.int32))], ["h", "node", "n", "place"])


def may_be(n: tuple[np.ndarray, np.ndarray], place: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Whether sets of these sizes that share the members at these places can be similar enough."""
    most = np.minimum(*place) + 1 + np.minimum(n[0] - place[0] - 1, n[1] - place[1] - 1)
    return (100 + percent) * most >= percent * (n[0] + n[1])


def _held(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray] | None:
    """All rows of a task in the order of ``h``, size and node."""
    held = [[b.column(c).to_numpy().astype(np.int64) for c in names] for b in batches if b.num_rows]
    if not held:
        return None
    cols = [np.concatenate(x) for x in zip(*held)]
    order = np.lexsort((cols[1], cols[2], cols[0]))
    return [c[order] for c in cols]


def _pairs(h: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int, root: np.ndarray | None = None, bits: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within groups of one ``h`` that may be similar enough, by their bit maps too, and have unequal roots."""
    left = np.arange(len(h))
    step = 1
    while True:
        left = left[left + step < len(h)]
        # Sizes ascend in a group: what is too small for this one is so for all further ones.
        left = left[(h[left] == h[left + step]) & (100 * n[left] >= percent * n[left + step])]
        if not len(left):
            return
        right = left + step
        good = may_be((n[left], n[right]), (place[left], place[right]), percent)
        if root is not None:
            good &= root[left] != root[right]
        if bits is not None:
            near = np.flatnonzero(good)
            apart = np.bitwise_count(bits[left[near]] ^ bits[right[near]]).sum(axis=1, dtype=np.int64)
            good[near] = (100 + percent) * apart <= (100 - percent) * (n[left[near]] + n[right[near]])
        yield node[left[good]], node[right[good]]
        step += 1


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    empty = pa.nulls(len(pairs), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), empty, *[empty.cast(pa.int32())] * 2], ["a", "b", "h", "n", "place"])


def _meet(percent: int, small: int):
    """Pairs ``a, b`` of small groups, and of others those with one member; also all members ``a`` of these, with ``h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches, ["h", "node", "n", "place"])
        if held is None:
            return
        h = held[0]
        first = np.append(True, h[1:] != h[:-1])
        group = np.cumsum(first) - 1
        big = (np.bincount(group) > small)[group]
        few = list(_pairs(*(c[~big] for c in held), percent))
        h, node, n, place = (c[big] for c in held)
        if len(h):
            # A set is compared with the first of its group of the same size class, so that sizes fit.
            kind = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int64)
            new = np.append(True, (h[1:] != h[:-1]) | (kind[1:] != kind[:-1]))
            hub = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            good = ~new & may_be((n, n[hub]), (place, place[hub]), percent)
            few.append((node[good], node[hub][good]))
        if few:
            yield _batch(*(np.concatenate(x) for x in zip(*few)))
        if len(h):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(h), pa.int64()), pa.array(h), *(pa.array(c.astype(np.int32)) for c in (n, place))], ["a", "b", "h", "n", "place"])

    return run


def _meet_again(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        h, node, n, place, root = (np.concatenate([b.column(c).to_numpy().astype(np.int64) for b in held]) for c in ("h", "node", "n", "place", "root"))
        bits = np.concatenate([np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint64).reshape(b.num_rows, -1) for b in held])
        del held
        order = np.lexsort((node, n, h))
        for a, b in _pairs(*(c[order] for c in (h, node, n, place)), percent, root[order], bits[order]):
            if len(a):
                yield _batch(a, b).select(["a", "b"])

    return run


def _few(roots: DataFrame) -> DataFrame:
    return F.broadcast(roots) if roots.count() <= MAX_SENT else roots


def _verified(pairs: DataFrame, rows: DataFrame, firsts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _texts(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "members"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def may_match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            n = batch.column("m").to_numpy().astype(np.int64) + batch.column("n").to_numpy()
            good = (100 + percent) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (100 - percent) * n
            yield batch.select(["a", "b"]).filter(pa.array(good))

    x = firsts.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("m"))
    y = firsts.select(F.col("node").alias("b"), F.col("bits").alias("y"), "n")
    pairs = write_shared(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(may_match, "a long, b long"), "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = _few(write_shared(firsts.join(ends, "node", "left_semi").select("key"), "near-keys"))
    release_shuffles(pairs.sparkSession)
    texts = rows.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("text")
    known = write_shared(texts.mapInArrow(sets, "node long, members binary"), "near-sets")
    release_shuffles(pairs.sparkSession)
    x = known.select(F.col("node").alias("a"), F.col("members").alias("x"))
    y = known.select(F.col("node").alias("b"), F.col("members").alias("y"))
    links = write_shared(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "near-links")
    release_shuffles(pairs.sparkSession)
    return links


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """One document of each component of links between similar texts: that with the least id, null last, then the least hash of its text.

    A link is a Jaccard similarity of ``percent`` or more between the sets of
    word shingles (A-Z count as a-z).  Texts without a word are equal.  Of
    wholly repeated rows one stays.  All columns pass unchanged.
    """
    text = text_of(docs, text_col)
    key = F.xxhash64(text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), text.alias("text"))
    heads = rows.select("id", "key", "text").mapInArrow(_heads(_common(rows, shingle), shingle, percent), "id long, key long, node long, n int, head binary, bits binary")
    heads = write_shared(heads, "near-heads")
    # Of equal sets one goes on, with what is the same in all of them.
    firsts = heads.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n", "head", "bits")).alias("one"))
    firsts = firsts.select("node", F.struct("one.none", "one.id", "one.key").alias("one"), "one.key", "one.n", "one.head", "one.bits")
    firsts = write_shared(firsts, "near-firsts")
    drop_shared(heads)
    release_shuffles(docs.sparkSession)
    spread = firsts.filter("n > 0").select("node", "n", "head").mapInArrow(_spread, _ROWS)
    total = firsts.agg(F.sum(F.octet_length("head"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(total) // 8 // TASK_ROWS + 1)
    met = write_shared(spread.repartition(tasks, "h").mapInArrow(_meet(percent, small), "a long, b long, h long, n int, place int"), "near-met")
    release_shuffles(docs.sparkSession)
    links = _verified(met.filter("b IS NOT NULL").select("a", "b").distinct(), rows, firsts, shingle, percent)
    roots = _few(write_shared(components(links), "near-roots"))
    crowd = met.filter("b IS NULL").select("h", F.col("a").alias("node"), "n", "place")
    # With their bit maps, so that unlike members of a crowd make no pair.
    crowd = crowd.join(roots, "node", "left").join(firsts.select("node", "bits"), "node")
    crowd = crowd.select("h", "node", "n", "place", F.coalesce("root", "node").alias("root"), "bits")
    release_shuffles(docs.sparkSession)
    more = write_shared(crowd.repartition(tasks, "h").mapInArrow(_meet_again(percent), "a long, b long").distinct(), "near-more")
    release_shuffles(docs.sparkSession)
    if not more.isEmpty():
        links = links.union(_verified(more, rows, firsts, shingle, percent))
        roots = _few(write_shared(components(links), "near-roots"))
    rooted = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Rows without an id are told apart by their text alone.  One dealing serves the join and the choice among repeated rows.
    name = lambda i, k: [F.coalesce(i, F.lit(0)).alias("own_id"), k.alias("own_key"), i.isNull().alias("own_none")]
    kept = rooted.groupBy("root").agg(F.min("one").alias("one")).select(*name(F.col("one.id"), F.col("one.key")))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *name(F.col(id_col).cast("long"), key))
    keys = ["own_id", "own_key", "own_none"]
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select("doc.*")
