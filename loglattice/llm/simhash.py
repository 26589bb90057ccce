"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within three bits meet at a variant that is at most two bits
from one and one bit from the other.  Two observations keep the balls small.
Fingerprints at an odd distance differ in parity, so only those of even parity
need the radius of two.  And of any three bits two lie in the same half of the
64, so pairs of flips within a half suffice: 992 of 2016.  Variants are
shuffled in passes over slices of their hash, which bounds what lies on disk.

All variants' groups are small: distinct fingerprints within two bits of a
variant.  In each, every member is linked to the member nearest the variant, if
that is within one bit; such links are within three bits, and a group's true
links are all in one component with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, release_shuffles, slices, text_of, write_shared
from .components import components

RADIUS = 3
PASSES = 4
#: Variants that one task holds, about: 24 bytes each.
TASK_VARIANTS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio in 64 bits


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """The flips by number: none, one bit, two bits of one half; and how many bits each has."""
    one = [1 << i for i in range(64)]
    two = [1 << i | 1 << j for i in range(64) for j in range(i) if i // 32 == j // 32]
    masks = np.array([0, *one, *two], np.uint64)
    return masks, np.bitwise_count(masks).astype(np.int64)


MASKS, FLIPS = _masks()
EVEN_BALL, ODD_BALL = np.arange(len(MASKS)), np.arange(65)


def bit_counts(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each run of ``many`` hashes, how often each of the 64 bits is set."""
    out = np.zeros((len(many), 64), np.int64)
    ends = np.cumsum(many)
    step = 1 << 17
    for a in range(0, len(hashes), step):
        b = min(a + step, len(hashes))
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b - 1, "right")
        runs = np.flatnonzero(many[first : last + 1]) + first
        starts = np.maximum((ends - many)[runs] - a, 0)
        out[runs] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return out


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """SimHash of the XXH64 of all word shingles; fewer words are one shingle, none gives zero."""
    digest, hashes, many = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()
        if len(words) > shingle:
            grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        else:
            grams = [b" ".join(words)] if words else []
        n = len(hashes)
        hashes += [digest(g, 42) for g in grams]
        many.append(len(hashes) - n)
    many = np.array(many, np.int64)
    counts = bit_counts(np.array(hashes, np.uint64), many)
    bits = (2 * counts > many[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, with_key: bool = False) -> DataFrame:
    """``id, fp`` of every whole text, ``fp`` a signed 64-bit integer; A-Z count as a-z.

    If asked, also ``key``, a hash of the text.
    """
    names = ["id", "fp", "key"][: 2 + with_key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            fp = fingerprints([t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64)), *batch.columns[2:]], names)

    text = text_of(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *([F.xxhash64(text).alias("key")] * with_key))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _emit(slot: int, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column("fp").to_numpy().view(np.uint64)
            odd = (np.bitwise_count(all_fp) & 1).astype(bool)
            for ball, fps in ((EVEN_BALL, all_fp[~odd]), (ODD_BALL, all_fp[odd])):
                for a in range(0, len(fps), 256):
                    variants = (fps[a : a + 256, None] ^ MASKS[ball]).ravel()
                    codes = np.tile(ball.astype(np.int32), len(fps[a : a + 256]))
                    if passes > 1:
                        mine = ((variants * _MIX) >> np.uint64(40)) % np.uint64(passes) == slot
                        variants, codes = variants[mine], codes[mine]
                    yield pa.RecordBatch.from_arrays([pa.array(variants.view(np.int64)), pa.array(codes)], ["variant", "code"])

    return run


def meet(variants: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a variant, none given twice."""
    order = np.lexsort((codes, variants))
    variants, codes = variants[order], codes[order]
    fresh = np.ones(len(variants), bool)
    fresh[1:] = variants[1:] != variants[:-1]
    hub = np.maximum.accumulate(np.where(fresh, np.arange(len(variants)), 0))
    other = np.flatnonzero(~fresh & (FLIPS[codes[hub]] <= 1))
    a = variants[hub[other]] ^ MASKS[codes[hub[other]]]
    b = variants[other] ^ MASKS[codes[other]]
    near = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    low, high = np.minimum(a, b)[near], np.maximum(a, b)[near]
    pairs = np.unique(np.stack([low, high], 1), axis=0) if len(low) else np.empty((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("variant").to_numpy().view(np.uint64), b.column("code").to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = meet(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(fps: DataFrame, passes: int = PASSES) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``): true ones, and enough for all components."""
    spark = fps.sparkSession
    n = fps.count()
    tasks = max(1, -(-n * 560 // passes // TASK_VARIANTS))
    spread = fps.repartition(max(tasks, spark.sparkContext.defaultParallelism))
    found = None
    for slot in range(passes):
        met = spread.mapInArrow(_emit(slot, passes), "variant long, code int").repartition(tasks, "variant").mapInArrow(_collide, "a long, b long")
        part = write_shared(met, "simhash-links")
        release_shuffles(spark)
        found = part if found is None else found.union(part)
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, passes: int = PASSES) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    A null text counts as empty; texts without a word have fingerprint zero and
    link like any other.  Equal texts and repeated rows share a fingerprint.  A
    null id gets a component but never names one, unless no other is there.
    Other columns are left out, whatever their names.
    """
    marked = write_shared(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    least = write_shared(marked.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-ids")
    roots = write_shared(components(links(least.select("fp"), passes)), "fingerprint-roots")
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, passes: int = PASSES) -> DataFrame:
    """One document of each component: that with the least id, null last, then the least hash of its text.

    Of wholly repeated rows one stays.  All columns pass unchanged.
    """
    text = text_of(docs, text_col)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text).alias("own_key"))
    marked = write_shared(with_fingerprint(docs, id_col, text_col, shingle, with_key=True), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    least = write_shared(marked.groupBy("fp").agg(first.alias("one")), "fingerprint-firsts")
    roots = write_shared(components(links(least.select("fp"), passes)), "fingerprint-roots")
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    kept = rooted.groupBy("root").agg(F.min("one").alias("one")).select(F.col("one.id").alias("kept_id"), F.col("one.key").alias("kept_key"))
    # Rows without an id are told apart by their text alone.
    same = (F.coalesce("own_id", F.lit(0)) == F.coalesce("kept_id", F.lit(0))) & (F.col("own_key") == F.col("kept_key")) & (F.col("own_id").isNull() == F.col("kept_id").isNull())
    return keyed.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_key"]).select("doc.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
