"""Token ids as bit planes: fixed-size id blocks, transposed, compressed plane by plane.

A shard is one binary file::

    magic  planes of block 0, 1, ...  document table  chunk index  footer

Each block holds ``block_ids`` ids (the last one fewer).  Its ids are
transposed into as many bit planes (or byte planes) as its largest id needs,
and every plane is one zstandard frame.  The chunk index has, for each block,
the number of ids and the end of each plane, so one block can be read without
the others.  The document table has the ids of the documents and how many
token ids each has; token ids alone don't show where a document ends.

Shards travel as rows of a Parquet table in the shared folder, since Spark
commits those atomically on any store and a retried task leaves no half file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, with_end
from .common import documents, slices, text_of, write_shared

MAGIC = b"BPS1"
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 20
FOOTER = struct.Struct("<QQQI4s")
SHARD_SCHEMA = "part int, seq int, before long, n_docs long, n_ids long, payload binary"


def pack_block(ids: np.ndarray, planes: str = "bit") -> list[bytes]:
    """One block's compressed planes, lowest first."""
    press = zstandard.ZstdCompressor(level=1).compress
    top = int(ids.max()).bit_length() if len(ids) else 0
    if planes == "byte":
        return [press(((ids >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8).tobytes()) for k in range((top + 7) // 8)]
    return [press(np.packbits((ids & np.uint32(1 << k)) != 0).tobytes()) for k in range(top)]


def unpack_block(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    plain = zstandard.ZstdDecompressor().decompress
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plain(plane), np.uint8)
        out |= raw.astype(np.uint32) << np.uint32(8 * k) if kind == "byte" else np.unpackbits(raw, count=n).astype(np.uint32) << np.uint32(k)
    return out


def pack_shard(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, planes: str = "bit", block_ids: int = BLOCK_IDS) -> bytes:
    """The bytes of one shard file."""
    out, at, index = [MAGIC], len(MAGIC), []
    for a in range(0, len(ids), block_ids):
        block = ids[a : a + block_ids]
        frames = pack_block(block, planes)
        ends = at + np.cumsum([len(f) for f in frames], dtype=np.int64) if frames else np.empty(0, np.int64)
        index.append(struct.pack("<III", len(block), len(frames), 8 * (planes == "byte")) + struct.pack("<Q", at) + ends.astype("<u8").tobytes())
        out += frames
        at = int(ends[-1]) if frames else at
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    table = zstandard.compress(np.packbits(known).tobytes() + np.diff(keys, prepend=0).astype("<i8").tobytes() + sizes.astype("<i8").tobytes(), 1)
    index_bytes = b"".join(index)
    return b"".join([*out, table, index_bytes, FOOTER.pack(at, at + len(table), len(doc_ids), len(index), MAGIC)])


class ShardReader:
    """Random access to the blocks and documents of one shard's bytes."""

    def __init__(self, payload: bytes) -> None:
        self.payload = payload
        table_at, index_at, n, blocks, magic = FOOTER.unpack_from(payload, len(payload) - FOOTER.size)
        if magic != MAGIC or payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        table, flags = zstandard.decompress(payload[table_at:index_at]), (n + 7) // 8
        known = np.unpackbits(np.frombuffer(table, np.uint8, flags), count=n)
        keys = np.cumsum(np.frombuffer(table, "<i8", n, flags))
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known)]
        self.sizes = np.frombuffer(table, "<i8", n, flags + 8 * n)
        self.blocks, at = [], index_at
        for _ in range(blocks):
            size, frames, width = struct.unpack_from("<III", payload, at)
            self.blocks.append((size, "byte" if width else "bit", np.frombuffer(payload, "<u8", frames + 1, at + 12)))
            at += 12 + 8 * (frames + 1)

    def block(self, k: int) -> np.ndarray:
        size, kind, cuts = self.blocks[k]
        return unpack_block([self.payload[a:b] for a, b in zip(cuts, cuts[1:])], size, kind)

    def ids(self) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint32), *(self.block(k) for k in range(len(self.blocks)))])


def write_shards(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    planes: str = "bit",
    block_ids: int = BLOCK_IDS,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Encode every whole text and store the ids in ascending order of ``id_col``.

    The vocabulary's added tokens count inside texts, as in the library.

    Null texts are empty and give the end id only; null ids come first; rows
    with one id are ordered by their text.  Other columns are left out, whatever
    their names.  A document's ids are never split over shards, so a very long
    text makes a larger shard, up to the 2 GB of an Arrow cell (about 500 million
    ids before compression; more fails the job).  An empty table gives no shard.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> pa.RecordBatch:
            keys = [d for k, _, _ in held for d in k]
            sizes, ids = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            payload = pack_shard(keys, sizes, ids, planes, block_ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *(pa.array([n], pa.int64()) for n in (before, len(keys), len(ids))), pa.array([payload], pa.binary())], ["part", "seq", "before", "n_docs", "n_ids", "payload"])

        for batch in slices(batches, "text", 8 << 20):
            ids, bounds = with_end(*encoder(vocabulary).encode(batch.column("text")), end_id)
            keys = batch.column("id").to_pylist()
            filled = sum(len(h[2]) for h in held)
            group = (bounds[:-1] + filled) // shard_ids
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(keys)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if held and (i or group[0]):
                    yield flush()
                    seq, before, held = seq + 1, before + sum(len(h[2]) for h in held), []
                held.append((keys[a:b], np.diff(bounds[a : b + 1]), ids[bounds[a] : bounds[b]]))
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    return write_shared(ordered.mapInArrow(encode, SHARD_SCHEMA), "token-shards")


def read_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of stored shards: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``.

    ``start`` counts the ids before a document over all shards: those before
    its shard within the partition that wrote it are stored, and the driver gets
    one number for each such partition.  Nothing is shuffled.
    """
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    starts, run = {}, 0
    for part in sorted(totals):
        starts[part], run = run, run + totals[part]
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, offset, payload in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("payload")):
                reader = ShardReader(payload.as_py())
                ids = reader.ids().astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(reader.sizes)]).astype(np.int64)
                view = memoryview(ids.tobytes())
                cols = [pa.array(reader.doc_ids, pa.int64()), pa.array(bounds[:-1] + (starts[part] + offset)), pa.array(reader.sizes.astype(np.int64)), pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return shards.select("part", "before", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op1_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
