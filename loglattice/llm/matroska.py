"""Media columns: Matroska files in binary columns, parsed into packet tables.

``mux`` stores bytes as 8-bit PCM samples of one audio track.  ``packets``
walks the EBML elements of any Matroska file: variable-length ids and sizes
(unknown sizes too), clusters, simple blocks and block groups, the three kinds
of lacing, and cues.  A packet's row has its track, timestamp and byte range in
the file, so that a reader fetches only what it needs; ``tail`` shows that with
the cues.  Timestamps follow the file's scale; packets of a lace follow each
other by the track's default duration, or share the block's where that is given.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, text_of, write_shared

# Element ids and codes: fixed values of the Matroska and EBML specifications.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, BLOCK_DURATION = 0x23E383, 0x9B
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: What ends a cluster of unknown size: children of the segment, a segment or the head of another file.
TOP_LEVEL = {CLUSTER, CUES, TRACKS, INFO, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}

FRAME = 192  # samples of a packet
RATE = 8000
LACED = 8  # packets of a block
BLOCKS = 40  # blocks of a cluster: its timestamps fit the 16 bits that blocks have
PACKETS = "track int, timestamp_ms long, offset long, size int, cluster int, lacing int, keyframe boolean"


class Packet(NamedTuple):
    track: int
    timestamp_ms: int
    offset: int
    size: int
    cluster: int
    lacing: int
    keyframe: bool


def _size(n: int) -> bytes:
    """A variable-length size; all ones are kept for the unknown size."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(ident: int, content: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


HEAD = element(
    EBML,
    number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2),
)


def track(frame: int) -> bytes:
    """One track of 8-bit samples, ``frame`` of them in a packet."""
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">f", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    head = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, 1_000_000_000 * frame // RATE)
    return element(TRACKS, element(TRACK_ENTRY, head + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The frames of one block: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if len(frames) == 1 or not lacing:
        return b"".join(frames)
    head = bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == 3:
        head += _size(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            width, d = 1, len(b) - len(a)
            while not -(1 << 7 * width - 1) < d < (1 << 7 * width - 1):
                width += 1
            head += ((1 << 7 * width) | (d + (1 << 7 * width - 1) - 1)).to_bytes(width, "big")
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, lacing: int = 2, laced: int = LACED) -> bytes:
    """A Matroska file whose samples are ``payload``; equal payloads give equal files."""
    ms = 1000 * frame // RATE
    frames = [payload[a : a + frame] for a in range(0, len(payload), frame)]
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", 1000 * len(payload) / RATE)) + element(MUXING_APP, b"loglattice") + element(WRITING_APP, b"loglattice"))
    body, cues = [info, track(frame)], []
    at = sum(map(len, body))
    for c in range(0, len(frames), laced * BLOCKS):
        blocks = [number(TIMESTAMP, c * ms)]
        for a in range(c, min(c + laced * BLOCKS, len(frames)), laced):
            held = frames[a : a + laced]
            kind = lacing if len(held) > 1 and (lacing != 2 or len(held[-1]) == frame) else 0
            if not kind and len(held) > 1:
                kind = 1
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (a - c) * ms, 0x80 | kind << 1) + lace(held, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * ms) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    return HEAD + element(SEGMENT, b"".join(body))


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if width > 4:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A size, or None where it is unknown."""
    width = 9 - data[at].bit_length()
    if width > 8:
        raise ValueError(f"no element size at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, within: int = 0) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of the content of each element in a range of bytes."""
    while at < end:
        ident, start = read_id(data, at)
        if within == CLUSTER and ident in TOP_LEVEL:
            return
        size, start = read_size(data, start)
        if size is None:
            stop = end if ident != CLUSTER else max([start, *(e for _, _, e in elements(data, start, end, CLUSTER))])
        else:
            stop = min(start + size, end)
        yield ident, start, stop
        at = stop


class Times(NamedTuple):
    """Nanoseconds of a tick, and of a packet by track."""

    scale: int = 1_000_000
    durations: dict[int, int] = {}


def block_packets(data: bytes, start: int, end: int, base: int, cluster: int, simple: bool, times: Times, ticks: int | None = None) -> Iterator[Packet]:
    """The packets of a block, with their byte ranges in ``data``; ``ticks``: the block's duration, if given."""
    track, at = read_size(data, start)
    offset, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing, sizes = flags >> 1 & 3, []
    if lacing:
        n, at = data[at], at + 1
        if lacing == 1:
            for _ in range(n):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
        elif lacing == 3 and n:
            size, at = read_size(data, at)
            sizes.append(size)
            for _ in range(n - 1):
                width = 9 - data[at].bit_length()
                raw = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
                sizes.append(sizes[-1] + raw - (1 << 7 * width - 1) + 1)
                at += width
        elif lacing == 2:
            sizes = [(end - at) // (n + 1)] * n
    sizes.append(end - at - sum(sizes))
    begin, keyframe = (base + offset) * times.scale, simple and bool(flags & 0x80)
    step = ticks * times.scale // len(sizes) if ticks is not None else times.durations.get(track, 0)
    for k, size in enumerate(sizes):
        yield Packet(track, (begin + k * step) // 1_000_000, at, size, cluster, lacing, keyframe)
        at += size


def _number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def cluster_packets(data: bytes, start: int, end: int, k: int, times: Times) -> Iterator[Packet]:
    base = 0
    for ident, a, b in elements(data, start, end, CLUSTER):
        if ident == TIMESTAMP:
            base = _number(data, a, b)
        elif ident == SIMPLE_BLOCK:
            yield from block_packets(data, a, b, base, k, True, times)
        elif ident == BLOCK_GROUP:
            group = {inner: (x, y) for inner, x, y in elements(data, a, b)}
            if BLOCK in group:
                ticks = _number(data, *group[BLOCK_DURATION]) if BLOCK_DURATION in group else None
                yield from block_packets(data, *group[BLOCK], base, k, False, times, ticks)


def _times(data: bytes, top: list[tuple[int, int, int]]) -> Times:
    scale, durations = 1_000_000, {}
    for ident, a, b in top:
        if ident == INFO:
            scale = next((_number(data, x, y) for inner, x, y in elements(data, a, b) if inner == TIMESTAMP_SCALE), scale)
        elif ident == TRACKS:
            for _, c, d in elements(data, a, b):
                values = {x: _number(data, p, q) for x, p, q in elements(data, c, d) if x in (TRACK_NUMBER, DEFAULT_DURATION)}
                if len(values) == 2:
                    durations[values[TRACK_NUMBER]] = values[DEFAULT_DURATION]
    return Times(scale, durations)


def parse(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]]]:
    """All packets, and the cues as time in ticks, track and byte of the cluster."""
    found, cues, k = [], [], 0
    for ident, start, end in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        top = list(elements(data, start, end))
        times = _times(data, top)
        for inner, a, b in top:
            if inner == CLUSTER:
                found += cluster_packets(data, a, b, k, times)
                k += 1
            elif inner == CUES:
                for point, c, d in elements(data, a, b):
                    values = {}
                    for x, p, q in elements(data, c, d):
                        if x == CUE_TRACK_POSITIONS:
                            values |= {y: _number(data, r, s) for y, r, s in elements(data, p, q)}
                        else:
                            values[x] = _number(data, p, q)
                    cues.append((values.get(CUE_TIME, 0), values.get(CUE_TRACK, 0), start + values.get(CUE_CLUSTER_POSITION, 0)))
    return found, cues


def tail(data: bytes, cues: list[tuple[int, int, int]], n: int) -> bytes:
    """The last ``n`` bytes of the track, read from the last cue's cluster alone."""
    if not cues:
        return b""
    _, start = read_id(data, max(cues)[2])
    size, start = read_size(data, start)
    held = list(cluster_packets(data, start, len(data) if size is None else start + size, 0, Times()))
    return b"".join(data[p.offset : p.offset + p.size] for p in held[-n:])[-n:]


def with_media(df: DataFrame, text_col: str = "text", media_col: str = "media", unit: int = 192) -> DataFrame:
    """``df`` and each text's UTF-8 bytes, padded by spaces to a positive multiple of ``unit``, as a Matroska file.

    A null text is empty.  ``media_col`` replaces a column of that name; the
    other columns pass unchanged.
    """
    kept = [c for c in df.columns if c != media_col]
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col]).alias("rest"), F.col(text_col).cast("string").alias("text"))
    schema = f"rest {source.schema['rest'].dataType.simpleString()}, text string, media binary"

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            media = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                media.append(mux(raw + b" " * (-len(raw) % unit if raw else unit)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(media, pa.binary())], ["rest", "text", "media"])

    out = source.mapInArrow(store, schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in kept], F.col("media").alias(media_col))


_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]


def packet_table(media: list[bytes | None]) -> tuple[pa.RecordBatch, list[list[tuple[int, int, int]]]]:
    """The packets of some files, with each packet's ``file`` by its place; and each file's cues."""
    rows, cues = [], []
    for k, data in enumerate(media):
        found, own = parse(data) if data else ([], [])
        rows += [(k, *p) for p in found]
        cues.append(own)
    cols = list(zip(*rows)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], ["file", *Packet._fields]), cues


def packets(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """The packet table of a media column: one row for each packet, none for null or empty media.

    Bytes that aren't Matroska fail the job.  Repeated rows give repeated packets.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 4 << 20):
            table, _ = packet_table(batch.column("media").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(table.column("file")), *table.columns[1:]], ["id", *Packet._fields])

    source = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return source.mapInArrow(walk, f"id {source.schema['id'].dataType.simpleString()}, {PACKETS}")


def features(samples: bytes, n_packets: int, n_cues: int) -> str:
    """Counts and the level of the samples, as text."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    return f"packets={n_packets};cues={n_cues};ms={1000 * len(x) // RATE};mean={int(x.sum()) * 1000 // max(len(x), 1)};energy={int((x * x).sum()) // max(len(x), 1)};crossings={int(np.count_nonzero(np.diff(x > 127)))}"


def read_media(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """What the stored bytes hold: digests of file and samples, and features, one row for each file.

    Samples are the byte ranges of the file's packet table; the last ones are
    found by the cues.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 4 << 20):
            media, rows = batch.column("media").to_pylist(), []
            table, cues = packet_table(media)
            file, offset, size = (table.column(c).to_numpy() for c in ("file", "offset", "size"))
            cuts = np.searchsorted(file, np.arange(len(media) + 1))
            for k, (data, n) in enumerate(zip(media, batch.column("n_bytes").to_pylist())):
                own = slice(cuts[k], cuts[k + 1])
                samples = b"".join([data[a : a + m] for a, m in zip(offset[own].tolist(), size[own].tolist())])
                found = int(cuts[k + 1] - cuts[k])
                rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(tail(data, cues[k], 16)), len(data), hashlib.sha256(data).hexdigest(), features(samples, found, len(cues[k])), found))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"]
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col("__n_bytes").alias("n_bytes"), F.col(media_col).alias("media"))
    return source.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long")


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the media column in the shared folder, and reads it back from there."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    media = with_media(docs).select("doc_id", "media", F.octet_length(text_of(docs, "text")).cast("long").alias("__n_bytes"))
    return read_media(write_shared(media, "media"), "doc_id")
