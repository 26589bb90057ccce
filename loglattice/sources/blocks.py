"""Blocks of compressed files that can be read by themselves: frames of seekable zstandard, blocks of xz by their index, blocks of bzip2 by their marks."""

from __future__ import annotations

import bisect
import bz2
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import zstandard

from .seekable import FOOTER, is_seekable, read_seek_table

#: Place and size of a block's own bytes, place and size of what it holds.
Block = tuple[int, int, int, int]

# Fixed values of the formats.
XZ_MAGIC, XZ_FOOTER_MAGIC = b"\xfd7zXZ\x00", b"YZ"
BZ_BLOCK, BZ_END = 0x314159265359, 0x177245385090
#: Bytes of a bzip2 file that are searched for marks at once.
SEARCH = 1 << 20


class BlockStream:
    """The plain bytes of a file in blocks, from any place on; one block is held at a time."""

    def __init__(self, raw, blocks: list[Block], decode: Callable[[bytes, int, int], bytes]) -> None:
        self.raw, self.blocks, self.decode = raw, blocks, decode
        self.starts = [b for _, _, b, _ in blocks]
        self.at, self.held, self.plain = 0, -1, b""

    def seek(self, at: int) -> None:
        self.at = at

    def tell(self) -> int:
        return self.at

    def read(self, most: int) -> bytes:
        k = max(bisect.bisect_right(self.starts, self.at) - 1, 0)
        while k < len(self.blocks):
            a, size, b, n = self.blocks[k]
            if self.at < b + n:
                if k != self.held:
                    self.raw.seek(a)
                    self.held, self.plain = k, self.decode(self.raw.read(size), n, k)
                out = self.plain[self.at - b : self.at - b + most]
                self.at += len(out)
                return out
            k += 1
        return b""


def zstd_frame(packed: bytes, n: int, _: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=max(n, 1))


def zstd_frames(raw, size: int) -> list[Block] | None:
    """The frames of a seekable file by its last bytes, None if it isn't one."""
    if size < FOOTER.size:
        return None
    raw.seek(size - FOOTER.size)
    tail = raw.read(FOOTER.size)
    n, _, _ = FOOTER.unpack(tail)
    if not is_seekable(tail):
        return None
    want = min(size, FOOTER.size + 8 + n * 12)
    raw.seek(size - want)
    return read_seek_table(raw.read(want), False)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and the place behind it."""
    out = shift = 0
    while True:
        out |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            return out, at


def _packed_number(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def xz_blocks(raw, size: int) -> tuple[list[Block], Callable[[bytes, int, int], bytes]] | None:
    """The blocks of an xz file of one or more streams by the indexes at their ends, and what reads them; None if it is of another shape."""
    out: list[tuple[int, int, int]] = []
    end, kinds = size, set()
    while end > 0:
        raw.seek(end - 4)
        if raw.read(4) == bytes(4):  # padding between streams
            end -= 4
            continue
        if end < 32:
            return None
        raw.seek(end - 12)
        _, backward, flags, magic = struct.unpack("<II2s2s", raw.read(12))
        if magic != XZ_FOOTER_MAGIC:
            return None
        length = (backward + 1) * 4
        raw.seek(end - 12 - length)
        index = raw.read(length)
        if index[0] != 0:
            return None
        many, at = _number(index, 1)
        sizes = []
        for _ in range(many):
            unpadded, at = _number(index, at)
            plain, at = _number(index, at)
            sizes.append((unpadded, plain))
        start = end - 12 - length - sum(-(-u // 4) * 4 for u, _ in sizes)
        kinds.add(flags)
        mine, place = [], start
        for unpadded, plain in sizes:
            mine.append((place, unpadded, plain))
            place += -(-unpadded // 4) * 4
        out = mine + out
        end = start - 12
    if end or len(kinds) != 1:
        return None
    placed, b = [], 0
    for a, n, plain in out:
        placed.append((a, -(-n // 4) * 4, b, plain))
        b += plain
    return placed, _xz_block(kinds.pop(), [n for _, n, _ in out])


def _xz_block(flags: bytes, unpadded: list[int]) -> Callable[[bytes, int, int], bytes]:
    """Reads a block as a stream of its own."""

    def decode(block: bytes, n: int, k: int) -> bytes:
        index = b"\0" + _packed_number(1) + _packed_number(unpadded[k]) + _packed_number(n)
        index += bytes(-len(index) % 4)
        index += struct.pack("<I", zlib.crc32(index))
        back = struct.pack("<I2s", len(index) // 4 - 1, flags)
        head = XZ_MAGIC + flags + struct.pack("<I", zlib.crc32(flags))
        return lzma.decompress(head + block + index + struct.pack("<I", zlib.crc32(back)) + back + XZ_FOOTER_MAGIC)

    return decode


def _marks(data: bytes, mark: int) -> list[int]:
    """The bits of ``data`` at which a mark of 48 bits begins."""
    out = []
    for shift in range(8):
        whole = (mark << (8 - shift) if shift else mark).to_bytes(7 if shift else 6, "big")
        inner, lead = (whole[1:6], 1) if shift else (whole, 0)
        at = data.find(inner)
        while at >= 0:
            a = at - lead
            if a >= 0 and (not shift or (a + 7 <= len(data) and data[a] & (0xFF >> shift) == whole[0] and data[a + 6] >> (8 - shift) == whole[6] >> (8 - shift))):
                out.append(8 * a + shift)
            at = data.find(inner, at + 1)
    return sorted(out)


class BzBlocks:
    """The blocks of a bzip2 file from a place on, each as plain bytes; their marks lie at any bit."""

    def __init__(self, raw, start: int, stop: int) -> None:
        self.raw, self.stop = raw, stop
        self.data, self.base = b"", start
        raw.seek(start)
        self.level = b"9"

    def _more(self) -> bool:
        got = self.raw.read(SEARCH)
        self.data += got
        return bool(got)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        """The byte in which a block's mark begins, and the block's plain bytes; goes on behind ``stop`` for as long as it is asked."""
        at = None
        searched = 0
        while True:
            # Marks in what hasn't been searched; a mark may begin up to seven bytes before.
            low = max(0, searched - 7)
            found = sorted({*((8 * low + m, True) for m in _marks(self.data[low:], BZ_BLOCK)), *((8 * low + m, False) for m in _marks(self.data[low:], BZ_END))})
            searched = len(self.data)
            for bit, begins in found:
                if at is not None and bit > at:
                    yield self.base + at // 8, self._plain(at, bit)
                    at = None
                if begins and (at is None or bit > at):
                    at = bit
            keep = len(self.data) - 7 if at is None else at // 8
            keep = max(0, min(keep, len(self.data)))
            if at is not None:
                at -= 8 * keep
            self.data, self.base, searched = self.data[keep:], self.base + keep, searched - keep
            if at is None and self.base >= self.stop and not found:
                return  # nothing more begins before the stop, and nobody waits for a line's end
            if not self._more():
                return

    def _plain(self, a: int, b: int) -> bytes:
        bits = np.unpackbits(np.frombuffer(self.data[a // 8 : -(-b // 8)], np.uint8))[a % 8 : a % 8 + b - a]
        check = bits[48:80]
        number = lambda x, n: np.unpackbits(np.frombuffer(x.to_bytes(n, "big"), np.uint8))
        whole = np.concatenate([bits, number(BZ_END, 6), check])
        return bz2.decompress(b"BZh9" + np.packbits(whole).tobytes())
