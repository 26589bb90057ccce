"""Lines of a file at any byte: the few that are wanted, and nothing else where the file can be entered anywhere."""

from __future__ import annotations

from collections.abc import Iterator

from .files import _open, decompressed, opened

#: Bytes that are read at once, backwards and forwards.
STEP = 64 << 10
#: Bytes behind which a compressed file that can't be entered is kept at hand.
HELD = 4 << 20


class Sequential:
    """The plain bytes of a compressed file that is read from its start: forwards at once, backwards within ``HELD`` bytes, else anew."""

    def __init__(self, raw, kind: str) -> None:
        self.raw, self.kind = raw, kind
        self._restart()

    def _restart(self) -> None:
        self.raw.seek(0)
        self.stream, self.base, self.data = decompressed(self.raw, self.kind), 0, b""

    def read_at(self, a: int, n: int) -> bytes:
        if a < self.base:
            self._restart()
        while a + n > self.base + len(self.data):
            block = self.stream.read(max(STEP, a + n - self.base - len(self.data)) if a <= self.base + len(self.data) else HELD)
            if not block:
                break
            self.data += block
            if len(self.data) > 2 * HELD and a > self.base + len(self.data) - HELD:
                cut = len(self.data) - HELD
                self.base, self.data = self.base + cut, self.data[cut:]
        return self.data[max(a - self.base, 0) : max(a + n - self.base, 0)]


class Places:
    """One open file.  ``bytes_read`` counts the plain bytes that were asked for."""

    def __init__(self, root: str, path: str) -> None:
        fs, _ = _open(root)
        self.raw = fs.open_input_file(path)
        kind, source, blocks = opened(self.raw, path, self.raw.size())
        self.source = source if not kind or blocks is not None else Sequential(self.raw, kind)
        self.bytes_read = 0

    def close(self) -> None:
        self.raw.close()

    def read_at(self, a: int, n: int) -> bytes:
        if isinstance(self.source, Sequential):
            out = self.source.read_at(a, n)
        else:
            parts = []
            self.source.seek(a)
            while n > 0 and (block := self.source.read(n)):
                parts.append(block)
                n -= len(block)
            out = b"".join(parts)
        self.bytes_read += len(out)
        return out

    def back(self, a: int, k: int) -> list[int]:
        """Where the ``k`` lines before the one that begins at ``a`` begin, fewer at the start of the file; rising."""
        out: list[int] = []
        if k <= 0 or a <= 0:
            return out
        high = a - 1  # the line feed at the end of the line before
        while high > 0 and len(out) < k:
            low = max(0, high - STEP)
            data = self.read_at(low, high - low)
            at = len(data)
            while len(out) < k and (at := data.rfind(b"\n", 0, at)) >= 0:
                out.append(low + at + 1)
            high = low
        if len(out) < k and (not out or out[-1] > 0):
            out.append(0)
        return out[::-1]

    def start_of(self, byte: int) -> int | None:
        """Where the line that holds a byte begins; None behind the end."""
        if not self.read_at(byte, 1):
            return None
        return (self.back(byte + 1, 1) or [0])[0]

    def count(self, a: int, b: int) -> int:
        """Line feeds from ``a`` up to ``b``."""
        n = 0
        while a < b and (block := self.read_at(a, min(b - a, STEP * 16))):
            n, a = n + block.count(b"\n"), a + len(block)
        return n

    def lines(self, a: int) -> Iterator[tuple[int, int, str]]:
        """Start, end and text of the lines from ``a`` on, which begins one."""
        rest, at, step = b"", a, 4096
        while True:
            block = self.read_at(a, step)
            a, step = a + len(block), STEP
            data = rest + block
            cut = len(data) if not block else data.rfind(b"\n") + 1
            whole, rest = data[:cut], data[cut:]
            for piece in _split(whole):
                text = piece[:-1] if piece.endswith(b"\n") else piece
                yield at, at + len(piece), (text[:-1] if text.endswith(b"\r") else text).decode("utf-8", "replace")
                at += len(piece)
            if not block:
                return


def _split(data: bytes) -> list[bytes]:
    """Lines with their line feeds; no other character ends one."""
    parts = data.split(b"\n")
    return [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
