"""Block-compressed files: gzip members of at most 64 KiB that carry their own size, so that a reader
can start at any of them.  A place in such a file is the block's offset times 65,536 plus the place in
the block's bytes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import BinaryIO

# Fixed values of the format.
MARK = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes a writer puts into one block; even incompressible they stay below 64 KiB.
FILL = 65_280


def compress(data: bytes) -> bytes:
    out = bytearray()
    for at in range(0, len(data), FILL):
        piece = data[at : at + FILL]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(piece) + z.flush()
        out += MARK + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(piece), len(piece))
    return bytes(out) + END


def block_size(head: bytes) -> int | None:
    """Size of the block that starts with these bytes; None if they start none."""
    if len(head) < 18 or head[:4] != MARK:
        return None
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 6 <= min(end, len(head)):
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return None


class Blocks:
    """Bytes of a file from the first block at or after an offset on, loaded as they are needed.

    Bytes are numbered from that block's first one; ``need`` loads, ``drop`` forgets."""

    def __init__(self, raw: BinaryIO, offset: int) -> None:
        self.raw = raw
        self.size = raw.seek(0, 2)
        self.buffer, self.first = bytearray(), 0
        self.starts: list[int] = []
        self.offsets: list[int] = []
        self.at = self._find(offset)

    def _load(self, at: int) -> tuple[bytes, int] | None:
        """(bytes, offset of the next block) of the block at this offset, None if there is none."""
        self.raw.seek(at)
        head = self.raw.read(512)
        size = block_size(head)
        if size is None:
            return None
        z = zlib.decompressobj(31)
        try:
            data = z.decompress(head[:size] + self.raw.read(max(0, size - len(head))))
        except zlib.error:
            return None
        return (data, at + size) if z.eof else None

    def _find(self, at: int) -> int:
        while at < self.size:
            self.raw.seek(at)
            window = self.raw.read(1 << 17)
            found = window.find(MARK)
            while found >= 0:
                if self._load(at + found):
                    return at + found
                found = window.find(MARK, found + 1)
            at += max(1, len(window) - len(MARK) + 1)
        return self.size

    def need(self, upto: int) -> bool:
        """Whether the bytes before number ``upto`` exist; they are loaded then."""
        while self.first + len(self.buffer) < upto:
            if self.at >= self.size:
                return False
            loaded = self._load(self.at)
            if loaded is None:
                raise ValueError(f"damaged block at {self.at}")
            if loaded[0]:
                self.starts.append(self.first + len(self.buffer))
                self.offsets.append(self.at)
                self.buffer += loaded[0]
            self.at = loaded[1]
        return True

    def get(self, begin: int, end: int) -> bytes:
        return bytes(self.buffer[begin - self.first : end - self.first])

    def place(self, i: int) -> int | None:
        """Place in the file of byte number i, None at the end of the file."""
        if not self.need(i + 1):
            return None
        k = bisect_right(self.starts, i) - 1
        return self.offsets[k] << 16 | (i - self.starts[k])

    def drop(self, i: int) -> None:
        """Forget the blocks that end before byte number i."""
        k = bisect_right(self.starts, i) - 1
        if k > 0:
            del self.buffer[: self.starts[k] - self.first]
            self.first = self.starts[k]
            del self.starts[:k], self.offsets[:k]


def ranges(raw: BinaryIO, split: int) -> Iterator[tuple[int, int]]:
    """Ranges of a block-compressed file of about ``split`` bytes each; none if it cannot be split."""
    size = raw.seek(0, 2)
    raw.seek(0)
    if split > 0 and size > split and block_size(raw.read(512)):
        for at in range(0, size, split):
            yield at, min(size, at + split)
