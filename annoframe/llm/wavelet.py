"""Token files: one wavelet matrix per shard.

The ids of a shard's documents stand in one sequence. A wavelet matrix has a plane of
bits for each bit of an id, the highest first; each plane orders the ids stably by the
bits before it. Counts of ones before every block of a plane make rank a lookup and a
count of bits, and select a search. So a file gives the token at a place, counts a token
in a range and finds its n-th occurrence without decoding the rest.

Layout, little-endian: fixed header; ends and ids of the documents, and a byte for each
that is 1 where it has no id; then for each plane the number of zeros, the ones before each block, the offsets of the compressed blocks, and
the blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard

#: Fixed values of the file format.
MAGIC = b"WVLT0001"
HEADER = struct.Struct("<8sQQII")
#: Bytes of bits in a block.
BLOCK = 1 << 12

_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def build(ids: np.ndarray, ends: np.ndarray, names: list[int | None], bits: int) -> bytes:
    """A file of all ids, with the place after the last id of each document, and its name."""
    n = len(ids)
    out = [HEADER.pack(MAGIC, n, len(ends), bits, BLOCK), np.asarray(ends, "<u8").tobytes()]
    out += [np.array([x or 0 for x in names], "<i8").tobytes(), bytes(x is None for x in names)]
    pack = zstandard.ZstdCompressor(level=1).compress
    now = np.asarray(ids, np.uint32 if bits > 16 else np.uint16)
    for bit in range(bits - 1, -1, -1):
        ones = (now >> now.dtype.type(bit)) & now.dtype.type(1) != 0
        raw = np.packbits(ones, bitorder="little")
        blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
        before = np.concatenate([[0], np.cumsum([int(_ONES[b].sum(dtype=np.int64)) for b in blocks], dtype=np.int64)])
        packed = [pack(b.tobytes()) for b in blocks]
        packed = [p if len(p) < len(b) else b.tobytes() for p, b in zip(packed, blocks, strict=True)]
        places = np.concatenate([[0], np.cumsum([len(p) for p in packed], dtype=np.int64)])
        out += [struct.pack("<Q", n - int(before[-1])), before.astype("<u8").tobytes(), places.astype("<u8").tobytes(), *packed]
        now = np.concatenate([now[~ones], now[ones]])
    return b"".join(out)


class WaveletMatrix:
    """Read access to one file; only blocks that a question needs are decompressed."""

    def __init__(self, raw: bytes):
        self.raw = memoryview(raw)
        magic, self.n, documents, self.bits, self.block = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.ends = np.frombuffer(raw, "<u8", documents, at).astype(np.int64)
        named = np.frombuffer(raw, "<i8", documents, at + 8 * documents).tolist()
        self.names = [None if blank else name for name, blank in zip(named, bytes(self.raw[at + 16 * documents : at + 17 * documents]), strict=True)]
        at += 17 * documents
        self.zeros, self.before, self.places, self.start = [], [], [], []
        blocks = -(-(-(-self.n // 8)) // self.block)
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<Q", raw, at)[0])
            self.before.append(np.frombuffer(raw, "<u8", blocks + 1, at + 8).astype(np.int64))
            self.places.append(np.frombuffer(raw, "<u8", blocks + 1, at + 16 + 8 * blocks).astype(np.int64))
            self.start.append(at + 24 + 16 * blocks)
            at = self.start[-1] + int(self.places[-1][-1])
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _bytes(self, level: int, block: int) -> np.ndarray:
        key = level, block
        if key not in self._held:
            if len(self._held) > 4096:
                self._held = {}
            a, b = self.start[level] + int(self.places[level][block]), self.start[level] + int(self.places[level][block + 1])
            size = min(self.block, -(-self.n // 8) - block * self.block)
            piece = bytes(self.raw[a:b])
            self._held[key] = np.frombuffer(piece if len(piece) == size else zstandard.ZstdDecompressor().decompress(piece), np.uint8)
        return self._held[key]

    def _bit(self, level: int, place: int) -> int:
        return int(self._bytes(level, place // (8 * self.block))[place // 8 % self.block] >> (place & 7) & 1)

    def rank(self, level: int, place: int) -> int:
        """The ones of a plane before the place."""
        block, rest = divmod(place, 8 * self.block)
        total = int(self.before[level][block])
        if rest:
            piece = self._bytes(level, block)
            total += int(_ONES[piece[: rest // 8]].sum(dtype=np.int64))
            if rest & 7:
                total += int(_ONES[int(piece[rest // 8]) & ((1 << (rest & 7)) - 1)])
        return total

    def select(self, level: int, one: bool, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        before = self.before[level]
        counts = before if one else np.minimum(np.arange(len(before)) * 8 * self.block, self.n) - before
        block = int(np.searchsorted(counts, k, "right")) - 1
        flags = np.unpackbits(self._bytes(level, block), bitorder="little") == (1 if one else 0)
        return block * 8 * self.block + int(np.flatnonzero(flags)[k - int(counts[block])])

    def token(self, place: int) -> int:
        """The id at a place."""
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, place), self.rank(level, place)
            value = value << 1 | bit
            place = self.zeros[level] + ones if bit else place - ones
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank(level, start), self.rank(level, stop)
            start, stop = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id stands in places from start to before stop."""
        if token >> self.bits:
            return 0
        stop = self.n if stop is None else min(stop, self.n)
        a, b = self._range(token, min(start, stop), stop)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        if token >> self.bits or not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - level) & 1)
            place = self.select(level, one, place - self.zeros[level] if one else place)
        return place

    def tokens(self) -> np.ndarray:
        """All ids, plane by plane from the lowest: a plane undoes the order it made."""
        kind = np.uint32 if self.bits > 16 else np.uint16
        values = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            raw = np.concatenate([self._bytes(level, k) for k in range(len(self.before[level]) - 1)]) if self.n else np.zeros(0, np.uint8)
            ones = np.unpackbits(raw, bitorder="little")[: self.n].astype(bool)
            back = np.empty(self.n, kind)
            back[~ones] = values[: self.zeros[level]]
            back[ones] = values[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            values = back
        return values

    def documents(self) -> Iterator[np.ndarray]:
        ids, start = self.tokens(), 0
        for end in self.ends.tolist():
            yield ids[start:end]
            start = end
