"""Words of UTF-8 texts and their 64-bit hashes, by arrays of bytes."""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 20
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_STEPS = np.random.default_rng(7).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


#: Words ``[^\x20\x09-\x0D]+``, and after lower-casing ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; all bytes of other letters belong to words.
NOT_SPACE = ~byte_table(SPACES)
ALPHANUMERIC = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, bounds: np.ndarray, members: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and the first word of every text (one more than texts).

    ``members``: the bytes of words, after lower-casing if ``lower``. Equal words have
    equal hashes; different words differ but for one chance in 2**64.
    """
    values = LOWER[data] if lower else data
    inside = members[values]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[:-1][np.diff(bounds) > 0]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    firsts = np.searchsorted(starts, bounds)
    hashes = np.empty(len(starts), np.uint64)
    ends = np.empty(len(starts), np.int64)
    table = np.where(members, _RANDOM, np.uint64(0))
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
        lo, hi = starts[at], starts[upto] if upto < len(starts) else len(data)
        mine = starts[at:upto] - lo
        lengths = np.add.reduceat(inside[lo:hi], mine, dtype=np.int64)
        ends[at:upto] = starts[at:upto] + lengths
        powers = _powers(int((np.diff(np.append(mine, hi - lo))).max()))
        place = np.arange(hi - lo) - np.repeat(mine, np.diff(np.append(mine, hi - lo)))
        sums = np.add.reduceat(table[values[lo:hi]] * powers[place], mine)
        hashes[at:upto] = mixed(sums + lengths.astype(np.uint64))
        at = upto
    return starts, ends, hashes, firsts


def other_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the same words by other numbers: two words that agree in both kinds are the same but for one chance in 2**128."""
    lengths = ends - starts
    upto = np.concatenate([[0], np.cumsum(lengths)])
    if not upto[-1]:
        return np.zeros(len(starts), np.uint64)
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], lengths)
    values = data[np.repeat(starts, lengths) + place]
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max()) - 1, _OTHER_BASE, np.uint64)]))
    return mixed(np.add.reduceat(_OTHER[values] * powers[place], upto[:-1]) + lengths.astype(np.uint64))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _BASE, np.uint64)]))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, by its first word; runs over the end are not made."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _STEPS[0]
    for k in range(1, width):
        total = total + hashes[k : k + n] * _STEPS[k]
    return mixed(total)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash for a sequence that is shorter than a run; unlike that of any run."""
    return mixed((hashes * _STEPS[: len(hashes)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))
