"""Vector hashing of bytes and words: one pass of numpy per step, no Python loop per item."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
# Odd multipliers; any odd numbers with well-spread bits do.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole 64-bit word (xor-shift-multiply, invertible)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=None)
def byte_table(seed: int) -> np.ndarray:
    return mix(mix(np.arange(256, dtype=U) + U(seed * 1000 + 1)))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, kept for the longest piece seen so far."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < size:
        room = 1 << max(16, int(size - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(room, b, U)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        known = _POWERS[base] = (out[0], out[1])
    return known


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit items, from prefix sums (two bases)."""

    def __init__(self, items: np.ndarray):
        size = len(items)
        self._prefix = []
        for base in _BASES:
            up, down = _powers(base, size + 1)
            sums = np.zeros(size + 1, U)
            np.cumsum(items * up[:size], out=sums[1:])
            self._prefix.append((sums, down))

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        (p, down), (q, down2) = self._prefix
        first = (p[end] - p[start]) * down[start]
        second = (q[end] - q[start]) * down2[start]
        length = (end - start).astype(U) + U(seed << 40)
        return mix(mix(first + length * U(_BASES[1])) ^ (second * U(_BASES[0])))


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position on; length is a power of two."""
    h = byte_table(3)[data]
    span = 1
    while span < length:
        if len(h) <= span:
            return np.zeros(0, U)
        h = h[:-span] * U(_BASES[0] + 2 * span) + (h[span:] ^ (h[span:] >> U(29)))
        span *= 2
    return mix(h)


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: bytes that are not ``blank`` (space, tab to carriage return). Words end with their row."""
    solid = ~blank[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = solid[inner]
    end[inner - 1] = solid[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RangeHash(byte_table(5)[data])(starts, ends)


def words_of_rows(
    offsets: np.ndarray, data: np.ndarray, limit: int = 1 << 20, blank: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows: (hashes, starts, ends, words before each row).

    Works through pieces of about ``limit`` bytes, cut between rows or, in a long
    row, at white space, so memory for the byte-wide arrays stays bounded unless
    a single word is longer than that.
    """
    hashes, starts, ends = [], [], []
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        to = min(at + limit, last)
        if to < last:
            cut = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if cut > at:
                to = cut
            else:
                row_end = int(offsets[np.searchsorted(offsets, at, "right")])
                while to < row_end and not blank[data[to]]:
                    to += 1
        piece = data[at:to]
        low, high = np.searchsorted(offsets, [at, to])
        s, e = word_spans(piece, offsets[low : high + 1] - at, blank)
        hashes.append(word_hashes(piece, s, e))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    begin = np.concatenate(starts)
    return np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values: running minima within blocks from both ends."""
    size = len(values)
    if size < width:
        return values[:0]
    room = -(-size // width) * width
    padded = np.full(room, np.iinfo(U).max, U)
    padded[:size] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: size - width + 1], ahead[width - 1 : size])


def runs(valid: np.ndarray, label: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of maximal stretches of valid items with one label; ``fresh`` items begin a stretch."""
    if not len(valid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(valid), bool)
    change[1:] = (label[1:] != label[:-1]) | fresh[1:] | ~valid[:-1]
    last = np.ones(len(valid), bool)
    last[:-1] = change[1:] | ~valid[1:]
    return np.flatnonzero(valid & change), np.flatnonzero(valid & last)
