"""Vectorised hashing of words and slices, over Arrow string columns.

Slices are named by doubling: the name of 2h codes mixes the names of its two halves, and the name of any slice mixes the
names of the two longest power-of-two slices that cover it, with its length. Every step is a multiplication followed by
shifts, so no algebra of sums makes different strings collide; names are equal for equal strings wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once: the arrays made of them fit the processor's cache.
CHUNK = 1 << 17
#: Longer words are hashed one by one.
LONG_WORD = 63

LETTERS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True) if seed == 0 else x ^ np.uint64(seed)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray, seed) -> np.ndarray:
    """The name of a slice that consists of a and b."""
    x = b ^ seed
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x += a
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Names:
    """Names of the slices of a sequence of 64-bit codes, up to ``longest`` codes long."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.levels = [codes]
        size = 1
        while size * 2 <= longest and size * 2 <= len(codes):
            last = self.levels[-1]
            self.levels.append(join(last[: len(last) - size], last[size:], np.uint64(size)))
            size *= 2

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of the slices start..end, none empty or over ``longest``."""
        size = end - start
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(start), np.uint64)
        for k in np.flatnonzero(np.bincount(level, minlength=1)).tolist():
            at = np.flatnonzero(level == k)
            s, e = start[at], end[at]
            out[at] = join(self.levels[k][s], self.levels[k][e - (1 << k)], (size[at].astype(np.uint64) << np.uint64(8)))
        return out

    def windows(self, size: int) -> np.ndarray:
        """Names of all slices of one size."""
        n = len(self.levels[0]) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        k = size.bit_length() - 1
        level = self.levels[k]
        return join(level[:n], level[size - (1 << k) : size - (1 << k) + n], np.uint64(size << 8))


class ByteNames:
    """Names of slices of a run of bytes. ``grams`` names the ``gram`` bytes (16 at most) from each place on, read as two
    numbers; longer slices are named by the grams they consist of."""

    def __init__(self, raw: np.ndarray, gram: int):
        n, low = len(raw), min(gram, 8)
        padded = np.zeros(n + 16, np.uint8)
        padded[:n] = raw
        eight = np.empty(n + 8 - n % 8, np.uint64)
        for k in range(8):
            eight[k::8] = padded[k : k + len(eight)].view("<u8")
        if gram < 8:
            eight &= np.uint64((1 << 8 * gram) - 1)
        self.gram, self.size = gram, n
        places = max(0, n - gram + 1)
        self.grams = join(eight[:places], eight[gram - low : gram - low + places], np.uint64(gram))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of some slices start..end. A slice shorter than a gram is named with the bytes that follow it."""
        size = np.maximum(end - start, self.gram)
        steps = -(-size // self.gram)
        out = self.grams[start]
        for step in range(1, int(steps.max(initial=0))):
            more = np.flatnonzero(steps > step)
            at = start[more] + np.minimum(step * self.gram, size[more] - self.gram)
            out[more] = join(out[more], self.grams[at], np.uint64(step))
        return join(out, (end - start).astype(np.uint64), np.uint64(1 << 20))

    def windows(self, size: int) -> np.ndarray:
        """Names of all slices of one size, a gram's at least."""
        level, width = self.grams, self.gram
        while 2 * width <= size:
            level = join(level[: max(0, len(level) - width)], level[width:], np.uint64(width))
            width *= 2
        n = max(0, self.size - size + 1)
        return join(level[:n], level[size - width : size - width + n], np.uint64(size << 8))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of documents: hash, byte range, and the first word of each document.

    With ``fold``, A-Z count as a-z.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, fold: bool = False):
        base = offsets[0]
        raw, off = raw[base : offsets[-1]], offsets - base
        if fold:
            raw = LOWER[raw]
        n = len(raw)
        inside = ~SEPARATOR[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.hash = self.hashes(raw)
        self.first = np.searchsorted(self.start, off)
        self.raw = raw

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        long = np.flatnonzero(size > LONG_WORD)
        if not len(long):
            return Names(LETTERS[raw], int(size.max())).of(self.start, self.end)
        short = np.flatnonzero(size <= LONG_WORD)
        out = np.empty(len(size), np.uint64)
        if len(short):
            out[short] = Names(LETTERS[raw], int(size[short].max())).of(self.start[short], self.end[short])
        out[long] = [int.from_bytes(hashlib.blake2b(raw[s:e].tobytes(), digest_size=8).digest(), "little") for s, e in zip(self.start[long].tolist(), self.end[long].tolist())]
        return out


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` consecutive grams, the place of its leftmost smallest one.

    Grams compare by their upper 34 bits, then by place, so equal runs choose the same relative place. There may be 2**30
    grams at most.
    """
    if len(grams) > 1 << 30:
        raise ValueError("a text of more than 2**30 units")
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low_bits = np.uint64((1 << 30) - 1)
    key = (grams & ~low_bits) | np.arange(len(grams), dtype=np.uint64)
    # the least of runs twice as long, until two of them make up a run
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    return (np.minimum(key[:n], key[width - size : width - size + n]) & low_bits).astype(np.int64)
