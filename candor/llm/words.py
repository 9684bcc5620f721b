"""Words of whole Arrow text columns as numpy arrays, without a Python object for each word.

Texts are handled as UTF-8 bytes. All separators used here are ASCII, so that
a byte of 0x80 or more always belongs to a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
#: Bytes of words of the pattern [^\x20\x09-\x0D]+
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of words of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, once A-Z are lower case
ALNUM = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
#: A-Z to a-z
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a text column; null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    lo, hi = int(offs[0]), int(offs[-1])
    return (np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)), offs - lo


def cuts(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes, or one row that is longer."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def scan(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and each row's first word (one more than rows)."""
    n = len(data)
    mark = np.zeros(n + 2, np.int8)
    mark[1 : n + 1] = is_word[data]
    step = np.diff(mark)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offs[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    split = inner[(mark[inner] == 1) & (mark[inner + 1] == 1)]  # a word on either side of a row's end
    if len(split):
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit; changes h."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHash:
    """64-bit polynomial hashes of words: random codes of bytes, summed with powers of an odd number."""

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 2**64 - 1, 256, np.uint64)
        self.base = int(rng.integers(1, 2**61)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 18)
            for name, base in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, base & (2**64 - 1), np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        n = len(data)
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.multiply(self.codes[data], self.up[:n], out=total[1:])
        np.cumsum(total, out=total)
        h = (total[ends] - total[starts]) * self.down[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(h)


def hashed_words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, hasher: WordHash, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words, and each row's first word; works on about `most` bytes at once."""
    parts, counts = [], [np.zeros(1, np.int64)]
    for lo, hi in cuts(offs, most):
        d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        s, e, first = scan(d, o, is_word)
        parts.append(hasher(d, s, e))
        counts.append(np.diff(first))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(np.concatenate(counts))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Indices of words at which a window of `size` words of one row starts."""
    n = np.diff(first)
    row_end = np.repeat(first[1:], n)
    return np.flatnonzero(np.arange(first[-1]) + size <= row_end)


def window_hash(h: np.ndarray, starts: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of `size` consecutive word hashes from each start."""
    if len(starts) * 2 > len(h) >= size:
        acc = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            acc *= np.uint64(base)
            acc += h[k : len(h) - size + 1 + k]
        acc = acc[starts]
    else:
        acc = h[starts]
        for k in range(1, size):
            acc *= np.uint64(base)
            acc += h[starts + k]
    return mix(acc)
