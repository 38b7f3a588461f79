"""Vectorised text primitives over Arrow string arrays (numpy, no per-word Python).

All functions take whole texts.  Word boundaries and hashes are computed on the
UTF-8 bytes of a whole block of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of words [^\x20\x09-\x0D]+
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[list(SPACE)] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (A-Z count once lower-cased)
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[0x30:0x3A] = ALNUM_BYTES[0x61:0x7B] = ALNUM_BYTES[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 1 << 64)
_rng = np.random.default_rng(20240607)
#: A random odd number for each byte
BYTE_KEY = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_KEY_2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _M, np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, _M_INV, np.uint64)], dtype=np.uint64)
        return self.up, self.down


_POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit symbols, after one pass."""

    def __init__(self, symbols: np.ndarray) -> None:
        up, self.down = _POWERS.upto(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def windows(self, k: int) -> np.ndarray:
        """The hash of each stretch of k symbols."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.down[: n - k + 1] + np.uint64(k * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As one plain string array in which null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts after one another, and where each begins (one more at the end)."""
    n, wide = len(column), pa.types.is_large_string(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes of text (a longer text alone)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``; for each text, where its words begin (one more at the end)."""
    is_word = table[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = is_word[edge]
    last[edge - 1] = is_word[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of ``data``, in order and without overlap, as a string array."""
    lengths = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=to[1:])
    full = lengths > 0
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[full]] = 1
    edge[ends[full]] -= 1
    data = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(to), pa.py_buffer(data)])


def spread(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[i]-1 for each i, after one another."""
    total = int(counts.sum())
    heads = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(heads, counts)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    if len(x) < w:
        return x[:0]
    m, have = x, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(x) - w + 1], m[w - have : w - have + len(x) - w + 1])
    return m


def byte_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, how often it has each of the 256 bytes."""
    out = np.empty((len(at) - 1, 256), np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        out[i] = np.bincount(data[a:b], minlength=256)
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum over each stretch between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where a mask is set."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
