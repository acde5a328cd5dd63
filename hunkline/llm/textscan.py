"""Vectorised word scanning over the UTF-8 buffers of Arrow string columns.

Tasks read text as Arrow batches. A batch of strings is one contiguous byte
buffer plus offsets, so word boundaries and 64-bit word hashes are computed
for all its texts at once with numpy, without a Python loop over words.

Word hash: a polynomial over randomly mapped bytes modulo 2**64, taken from a
prefix sum (difference of two prefix values times an inverse power), then
mixed with the word's length. It depends on the word alone, so every worker
computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

#: bytes of text handled in one vectorised step (whole texts; one longer text
#: is a step of its own)
CHUNK_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multiplications)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, U64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = self._table(_BASE, size), self._table(_INV, size)
        return self.up, self.down


_POWERS = _Powers()
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def byte_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: word bytes when words are split at ASCII white space: all but 09-0D and 20
NOT_SPACE = ~byte_table(b"\t\n\v\f\r ")
#: word bytes of alphanumeric words: 0-9, a-z and everything from 0x80
ALNUM = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))
#: bytes of letter words: a-z (texts are lower-cased first) and everything from 0x80
LETTERS = byte_table(b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))
#: lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """Words of consecutive texts: starts and ends in the byte buffer, 64-bit
    hashes, and the first word of each text (``first`` has one entry more)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = table[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = _POWERS.upto(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUES[data] * up[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * down[self.starts]
        self.hashes = mix64(h + (self.ends - self.starts).astype(U64) * U64(0xA24BAED4963EE407))

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """The text (row) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def scan(column: pa.Array, table: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over a string column, A-Z lower-cased."""
    data, offsets = buffers(column)
    for a, b in steps(offsets, limit):
        part = LOWER[data[offsets[a]:offsets[b]]]
        yield a, b, Words(part, offsets[a:b + 1] - offsets[a], table)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive entries (crossing text borders too;
    callers select the positions that lie inside one text)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = np.full(count, U64(n))
    for i in range(n):
        out *= U64(0x9FB21C651E98DF25)
        out += hashes[i:i + count]
        out ^= out >> U64(29)
    return mix64(out)
