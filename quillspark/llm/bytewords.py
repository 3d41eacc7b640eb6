"""Vectorised word handling on the UTF-8 bytes of whole Arrow string columns.

All separators used by the operators are ASCII, so splitting on bytes equals splitting on code points. Words are
identified by 64-bit hashes computed with one prefix sum per block of documents, never by one Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + _U(seed)) | _U(1)


with np.errstate(over="ignore"):
    _BYTE_VALUE = _mix(np.arange(256, dtype=np.uint64) + _U(77))
    _INVERSE = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BASE = _U(0xD6E8FEB86659FD93)
_powers = {"n": 0, "p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; tables beyond 4 blocks are not kept."""
    if _powers["n"] >= n:
        return _powers["p"], _powers["q"]
    size = max(n, BLOCK_BYTES + 1)
    with np.errstate(over="ignore"):
        p = np.full(size, _BASE)
        q = np.full(size, _INVERSE)
        p[0] = q[0] = 1
        p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
    if size <= 4 * BLOCK_BYTES:
        _powers.update(n=size, p=p, q=q)
    return p, q


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: True for the bytes inside any of the inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: ASCII white space.
SPACE = separators((0x09, 0x0D), (0x20, 0x20))
#: Every ASCII byte that is neither a digit nor a lower-case letter, once A-Z are lowered.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers, n = column.buffers(), len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of at most so many bytes, or of one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


class Words:
    """The words of a block of documents: 64-bit hash, place and document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, a: int, b: int, separator: np.ndarray):
        base = int(offsets[a])
        raw = data[base : int(offsets[b])]
        self.starts_of_docs = (offsets[a : b + 1] - base).astype(np.int64)
        n = len(raw)
        low = LOWER[raw]
        inside = ~separator[low]
        edge = np.zeros(n + 1, bool)
        edge[self.starts_of_docs] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = ~inside[:-1]
        start = inside & (before | edge[:n])
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            after[:-1] = ~inside[1:]
        end = inside & (after | edge[1:])
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.low = low
        with np.errstate(over="ignore"):
            p, q = _power_tables(n + 1)
            sums = np.cumsum(_BYTE_VALUE[low] * p[:n], dtype=np.uint64)
            before_sum = np.where(self.start > 0, sums[self.start - 1], _U(0)) if n else sums
            h = (sums[self.end - 1] - before_sum) * q[self.start] if n else sums
            self.hash = _mix(h ^ ((self.end - self.start).astype(np.uint64) * _ODD))
        #: First word of each document, and the end of the last.
        self.first = np.searchsorted(self.start, self.starts_of_docs)

    def text(self, k: int) -> bytes:
        return self.low[self.start[k] : self.end[k]].tobytes()


def hash_words(words: list[str], separator: np.ndarray) -> np.ndarray:
    """Hashes of single words, one each, as Words gives them."""
    data, offsets = column_bytes(pa.array(words, pa.string()))
    out = Words(data, offsets, 0, len(words), separator)
    if len(out.hash) != len(words):
        raise ValueError(f"not single words: {words}")
    return out.hash


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of `size` words, sorted; of all words as one run if there are fewer; empty without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    with np.errstate(over="ignore"):
        multipliers = seeds(size + 1, 9)
        total = np.full(len(words) - k + 1, _U(k) * multipliers[size])
        for i in range(k):
            total += words[i : len(words) - k + 1 + i] * multipliers[i]
        return np.unique(_mix(total))
