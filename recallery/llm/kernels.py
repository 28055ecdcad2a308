"""Numpy kernels over Arrow text columns: words, word hashes and shingles of a whole
batch at once. UTF-8 bytes are enough, since all separators here are ASCII."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text a kernel works on at a time (a single longer text is one piece).
PIECE = 1 << 18

_rng = np.random.default_rng(20240229)
_MUL = U(0x9E3779B97F4A7C15)
_ODD = _rng.integers(1, 2**63, 128, dtype=np.int64).astype(U) | U(1)
#: The first bytes of a block of eight.
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: Words of more bytes are hashed one by one.
LONG = 512

#: True for bytes of plain words: all but space and 9 to 13.
PLAIN = np.ones(256, bool)
PLAIN[[32, *range(9, 14)]] = False
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tidy(run):
    """A function over batches that gives the memory of its work back when a task ends: worker
    processes live on, and what they keep counts against the next task."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Return free memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U(32))) * _MUL
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row's begin (one more for the end). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        column = column.fill_null("")
        return texts(column)
    return bytes_, at


def pieces(at: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes together, or a single longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(data: np.ndarray, at: np.ndarray, word: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each word; ``at`` counts from 0 in ``data``."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    w = word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edge = at[:-1]
    edge = edge[edge < n]
    first[edge] = w[edge]
    edge = edge[edge > 0] - 1
    last[edge] = w[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(at, start, "right") - 1, start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, alike wherever the word stands. Blocks of eight bytes are
    chained by bijections, so words of one length that differ in one block never collide, and others do by
    chance only. Each seed gives an independent hash."""
    size = end - start
    h = mix(size.astype(U) + _ODD[64 + seed])
    view = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    live = np.flatnonzero(size <= LONG)
    at, left = start[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (view[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")
    return h


def same_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, to: np.ndarray) -> bool:
    """Whether each word has the bytes of the word that begins at ``to``, of equal size."""
    view = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    other = np.flatnonzero(start != to)
    start, size, to = start[other], size[other], to[other]
    while len(start):
        if ((view[start] ^ view[to]) & _MASK[np.minimum(size, 8)]).any():
            return False
        more = size > 8
        start, size, to = start[more] + 8, size[more] - 8, to[more] + 8
    return True


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for words of equal bytes only: hashes propose, the bytes decide."""
    _, first, number = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    size = end - start
    if (size == size[first][number]).all() and same_words(data, start, size, start[first][number]):
        return number
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start, end, strict=True)])


def windows(h: np.ndarray, row: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each k consecutive words of one row: the index of the first, and a hash of all."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    odd = _ODD[32 * seed :]
    total = h[:n] * odd[0]
    for j in range(1, k):
        total += h[j : n + j] * odd[j]
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, mix(total[at] + U(k))


def hashed(column: pa.Array, fold: bool = False, word: np.ndarray = PLAIN, most: int = PIECE):
    """For each piece of a text column: first row, number of rows, and row (from 0 in the
    piece), start, end and hash of each word, with the piece's bytes."""
    data, at = texts(column)
    for i, j in pieces(at, most):
        part = data[at[i] : at[j]]
        part = LOWER[part] if fold else part
        row, start, end = split(part, at[i : j + 1] - at[i], word)
        yield i, j - i, row, start, end, word_hashes(part, start, end), part


def _shingles(h: np.ndarray, row: np.ndarray, n: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle; a row of fewer than k words has one, all its words."""
    at, s = windows(h, row, k, seed)
    r = row[at]
    counts = np.bincount(row, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.searchsorted(row, short)
        size = counts[short]
        total = np.zeros(len(short), U)
        for j in range(k - 1):
            inside = size > j
            total[inside] += h[begin[inside] + j] * _ODD[32 * seed + j]
        r, s = np.concatenate([r, short]), np.concatenate([s, mix(total + size.astype(U))])
    return r, s


def shingle_sets(column: pa.Array, k: int = 5, fold: bool = True, seeds: int = 1):
    """For each piece: first row, number of rows, and the distinct shingles of each row as
    (row, hash), sorted by both, with further independent hashes as ``seeds`` asks for."""
    for first, n, row, start, end, h, part in hashed(column, fold):
        r, s = _shingles(h, row, n, k, 0)
        more = [_shingles(word_hashes(part, start, end, seed), row, n, k, seed)[1] for seed in range(1, seeds)]
        order = np.lexsort((s, r))
        r, s = r[order], s[order]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        yield first, n, r[keep], s[keep], *(x[order][keep] for x in more)
