"""Word and byte kernels over Arrow text columns, in numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
#: One random 64-bit value per byte, and the base of the rolling polynomial (odd, so it has an inverse).
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INV = U(pow(int(BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
#: Bytes of words when punctuation separates too: ASCII letters and digits, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
_POWERS: dict[int, np.ndarray] = {}


def lean() -> None:
    """In a Python worker, before a task: Arrow and the C library give back what is free to the system."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def looked_up(table: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The entries of a table of 256 bytes (or booleans) for each byte; an index would be widened to 64 bits first."""
    return np.frombuffer(b.tobytes().translate(table.tobytes()), table.dtype)


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def slabs(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole rows of at most `most` bytes, or one longer row.

    A null reads as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and off[-1] else np.empty(0, np.uint8)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(off)[~valid] > 0).any():
            yield from slabs(pa.array([x.as_py() or b"" for x in column], pa.large_binary()), most)
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i], times the inverse base to the i, a hash of bytes i..j."""
    out = np.zeros(len(b) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[b] * powers(len(b), BASE), out=out[1:])
    return out


def words(b: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of `b`, never across rows, and for each row its first word's index (plus a last)."""
    w = np.zeros(len(b) + 2, bool)
    w[1:-1] = looked_up(is_word, b)
    begin = w[1:-1] & ~w[:-2]
    inner = off[1:-1][off[1:-1] < len(b)]
    begin[inner] = w[1:-1][inner]
    start = np.flatnonzero(begin)
    last = w[1:-1] & ~w[2:]
    cut = inner[inner > 0] - 1
    last[cut] = w[1:-1][cut]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(b: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of `b` after lower-casing A-Z, and the rows' first words."""
    low = looked_up(LOWER, b)
    start, end, first = words(low, off, is_word)
    if not len(start):
        return np.empty(0, U), first
    h = prefix_hash(low)
    with np.errstate(over="ignore"):
        return mix((h[end] - h[start]) * powers(len(b) + 1, BASE_INV)[start] + (end - start).astype(U)), first


_COEF = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; the caller leaves out those that cross rows."""
    if len(h) < k:
        return np.empty(0, U)
    m = len(h) - k + 1
    with np.errstate(over="ignore"):
        acc = h[:m] * _COEF[0]
        for j in range(1, k):
            acc += h[j : j + m] * _COEF[j]
        return mix(acc + U(k))


def row_shingles(h: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of all its words if it has fewer than k."""
    every = grams(h, k)
    with np.errstate(over="ignore"):
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo >= k:
                g = np.sort(every[lo : hi - k + 1])
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                yield g[keep]
            elif hi > lo:
                yield mix((h[lo:hi] * np.array(_COEF[: hi - lo], U)).sum(dtype=U, keepdims=True) + U(hi - lo))
            else:
                yield np.empty(0, U)
