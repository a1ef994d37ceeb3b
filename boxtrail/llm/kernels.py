"""Vectorised helpers on one Arrow column of texts, used inside tasks.

A column of texts is one array of bytes with offsets; words, shingles and n-byte strings of all texts
are then hashed together, without a loop over texts or words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: An odd base for polynomial hashes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets, one more than texts) of a string or binary array without nulls."""
    wide = column.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64), on a copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(1, n), U)
    done, step = 1, base
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * U(step)
        done, step = done + k, step * step % (1 << 64)
    return out[:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit content hash of each data[start:end]; equal strings hash equally wherever they stand."""
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in order, offsets of each text's words).

    Words are runs of bytes other than the six ASCII blanks; A-Z are lower-cased if asked.
    """
    raw, offsets = text_bytes(column)
    data = _LOWER[raw] if lower else raw
    full = ~_BLANK[raw]
    before = np.r_[False, full[:-1]]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    begins = full & ~before
    starts = np.flatnonzero(begins)
    after = np.r_[full[1:], False]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(full & ~after) + 1
    hashes = np.empty(len(starts), U)
    for at in range(0, len(starts), 1 << 16):  # in pieces that fit in cache
        s, e = starts[at : at + (1 << 16)], ends[at : at + (1 << 16)]
        hashes[at : at + len(s)] = spans_hash(data[s[0] : e[-1]], s - s[0], e - s[0])
    return hashes, np.searchsorted(starts, offsets)


def shingles(word: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``size`` words, offsets per text); a shorter text with words is one shingle."""
    count = np.diff(offsets)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(count)), n)
    at = offsets[:-1][text] + np.arange(out[-1]) - out[:-1][text]
    h = np.full(len(at), len(at) and 0x51ED270B, U)
    for k in range(size):
        there = at + k < offsets[1:][text]
        h = np.where(there, mix(h * U(3) + word[np.minimum(at + k, max(0, len(word) - 1))] if len(word) else h), h)
    return h, out


#: Rows and bytes of the texts that are hashed at once: arrays of words and shingles take some 25 times the bytes.
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 1 << 20


def stretches(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in consecutive slices of at most ROWS_AT_ONCE rows and BYTES_AT_ONCE bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right"))), at + ROWS_AT_ONCE)
        yield column.slice(at, to - at)
        at = to


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text of a column without nulls."""
    sets = []
    for some in stretches(column):
        h, begins = shingles(*words(some), size)
        sets += [np.unique(h[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    return sets
