"""Words, lines and their hashes over the bytes of a batch of texts, with numpy.

A word is a run of bytes other than ASCII white space (0x20, 0x09 to 0x0D), which in UTF-8 is the same as a run of such
code points. Hashes are 64 bits: a polynomial over random byte values, finished by a mixer.
"""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.cache
def _values() -> np.ndarray:
    return mix((np.arange(256, dtype=U64) + U64(1)) * U64(0xD1342543DE82EF95))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0, 1, ... n, modulo 2 ** 64; kept, and grown when needed."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        out = np.ones(1, U64)
        step = base
        while len(out) < size:
            out = np.concatenate([out, out * U64(step)])
            step = step * step % (1 << 64)
        _POWERS[base] = have = out
    return have


_CHUNK = 1 << 16


def powers_at(places: np.ndarray, base: int) -> np.ndarray:
    """base ** place, modulo 2 ** 64, from two short tables: no table as long as a text."""
    low = powers(_CHUNK, base)
    if not len(places) or int(places.max()) < _CHUNK:
        return low[places]
    high = powers(int(places.max()) // _CHUNK + 1, pow(base, _CHUNK, 1 << 64))
    return low[places & (_CHUNK - 1)] * high[places >> 16]


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Sums such that hash_of(sums, a, b) identifies raw[a:b]."""
    sums = np.zeros(len(raw) + 1, U64)
    low = powers(_CHUNK)[:_CHUNK]
    scale, step = 1, pow(_BASE, _CHUNK, 1 << 64)
    for start in range(0, len(raw), _CHUNK):
        part = raw[start : start + _CHUNK]
        own = sums[start + 1 : start + 1 + len(part)]
        np.cumsum(_values()[part] * (low[: len(part)] * U64(scale)), out=own)
        own += sums[start]
        scale = scale * step % (1 << 64)
    return sums


def hash_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers_at(starts, _INVERSE) + (ends - starts).astype(U64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[raw]


def word_bounds(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(row, start, end) of each word of the texts raw[starts[i]:ends[i]], in order."""
    word = ~_SPACE[raw]
    first = word.copy()
    last = word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = ends > starts
    heads, tails = starts[full], ends[full] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    begin = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    rows = np.flatnonzero(full)
    row = rows[np.searchsorted(heads, begin, side="right") - 1] if len(rows) else np.zeros(0, np.int64)
    return row, begin, end


def shingles(row: np.ndarray, word_hash: np.ndarray, k: int, n_rows: int):
    """(row, hash) of each row's distinct k-word shingles, sorted by row and hash.

    A row with 1 to k - 1 words has its whole sequence as one shingle; a row without words has none.
    """
    n = len(word_hash)
    count = np.bincount(row, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    out_row, out_hash = [], []
    for size in range(1, k + 1):
        if size < k:
            at = begin[count == size]
        else:
            at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
        acc = np.full(len(at), U64(size))
        for j in range(size):
            acc = mix(acc * U64(0x2545F4914F6CDD1D) + word_hash[at + j])
        out_row.append(row[at])
        out_hash.append(acc)
    rows, hashes = np.concatenate(out_row), np.concatenate(out_hash)
    order = np.argsort(rows, kind="stable")
    rows, hashes = rows[order], hashes[order]
    ends = np.cumsum(np.bincount(rows, minlength=n_rows)) if len(rows) else np.zeros(n_rows, np.int64)
    a = 0
    for b in ends:
        if b - a > 1:
            hashes[a:b].sort()
        a = b
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[fresh], hashes[fresh]


def per_row(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of flags over each text's bytes."""
    sums = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=sums[1:])
    return (sums[ends] - sums[starts]).astype(np.int64)
