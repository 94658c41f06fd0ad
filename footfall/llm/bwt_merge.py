"""Burrows-Wheeler transforms of shards of aligned strings, and their merge by interleave refinement.

The strings are contexts of one anchor each: byte ``c`` of a string stands ``c`` places from the left of a common frame,
and a string fills the columns ``begin`` to ``end`` of it. Strings belong to groups; suffixes are ordered by group first.

A shard's transform is, for each column from right to left, the bytes that stand before the sorted suffixes of the column
to the right. ``merge`` never sorts suffixes anew: it keeps an interleave, the shard of each suffix in merged order, and
refines it column by column with a stable sort by the next byte of each shard's transform. The longest common prefix of
neighbours follows: 1 + the least one between the two in the order before, if the bytes are equal, else 0. Intervals of
suffixes with a common prefix of ``length`` bytes or more are the repeats.
"""

from __future__ import annotations

import numpy as np


def _stable_order(group: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Stable order by (group, symbol); both are 16-bit, which numpy sorts by radix."""
    by_symbol = np.argsort(symbol, kind="stable")
    return by_symbol[np.argsort(group[by_symbol], kind="stable")]


class Shard:
    """The transform of some strings: ``columns[c]`` are 1 + the byte before each suffix of column c + 1, in order, and 0
    where a string has none there; ``orders[c]`` are the strings of the sorted suffixes of the columns below ``keep``."""

    def __init__(self, group: np.ndarray, frame: np.ndarray, keep: int):
        width, n = frame.shape
        self.group = np.sort(group, kind="stable")
        order = np.argsort(group, kind="stable")
        self.columns = np.empty((width, n), np.uint16)
        self.orders = np.empty((keep, n), np.uint16)
        for c in range(width - 1, -1, -1):
            symbol = frame[c][order]
            self.columns[c] = symbol
            order = order[_stable_order(group[order], symbol)]
            if c < keep:
                self.orders[c] = order


def _range_least(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least lcp[low + 1 ... high] of each pair, by doubling."""
    out = lcp[high].copy()
    gap = high - low
    wide = np.flatnonzero(gap > 1)
    if not len(wide):
        return out
    level, table = 0, lcp
    most = int(gap[wide].max())
    bits = np.frexp(gap[wide].astype(float))[1] - 1
    while True:
        at = wide[bits == level]
        if len(at):
            out[at] = np.minimum(table[low[at] + 1], table[high[at] - (1 << level) + 1])
        if 2 << level > most:
            return out
        step = 1 << level
        table = np.minimum(table[:-step], table[step:])
        level += 1


def merge(shards: list[Shard], length: int) -> list[np.ndarray]:
    """For each shard, a keep x n array: does the suffix of that column and string share ``length`` bytes with another?"""
    width, keep = len(shards[0].columns), len(shards[0].orders)
    found = [np.zeros(s.orders.shape, bool) for s in shards]
    group = np.concatenate([s.group for s in shards])
    z = np.concatenate([np.full(len(s.group), i, np.uint16) for i, s in enumerate(shards)])
    start = np.argsort(group, kind="stable")
    group, z = group[start], z[start]
    n = len(z)
    lcp = np.zeros(n, np.int32)
    symbol = np.empty(n, np.uint16)
    for c in range(width - 1, -1, -1):
        places = np.argsort(z, kind="stable")  # the merged places of each shard's suffixes, shard by shard
        symbol[places] = np.concatenate([s.columns[c] for s in shards])
        order = _stable_order(group, symbol)
        low, high = order[:-1], order[1:]
        new = np.zeros(n, np.int32)
        alike = np.flatnonzero((symbol[low] == symbol[high]) & (group[low] == group[high]) & (symbol[high] > 0))
        new[alike + 1] = 1 + _range_least(lcp, low[alike], high[alike])
        lcp, z, group = new, z[order], group[order]
        if c < keep:
            repeat = lcp >= length
            repeat[:-1] |= repeat[1:]
            places = np.argsort(z, kind="stable")
            at = 0
            for s, hit in zip(shards, found, strict=True):
                n_s = len(s.group)
                hit[c, s.orders[c]] = repeat[places[at : at + n_s]]
                at += n_s
    return found
