"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S suffixes are sorted by
the substrings between them, then by pairs, fours, ... of the names of these substrings until all names differ; the
order of all other suffixes is induced from theirs in two scans over the buckets. The scans place a wave of suffixes at
a time: a bucket's own suffixes wait for each other only inside runs of one letter.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; the last one counts as smaller."""
    step = np.sign(np.diff(t.astype(np.int32)))
    at = np.arange(len(step))
    turn = np.where(step != 0, at, len(step))
    turn = np.minimum.accumulate(turn[::-1])[::-1]  # next place where the letter changes
    return np.r_[np.r_[step, 1][turn] > 0, True]


def induced(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in the order that the leftmost S suffixes `seeds`, in their order, give them."""
    n = len(t)
    sizes = np.bincount(t, minlength=letters)
    tail = np.cumsum(sizes)
    head = tail - sizes
    larges = np.bincount(t[~small], minlength=letters)
    sa = np.full(n, -1, np.int64)
    seed_of = np.searchsorted(t[seeds], np.arange(letters + 1))  # seeds are ordered by their first letter
    fill = head.copy()

    def place(found: np.ndarray, up: bool) -> None:
        c = t[found]
        order = np.argsort(c, kind="stable")
        found, c = found[order], c[order]
        count = np.bincount(c, minlength=letters)
        rank = np.arange(len(c)) - (np.cumsum(count) - count)[c]
        if up:
            sa[fill[c] + rank] = found
            fill[:] += count
        else:
            sa[fill[c] - 1 - rank] = found
            fill[:] -= count

    for c in np.flatnonzero(sizes):
        at = head[c]
        while at < fill[c]:
            wave = sa[at : fill[c]] - 1
            at = fill[c]
            wave = wave[wave >= 0]
            place(wave[~small[wave]], True)
        wave = seeds[seed_of[c] : seed_of[c + 1]] - 1
        wave = wave[wave >= 0]
        if len(wave):
            place(wave[~small[wave]], True)
    fill = tail.copy()
    if small[n - 1]:
        fill[t[n - 1]] -= 1  # the last suffix is the least of its bucket's S suffixes and is put last
    for c in np.flatnonzero(sizes)[::-1]:
        at, last = tail[c], n - 1 if t[n - 1] == c else -1
        while at > fill[c]:
            wave = sa[fill[c] : at][::-1] - 1
            at = fill[c]
            wave = wave[wave >= 0]
            place(wave[small[wave]], False)
        if last >= 0:
            sa[head[c] + larges[c]] = last
            if last and small[last - 1]:
                place(np.array([last - 1]), False)
        wave = sa[head[c] : head[c] + larges[c]][::-1] - 1
        wave = wave[wave >= 0]
        place(wave[small[wave]], False)
    return sa


def named(t: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each seed, in the given order, to its end; equal substrings have equal ranks."""
    size = ends - seeds
    new = np.r_[True, size[1:] != size[:-1]]
    pair = np.flatnonzero(~new)
    at = 0
    while len(pair):
        differ = t[seeds[pair] + at] != t[seeds[pair - 1] + at]
        new[pair[differ]] = True
        at += 1
        pair = pair[~differ]
        pair = pair[size[pair] >= at]
    return np.cumsum(new) - 1


def suffix_array(t: np.ndarray, letters: int) -> np.ndarray:
    """The suffixes of `t`, whose last letter is its only 0, in order; letters of 16 bits are placed fastest."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    small = classify(t)
    seeds = np.flatnonzero(small & np.r_[False, ~small[:-1]])
    if len(seeds) < 2:
        return induced(t, small, seeds, letters)
    ends = np.r_[seeds[1:], len(t) - 1]
    first = seeds[np.argsort(t[seeds], kind="stable")]
    rough = induced(t, small, first, letters)
    number = np.full(len(t), -1, np.int64)
    number[seeds] = np.arange(len(seeds))
    order = number[rough]
    order = order[order >= 0]
    name = np.empty(len(seeds), np.int64)
    name[order] = named(t, seeds[order], ends[order])
    reach = 1
    while name.max() < len(seeds) - 1:
        pair = (name + 1) * (len(seeds) + 2)
        pair[:-reach] += name[reach:] + 1
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        name[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        reach *= 2
    return induced(t, small, seeds[np.argsort(name, kind="stable")], letters)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix, in the order of the text, the length that it has in common with the one before it in `sa`.

    Only where the letters before the two differ are they compared; elsewhere the value is one less than its left
    neighbour's.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    known = (before >= 0) & (i > 0) & (before > 0)
    fresh = np.flatnonzero(~known | (t[i - 1] != t[np.maximum(before - 1, 0)]))
    length = np.zeros(len(fresh), np.int64)
    alive = np.flatnonzero(before[fresh] >= 0)
    while len(alive):
        a, b = fresh[alive] + length[alive], before[fresh[alive]] + length[alive]
        same = np.maximum(a, b) < n
        alive, a, b = alive[same], a[same], b[same]
        same = t[a] == t[b]
        alive = alive[same]
        length[alive] += 1
    reach = np.zeros(n, np.int64)
    reach[fresh] = fresh + length
    return np.maximum(np.maximum.accumulate(reach) - i, 0)
