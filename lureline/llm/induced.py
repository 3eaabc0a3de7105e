"""Suffix arrays by induced sorting, and permuted longest common prefixes, in vectorised numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S suffixes
of each run (LMS) are put in order, and all others follow from them in two linear scans. The scans go
bucket by bucket: what a bucket's suffixes induce is dealt out to its buckets in one step, and a bucket
that induces into itself is scanned again for what was added.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; equal neighbours take the class of the next different one. The last is S."""
    n = len(text)
    rising = text[:-1] < text[1:]
    places = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    change = np.minimum.accumulate(places[::-1])[::-1]  # n - 1 where no different letter follows
    kinds = np.ones(n, bool)
    kinds[:-1] = np.append(rising, False)[change]
    return kinds


class _Buckets:
    def __init__(self, text: np.ndarray, sigma: int) -> None:
        counts = np.bincount(text, minlength=sigma)
        self.sigma = sigma
        self.end = np.cumsum(counts)
        self.start = self.end - counts


def _deal(sa: np.ndarray, items: np.ndarray, letters: np.ndarray, pointer: np.ndarray, step: int) -> None:
    """Puts items at the pointers of their letters in the given order and moves the pointers by ``step`` each."""
    if len(items) == 1:
        c = letters[0]
        sa[pointer[c]] = items[0]
        pointer[c] += step
        return
    order = np.argsort(letters, kind="stable")
    letters = letters[order]
    counts = np.bincount(letters, minlength=len(pointer))
    rank = np.arange(len(items)) - (np.cumsum(counts) - counts)[letters]
    sa[pointer[letters] + step * rank] = items[order]
    pointer += step * counts


def induce(text: np.ndarray, kinds: np.ndarray, seeds: np.ndarray, buckets: _Buckets) -> np.ndarray:
    """Suffix array from LMS positions in ascending order (of their suffixes, or of nothing but the first letter)."""
    n = len(text)
    sa = np.zeros(n, np.int32)
    letters = text[seeds]
    order = np.argsort(letters, kind="stable")
    seeds = seeds[order]
    bounds = np.searchsorted(letters[order], np.arange(buckets.sigma + 1))
    present = np.flatnonzero(buckets.end > buckets.start)
    head = buckets.start.copy()

    def push(items: np.ndarray, small: bool, pointer: np.ndarray, step: int) -> None:
        before = items - 1
        before = before[(before >= 0) & (kinds[before] == small)]
        if len(before):
            _deal(sa, before, text[before], pointer, step)

    for c in present:
        done = buckets.start[c]
        while done < head[c]:
            stop = head[c]
            push(sa[done:stop], False, head, 1)
            done = stop
        if bounds[c] < bounds[c + 1]:
            push(seeds[bounds[c]:bounds[c + 1]], False, head, 1)
    tail = buckets.end - 1
    sa[tail[text[-1]]] = n - 1  # the last suffix is induced by none
    tail[text[-1]] -= 1
    for c in present[::-1]:
        done = buckets.end[c] - 1
        while done > tail[c]:
            stop = tail[c]
            push(sa[stop + 1:done + 1][::-1], True, tail, -1)
            done = stop
        if buckets.start[c] < head[c]:
            push(sa[buckets.start[c]:head[c]][::-1], True, tail, -1)
    return sa


def _names(text: np.ndarray, ordered: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks of LMS substrings that stand in ascending order; equal ones share a rank."""
    a, b = ordered[:-1], ordered[1:]
    equal = lengths[:-1] == lengths[1:]
    active = np.flatnonzero(equal)
    k = 0
    while len(active):
        same = text[a[active] + k] == text[b[active] + k]
        equal[active[~same]] = False
        active = active[same & (lengths[active] > k)]
        k += 1
    return np.concatenate([[0], np.cumsum(~equal)])


def _ranked(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string over a large alphabet: ranks are refined by doubling where they tie."""
    n = len(names)
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        values = rank[order]
        fresh = np.concatenate([[True], values[1:] != values[:-1]])
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = group  # the first place of its group
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        items = order[places]
        follow = np.where(items + width < n, rank[np.minimum(items + width, n - 1)] + 1, 0)
        resorted = np.argsort(group[places] * (n + 1) + follow)
        order[places] = items[resorted]
        key = follow[resorted]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (group[places][1:] != group[places][:-1])])
        rank[order[places]] = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
        width *= 2


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of letters below ``sigma``; the last letter must be 0 and occur only there."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    kinds = classify(text)
    lms = (np.flatnonzero(kinds[1:] & ~kinds[:-1]) + 1).astype(np.int32)
    buckets = _Buckets(text, sigma)
    rough = induce(text, kinds, lms, buckets)
    number = np.full(n, -1, np.int32)
    number[lms] = np.arange(len(lms))
    ordered = rough[number[rough] >= 0]
    lengths = np.diff(lms, append=lms[-1]).astype(np.int32)  # the sentinel's substring is itself
    names = _names(text, ordered, lengths[number[ordered]])
    if names[-1] + 1 < len(lms):  # the reduced string: names of LMS substrings in the order of the text
        reduced = np.zeros(len(lms), np.int64)
        reduced[number[ordered]] = names
        ordered = lms[_reduced_order(reduced, int(names[-1]) + 1)]
    return induce(text, kinds, ordered, buckets)


def _reduced_order(reduced: np.ndarray, sigma: int) -> np.ndarray:
    """Recursion while buckets are well filled; a string of rare letters is ranked directly."""
    return suffix_array(reduced, sigma) if sigma * 256 < len(reduced) else _ranked(reduced)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight letters from each place on, packed; letters must be below 256."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint8), np.zeros(16, np.uint8)])
    out = np.empty(n + 8, np.uint64)
    for k in range(8):
        part = padded[k:k + (n + 8 - k) // 8 * 8].view(np.uint64)
        out[k:k + 8 * len(part):8] = part[:len(out[k::8])]
    return out


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, limit: int, divider: int = -1) -> np.ndarray:
    """For each place the common prefix of its suffix and the one before it in the suffix array.

    Where the letters before both places agree, the value is one less than that of the place before;
    only the others, and the places after a ``divider`` letter, are compared, eight letters a step and
    up to ``limit`` letters. Values above the limit less the distance from such a place are cut.
    """
    n = len(text)
    before = np.zeros(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    alone = np.ones(n, bool)
    alone[1:] = (before[1:] <= 0) | (text[:-1] != text[np.maximum(before[1:] - 1, 0)]) | (text[:-1] == divider)
    heads = np.flatnonzero(alone & (before >= 0)).astype(np.int32)
    common = np.zeros(n, np.int32)
    words, active, k = _words(text), heads, 0
    while len(active) and k < limit:
        a, b = active + k, before[active] + k
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        stopped = differ != 0
        low = differ[stopped]
        low &= ~low + np.uint64(1)
        common[active[stopped]] = k + (np.bitwise_count(low - np.uint64(1)).astype(np.int32) >> 3)
        active = active[~stopped]
        k += 8
        common[active] = k
    start = np.maximum.accumulate(np.where(alone, np.arange(n, dtype=np.int32), 0))
    return np.maximum(common[start] - (np.arange(n, dtype=np.int32) - start), 0)
