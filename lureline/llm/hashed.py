"""Hashed byte-gram frequencies of whole texts, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITS = 12
ORDERS = (1, 2, 3)
SIZE = len(ORDERS) << BITS


def gram_ids(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: the slot of every gram that lies inside one text, and the first gram of each text.

    Grams of a text follow each other; the last entry of the second array is the number of grams.
    """
    code = np.zeros(len(body), np.uint32)
    lengths = np.diff(offsets)
    for k, order in enumerate(range(1, max(ORDERS) + 1)):
        usable = max(len(body) - order + 1, 0)
        code = code[:usable] * np.uint32(257) + body[order - 1:order - 1 + usable] + np.uint32(1)
        slots = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        inside = np.ones(usable, bool)
        for back in range(1, order):  # a gram that begins this close to its text's end reaches into the next
            at = offsets[1:] - back
            inside[at[(at >= 0) & (at < usable)]] = False
        grams = np.maximum(lengths - order + 1, 0)
        yield slots[inside].astype(np.int64) + (k << BITS), np.concatenate([[0], np.cumsum(grams)])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def linear_scores(body: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text and each row of ``weights``: the sum over slots of weight times frequency."""
    out = np.zeros((len(offsets) - 1, len(weights)))
    for slots, starts in gram_ids(body, offsets):
        count = np.maximum(np.diff(starts), 1)
        for j, row in enumerate(weights):
            out[:, j] += _sums(row[slots], starts) / count
    return out


def frequencies(body: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the used slots and their frequencies within the order."""
    parts: list[list] = [[] for _ in range(len(offsets) - 1)]
    for slots, starts in gram_ids(body, offsets):
        for i in range(len(offsets) - 1):
            own = slots[starts[i]:starts[i + 1]]
            if len(own):
                used, counts = np.unique(own, return_counts=True)
                parts[i].append((used, counts / len(own)))
    empty = (np.zeros(0, np.int64), np.zeros(0))
    return [tuple(np.concatenate(x) for x in zip(*p)) if p else empty for p in parts]
