"""Inversions of many short sequences at once, by merging."""

from __future__ import annotations

import numpy as np


def inversions(groups: np.ndarray, values: np.ndarray) -> int:
    """Pairs of places i < j of one group with values[i] > values[j], summed over all groups, which stand one after another.

    Runs of 1, 2, 4, ... places of a group are merged in pairs; what a right
    run's value overtakes in the left one is found by a search in sorted
    numbers, so that the work is linear-logarithmic a level and all groups go together.
    """
    if len(values) < 2:
        return 0
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    first = np.searchsorted(groups, groups)
    place = np.arange(len(groups)) - first
    top = int(rank.max()) + 1
    total, width = 0, 1
    while width <= int(place.max()):
        run = first + place // (2 * width) * (2 * width)  # where the pair of runs of a place begins
        right = place // width % 2 == 1
        left_keys = np.sort(run[~right] * top + rank[~right])
        at = run[right]
        ends = np.searchsorted(left_keys, at * top + top)
        total += int((ends - np.searchsorted(left_keys, at * top + rank[right], "right")).sum())
        width *= 2
    return total


def same_pairs(*columns: np.ndarray) -> int:
    """Pairs of places that agree in all columns."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    n = np.diff(np.flatnonzero(np.concatenate([[True], new[1:], [True]]))) if len(order) else np.zeros(0, np.int64)
    return int((n * (n - 1) // 2).sum())
