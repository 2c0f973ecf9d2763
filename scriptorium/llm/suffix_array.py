"""A suffix array by linear grouping construction, for one bounded sequence.

Suffixes are first put in groups by their Lyndon prefixes. Groups are processed
in descending order: every suffix of a group points to the nearest earlier
suffix in a smaller group, and the suffixes pointed to move to new groups right
above their old ones, those pointed to more often higher. In the second phase
each placed suffix places the one before it, and what that one points to, at
the front of their groups. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value

# Executors need not have this package on their path.
register_pickle_by_value(sys.modules[__name__])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of integers; a shorter suffix sorts before a longer one it begins."""
    n = len(symbols) + 1
    ranks = np.concatenate((np.unique(symbols, return_inverse=True)[1] + 1, [0])) if n > 1 else np.zeros(1, np.int64)
    order = np.argsort(ranks, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(ranks))[:-1]))
    group = first[ranks].tolist()  # the place where a suffix's group starts
    size = np.bincount(first[ranks], minlength=n).tolist()
    slots = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    smaller = [-1] * n

    end = n
    while end > 1:
        start = group[slots[end - 1]]
        members = slots[start:end]
        members.sort()
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            moves: dict[tuple[int, int], list[int]] = {}
            for j, k in times.items():
                moves.setdefault((-k, group[j]), []).append(j)
            for (_, old), chosen in sorted(moves.items()) if len(moves) > 1 else moves.items():
                left = size[old] - len(chosen)
                if not left:
                    continue
                # To the end of the old group's interval, which becomes theirs.
                new = old + left
                at = old + size[old]
                for j in chosen:
                    at -= 1
                    here, other = place[j], slots[at]
                    # Chosen ones already at the end stay; swapping keeps both intervals filled.
                    slots[here], slots[at] = other, j
                    place[other], place[j] = here, at
                    group[j] = new
                size[old], size[new] = left, len(chosen)
        end = start

    result = [-1] * n
    filled = [0] * n
    result[0] = n - 1
    placed = [False] * n
    placed[n - 1] = True
    for i in range(n):
        j = result[i] - 1
        while j >= 0 and not placed[j]:
            start = group[j]
            result[start + filled[start]] = j
            filled[start] += 1
            placed[j] = True
            j = smaller[j]
    return np.array(result[1:], np.int64)
