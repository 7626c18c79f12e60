"""Suffix arrays in linear time, by grouping suffixes by their longest Lyndon prefixes.

Groups start as the suffixes of one first symbol and are processed in descending order. When a group comes, each of its suffixes
points to the previous suffix of a lower group; a suffix to which ``l`` of them point has a Lyndon prefix that is longer by ``l``
times the group's own, so it moves to a new group just above its old one. Once all are processed, groups are in the order of their
Lyndon prefixes, and within a group the order is that of what follows the prefix: one scan of the suffix array, which places the
suffixes that end their prefix where it stands, fills it. No string is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np

NONE = -1


def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The group of each suffix, the groups in ascending order, the previous-smaller pointer of each suffix and the size of each group."""
    n = len(symbols)
    kinds = sorted(set(symbols))
    number = {c: k for k, c in enumerate(kinds)}
    group = [number[c] for c in symbols]
    members = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    above, below = [*range(1, len(kinds)), NONE], [*range(-1, len(kinds) - 1)]
    done = bytearray(n)  # the last suffix is never done, so a pointer of -1 ends a search as any lower suffix does
    previous = [NONE] * n
    at = len(kinds) - 1
    while at > 0:
        own = members[at]
        if len(own) != size[at]:
            own = [i for i in own if group[i] == at]
        if len(own) == 1:
            i = own[0]
            done[i] = 1
            j = i - 1
            while done[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                old = group[j]
                if size[old] > 1:  # else it is a group by itself already
                    new = len(members)
                    members.append([j])
                    group[j] = new
                    size[old] -= 1
                    size.append(1)
                    over = above[old]
                    above.append(over)
                    below.append(old)
                    above[old] = new
                    below[over] = new
        elif own:
            for i in own:
                done[i] = 1
            pointed, times, last = [], [], NONE
            for i in own:
                j = i - 1
                while done[j]:
                    j = previous[j]
                previous[i] = j
                if j == last:  # pointers of ascending suffixes ascend
                    if times:
                        times[-1] += 1
                else:
                    pointed.append(j)
                    times.append(1)
                    last = j
            for level in sorted(set(times), reverse=True):
                split = {}
                for j, t in zip(pointed, times, strict=True):
                    if t == level:
                        g = group[j]
                        if g in split:
                            split[g].append(j)
                        else:
                            split[g] = [j]
                for old, moved in split.items():
                    if len(moved) < size[old]:
                        new = len(members)
                        members.append(moved)
                        for j in moved:
                            group[j] = new
                        size[old] -= len(moved)
                        size.append(len(moved))
                        over = above[old]
                        above.append(over)
                        below.append(old)
                        above[old] = new
                        below[over] = new
        at = below[at]
    order, at = [], 0
    while at != NONE:
        if size[at]:
            order.append(at)
        at = above[at]
    return group, order, previous, size


def suffix_array(symbols: list[int]) -> np.ndarray:
    """The suffixes of ``symbols`` in order. The last symbol has to be the least and the only one of its kind."""
    n = len(symbols)
    group, order, previous, size = lyndon_groups(symbols)
    front = [0] * len(size)
    first = 0
    for g in order:
        front[g] = first
        first += size[g]
    out = [NONE] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while not placed[j]:
            placed[j] = 1
            g = group[j]
            f = front[g]
            out[f] = j
            front[g] = f + 1
            j = previous[j]
    return np.array(out, np.int64)
