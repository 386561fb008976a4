"""Suffix sorting by Lyndon groups, in linear construction without renaming.

First all suffixes are gathered in groups of one longest Lyndon prefix. Groups are handled in
descending order; each member points to the last earlier place of a smaller group, and the
places pointed to leave their group for a greater one, by how often they are pointed to. Then
the groups' inner order follows from one pass over the growing suffix array.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def lyndon_groups(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """For every suffix the start of its group in the suffix array, and its pointer (-1: none)."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    new = np.append(True, sorted_symbols[1:] != sorted_symbols[:-1])
    starts = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    place, group = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    place[order], group[order] = np.arange(len(order)), starts
    size = np.bincount(starts, minlength=len(order)).tolist()
    order, place, group = order.tolist(), place.tolist(), group.tolist()
    pointer = [-1] * len(order)
    end = len(order) - 1
    while end >= 0:
        start = group[order[end]]
        if start == end:
            members: Sequence[int] = (order[end],)
        else:
            members = sorted(order[start : end + 1])
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            most = max(times.values())
            if most == 1:
                _promote(list(times), order, place, group, size)
            else:
                by: dict[int, list[int]] = {}
                for p, n in times.items():
                    by.setdefault(n, []).append(p)
                for n in sorted(by, reverse=True):
                    _promote(by[n], order, place, group, size)
        end = start - 1
    return group, pointer


def _promote(moved: list[int], order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Split ``moved`` off the upper ends of their groups."""
    for p in moved:
        g = group[p]
        size[g] -= 1
        last = g + size[g]
        other, at = order[last], place[p]
        order[at], place[other] = other, at
        order[last], place[p] = p, last
    fresh = {}
    for p in moved:
        g = group[p]
        if g not in fresh:
            fresh[g] = g + size[g]
    for start in fresh.values():
        size[start] = 0
    for p in moved:
        start = fresh[group[p]]
        group[p] = start
        size[start] += 1


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order. The last symbol must be less than all others."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    group, pointer = lyndon_groups(symbols)
    out, free, done = [0] * n, list(range(n)), [False] * n
    out[0], done[n - 1] = n - 1, True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = True
            p = pointer[p]
    return np.array(out)
