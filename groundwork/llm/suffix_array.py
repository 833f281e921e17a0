"""Suffix array by linear grouping: suffixes are grouped by their Lyndon prefix, without recursion.

Phase 1 starts with the groups of equal first symbols and processes groups from the highest
to the lowest. A suffix's previous-smaller pointer leads to the nearest suffix to its left in
a lower group; while a group is processed, the suffixes that its members point to are moved
behind their old group, those pointed to most often furthest, which lengthens their common
prefix by the processed group's. In the end a group holds the suffixes of one Lyndon prefix.

Phase 2 goes through the order from its start: the suffix placed at rank i fixes the place of
every suffix whose next smaller suffix it is - they hang on its left neighbour's chain of
pointers - at the front of what is free in their groups.

Large groups are handled by array operations, small ones element by element.
"""

from __future__ import annotations

import numpy as np

#: Groups of up to so many suffixes are handled one by one.
SMALL = 48


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The ranks' suffixes of a sequence of whole numbers (a shorter suffix before its extensions)."""
    n = len(symbols) + 1  # the empty suffix is the smallest of all
    if n == 1:
        return np.empty(0, np.int64)
    text = np.zeros(n, np.int64)
    text[:-1] = np.asarray(symbols, np.int64) + 1 - int(symbols.min())
    order = np.argsort(text, kind="stable").astype(np.int32)
    first = np.flatnonzero(np.diff(text[order], prepend=-1))
    size = np.zeros(n, np.int32)
    size[first] = np.diff(np.append(first, n))
    group = np.empty(n, np.int32)
    group[order] = np.repeat(first, size[first])
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    prev = np.arange(-1, n - 1, dtype=np.int32)
    _group(order, place, group, size, prev)
    return _place(order, group, prev)[1:]


def _group(order: np.ndarray, place: np.ndarray, group: np.ndarray, size: np.ndarray, prev: np.ndarray) -> None:
    """Phase 1, in place. order: suffixes by group; place: its inverse; group: where a suffix's group starts; size: by start."""
    o, at, gr, sz, pv = (memoryview(x) for x in (order, place, group, size, prev))
    end = len(order)
    while end > 1:
        start = gr[o[end - 1]]
        if end - start > SMALL:
            _large(order, place, group, size, prev, start, end)
            end = start
            continue
        pointed: dict[int, int] = {}
        # Rising positions: the pointer of an earlier member of the group is already final.
        for s in sorted(o[start:end]) if end - start > 1 else (o[start],):
            p = s - 1
            while p >= 0 and gr[p] >= start:
                p = pv[p]
            pv[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = start
        if len(pointed) == 1:
            parents = [pointed]
        else:
            by_count: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by_count.setdefault(k, []).append(p)
            parents = [by_count[k] for k in sorted(by_count, reverse=True)]
        for moved in parents:
            # Members of one group go, together, to its end; those that go later go before them.
            taken: dict[int, int] = {}
            for p in moved:
                g = gr[p]
                k = taken.get(g, 0) + 1
                taken[g] = k
                a, b = at[p], g + sz[g] - k
                q = o[b]
                o[a], o[b] = q, p
                at[q], at[p] = a, b
            for g, k in taken.items():
                new = g + sz[g] - k
                sz[g] -= k
                sz[new] = k
                for b in range(new, new + k):
                    gr[o[b]] = new


def _large(order: np.ndarray, place: np.ndarray, group: np.ndarray, size: np.ndarray, prev: np.ndarray, start: int, end: int) -> None:
    members = order[start:end].copy()
    p = members - 1
    prev[members] = p
    open_ = np.flatnonzero((p >= 0) & (group[p] >= start))
    while len(open_):
        step = prev[p[open_]]
        p[open_] = step
        prev[members[open_]] = step
        open_ = open_[(step >= 0) & (group[step] >= start)]
    parents, counts = np.unique(p[p >= 0], return_counts=True)
    for k in np.unique(counts)[::-1]:
        moved = parents[counts == k]
        g = group[moved]
        by_group = np.argsort(g, kind="stable")
        moved, g = moved[by_group], g[by_group]
        starts = np.flatnonzero(np.diff(g, prepend=-1))
        old, taken = g[starts], np.diff(np.append(starts, len(g)))
        new = old + size[old] - taken
        # The last places of each group, and who stands there; who stays changes places with who goes.
        back = np.repeat(new, taken) + np.arange(len(g)) - np.repeat(starts, taken)
        there = order[back]
        going = np.zeros(0, np.int64)
        inside = place[moved] >= np.repeat(new, taken)
        going = moved[~inside]
        stays = ~np.isin(there, moved, assume_unique=True)
        staying, free, to = there[stays], place[going].copy(), back[stays]
        order[to], order[free] = going, staying
        place[going], place[staying] = to, free
        size[old] -= taken.astype(size.dtype)
        size[new] = taken
        group[moved] = np.repeat(new, taken)


def _place(order: np.ndarray, group: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """Phase 2: the suffixes by rank. group: the next free place of each group's start."""
    n = len(order)
    gr, pv = group.tolist(), prev.tolist()
    free = list(range(n))
    out = [0] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = gr[s]
            k = free[g]
            out[k] = s
            free[g] = k + 1
            placed[s] = 1
            s = pv[s]
    return np.array(out, np.int64)


def equal_windows(symbols: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """Class of each of the windows of `length` symbols at `starts` (rising): equal windows, equal number.

    They stand side by side in the suffix array; a class is a run of neighbours that agree in
    all symbols of the window.
    """
    order = suffix_array(symbols)
    known = np.zeros(len(symbols), bool)
    known[starts] = True
    order = order[known[order]]
    view = np.lib.stride_tricks.sliding_window_view(symbols, length)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 20_000):
        b = min(len(order), a + 20_000)
        new[a:b] = (view[order[a:b]] != view[order[a - 1 : b - 1]]).any(axis=1)
    number = np.empty(len(symbols), np.int64)
    number[order] = np.cumsum(new)
    return number[starts]
