"""Suffix arrays by linear grouping.

First, suffixes are grouped by their longest Lyndon prefix: groups start as those of equal first symbols and are handled
in descending order; each suffix points to the nearest one before it of a smaller group, and the suffixes pointed to
are split off behind their groups, by how many pointers they get. Then, suffixes are emitted in
ascending order: each emitted one places those whose Lyndon prefix ends where it begins, found along the same pointers, at
the front of their groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in ascending order; the last symbol must be smaller than all others."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(starts, n))
    size_of, group = np.zeros(n, np.int64), np.empty(n, np.int64)
    size_of[starts] = sizes
    group[order] = np.repeat(starts, sizes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sa, isa, link, size = order.tolist(), place.tolist(), group.tolist(), size_of.tolist()
    prev = [-1] * n

    end = n
    while end > 1:
        start = link[sa[end - 1]]
        if end - start == 1:
            i = sa[start]
            p = i - 1
            # position -1 is the last symbol's, in the smallest group
            while link[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = link[p]
                s = size[g] - 1
                if s:
                    size[g] = s
                    e = g + s
                    q = sa[e]
                    if q != p:
                        x = isa[p]
                        sa[x] = q
                        isa[q] = x
                        sa[e] = p
                        isa[p] = e
                    link[p] = e
                    size[e] = 1
        else:
            found = []
            for i in sorted(sa[start:end]):
                p = i - 1
                while link[p] >= start:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    found.append(p)
            counts = Counter(found)
            levels = {1: list(counts)}
            if len(counts) < len(found):
                levels = {}
                for p, k in counts.items():
                    levels.setdefault(k, []).append(p)
            for k in sorted(levels, reverse=True):
                for p in levels[k]:
                    g = link[p]
                    s = size[g] - 1
                    size[g] = s
                    e = g + s
                    q = sa[e]
                    if q != p:
                        x = isa[p]
                        sa[x] = q
                        isa[q] = x
                        sa[e] = p
                        isa[p] = e
                for p in levels[k]:
                    g = link[p]
                    e = g + size[g]
                    link[p] = e
                # counted after all links are set, so that a group that moved as a whole is counted anew
                for p in levels[k]:
                    size[link[p]] += 1
        end = start

    out, front, placed = [0] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = link[j]
            f = front[g]
            out[f] = j
            front[g] = f + 1
            j = prev[j]
    return np.array(out)
