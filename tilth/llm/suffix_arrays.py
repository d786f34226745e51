"""Suffix arrays of many short texts at once, by linear grouping.

All texts (lanes) lie one after the other in one array. Phase 1 sorts suffixes into groups of equal
longest Lyndon prefix: groups are processed from the highest down; each suffix finds its previous
smaller suffix by following earlier such pointers, and the suffixes pointed at move to new groups just
above their old one, by how many point at them. Phase 2 reads the suffixes in ascending order and
emits into each group, in order, the suffixes before the one read, along the pointers. Nothing is
ranked anew or sorted recursively. Each numpy step does one group, or one suffix, of every lane.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, lane by lane (lane i takes symbols[starts[i]:starts[i + 1]]).

    Each lane must end with its least symbol, which occurs in it once. The result has the length of
    symbols; the part of a lane holds absolute places, the closing symbol's first.
    """
    n = len(symbols)
    lanes = len(starts) - 1
    first = starts[:-1].astype(np.int64)
    lane = np.repeat(np.arange(lanes), np.diff(starts))
    # initial groups: by lane and symbol; a group is known by the place of its first member in sa
    order = np.argsort(lane * 512 + symbols, kind="stable")
    key = (lane * 512 + symbols)[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(new)
    sa = order
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(heads, np.diff(np.append(heads, n)))
    last = np.empty(n, np.int64)  # of a group, by its first place
    last[heads] = np.append(heads[1:], n) - 1
    prev = np.arange(n) - 1
    at = starts[1:].astype(np.int64) - 1  # where the highest group not yet done ends, by lane
    live = np.flatnonzero(at > first)
    marked = np.zeros(n, bool)
    while len(live):
        ends = at[live]
        begins = group[sa[ends]]
        sizes = ends - begins + 1
        whose = np.repeat(np.arange(len(live)), sizes)
        places = np.arange(len(whose)) - np.repeat(np.cumsum(sizes) - sizes - begins, sizes)
        members = sa[places]
        level = begins[whose]
        low = first[live][whose]
        # previous smaller suffix: step back while the group there is not lower than this one
        p = members - 1
        todo = np.flatnonzero((p >= low) & (group[p] >= level))
        while len(todo):
            p[todo] = prev[p[todo]]
            todo = todo[(p[todo] >= low[todo]) & (group[p[todo]] >= level[todo])]
        prev[members] = p
        p = p[p >= low]
        if len(p):
            p = np.sort(p)
            fresh = np.ones(len(p), bool)
            fresh[1:] = p[1:] != p[:-1]
            cut = np.flatnonzero(fresh)
            times = np.diff(np.append(cut, len(p)))
            p = p[cut]
            old = group[p]
            if len(p) > 1:
                by = np.lexsort((times, old))
                p, old, times = p[by], old[by], times[by]
            fresh = np.ones(len(p), bool)
            fresh[1:] = old[1:] != old[:-1]
            cut = np.flatnonzero(fresh)
            moved = np.diff(np.append(cut, len(p)))
            end = last[old]
            to = end - np.repeat(moved, moved) + 1 + np.arange(len(p)) - np.repeat(cut, moved)
            was = isa[p]
            # members of the old group's tail that do not move up take the places that become free
            marked[p] = True
            stay = sa[to]
            stay = stay[~marked[stay]]
            marked[p] = False
            marked[to] = True
            free = was[~marked[was]]
            marked[to] = False
            if len(stay):
                if len(cut) > 1:
                    free = free[np.argsort(group[sa[free]], kind="stable")]
                sa[free] = stay
                isa[stay] = free
            sa[to] = p
            isa[p] = to
            heads_old = old[cut]
            last[heads_old] = end[cut] - moved
            split = fresh.copy()
            split[1:] |= times[1:] != times[:-1]
            cut = np.flatnonzero(split)
            runs = np.diff(np.append(cut, len(p)))
            begin = to[cut]
            last[begin] = begin + runs - 1
            group[p] = np.repeat(begin, runs)
        at[live] = begins - 1
        live = live[at[live] > first[live]]
    # phase 2
    out = np.full(n, -1, np.int64)
    filled = np.zeros(n, np.int64)
    placed = np.zeros(n, bool)
    out[first] = starts[1:] - 1
    placed[starts[1:] - 1] = True
    length = np.diff(starts)
    by = np.argsort(-length, kind="stable")
    first_by, length_by = first[by], length[by]
    active = np.searchsorted(-length_by, -np.arange(int(length.max(initial=0))), side="left")
    for r in range(int(length.max(initial=0))):
        low = first_by[: active[r]]
        j = out[low + r] - 1
        go = (j >= low) & ~placed[j]
        while True:
            j, low = j[go], low[go]
            if not len(j):
                break
            g = group[j]
            out[g + filled[g]] = j
            filled[g] += 1
            placed[j] = True
            j = prev[j]
            go = (j >= low) & ~placed[j]
    return out
