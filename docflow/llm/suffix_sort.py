"""Suffix array by Lyndon groups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np


def suffix_array(data: Sequence[int] | bytes) -> list[int]:
    """Order of all suffixes of ``data``; a shorter one is smaller than its extension.

    Suffixes start in groups by first symbol and end in groups by Lyndon
    prefix. Groups are processed in descending order: the nearest earlier
    suffix of a lower group, the previous smaller one, is recorded for every
    member, and the suffixes so pointed at move to a group of their own behind
    the rest of theirs, the more pointers the higher. Then one ascending pass
    puts each suffix at the next place of its group, following the recorded
    pointers; nothing is renamed or sorted anew.
    """
    symbols = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 1 if isinstance(data, bytes) else np.asarray(data, np.int64) + 1, [0]])
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]])
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    group_at = np.empty(n, np.int64)
    group_at[order] = begin
    place_at = np.empty(n, np.int64)
    place_at[order] = np.arange(n)
    members, place, group = order.tolist(), place_at.tolist(), group_at.tolist()
    # Number of members by the place where a group begins.
    count = np.bincount(begin, minlength=n).tolist()
    smaller = [-1] * n

    end = n - 1
    while end >= 0:
        start = group[members[end]]
        if start == end:
            # Most groups have one member.
            s = members[end]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                size = count[g]
                if size > 1:
                    last = g + size - 1
                    other, at = members[last], place[p]
                    members[at], place[other] = other, at
                    members[last], place[p] = p, last
                    count[g], count[last] = size - 1, 1
                    group[p] = last
        else:
            own = sorted(members[start : end + 1])
            pointed = []
            for s in own:
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    pointed.append(p)
            times = Counter(pointed)
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            for k in sorted(by_times, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in by_times[k]:
                    g = group[p]
                    last = g + count[g] - 1
                    other, at = members[last], place[p]
                    members[at], place[other] = other, at
                    members[last], place[p] = p, last
                    count[g] -= 1
                    if g in moved:
                        moved[g].append(p)
                    else:
                        moved[g] = [p]
                for g, some in moved.items():
                    new = g + count[g]
                    count[new] = len(some)
                    for p in some:
                        group[p] = new
        end = start - 1

    out = [-1] * n
    out[0] = n - 1
    free = list(range(n))
    done = bytearray(n)
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = smaller[s]
    return out[1:]
