"""Suffix arrays by linear grouping, for many texts at once.

Phase 1 puts the suffixes of each text into groups of equal Lyndon prefix, in
order: groups start as the symbols and are taken from the highest down. For each
suffix of the current group its previous smaller pointer (the nearest suffix to
the left that lies in a lower group) is found; the suffixes pointed to leave
their groups, those pointed to more often behind those pointed to less often.
Phase 2 emits the order: from the least suffix up, each takes the suffix to its
left, and what that one's pointers lead to, to the next free place of its group.
Nothing is renamed or sorted again, and each suffix is handled once in each
phase (Baier, 2016). All texts of a batch advance a group (or a place) per step,
as NumPy operations over the batch.
"""

from __future__ import annotations

import numpy as np


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of size[i] each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """symbols (below 2^16): the texts one after the other, each closed by its
    only 0; sizes: their lengths with that. Returns, text by text, the positions in symbols of
    its suffixes in order."""
    n = len(symbols)
    ends = np.cumsum(sizes)
    base = ends - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(symbols.astype(np.uint16), kind="stable")  # short integers are sorted by radix
    narrow = np.uint16 if len(sizes) < 1 << 16 else np.int64
    order = order[np.argsort(text[order].astype(narrow), kind="stable")].astype(np.int32)
    inverse = np.empty(n, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    # group: where the suffix's group begins in order; size: of the group that begins there
    heads = np.flatnonzero(np.concatenate(([True], (symbols[order[1:]] != symbols[order[:-1]]) | (text[order[1:]] != text[order[:-1]])))) if n else np.empty(0, np.int64)
    size = np.zeros(n, np.int32)
    size[heads] = np.diff(np.append(heads, n))
    group = np.full(n + 1, -1, np.int32)  # the last: what the first suffixes point to
    group[order] = np.repeat(heads, size[heads])
    smaller = np.arange(-1, n - 1, dtype=np.int32)
    smaller[base] = n
    left = np.zeros(n + 1, bool)

    end, low = ends.astype(np.int64), base.astype(np.int64)
    while len(end):
        head = group[order[end - 1]].astype(np.int64)
        count = size[head].astype(np.int64)
        member = order[_ragged(head, count)]
        own = np.repeat(head, count)
        to = smaller[member]
        while (higher := group[to] >= own).any():  # jump over what is as high or higher
            to[higher] = smaller[to[higher]]
            smaller[member] = to
        found = to[to < n]
        if len(found):
            target, times = np.unique(found, return_counts=True)
            of = group[target].astype(np.int64)
            by = np.lexsort((times, of))
            target, times, of = target[by], times[by], of[by]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            many = np.diff(np.append(first, len(of)))
            tail = of[first] + size[of[first]] - many
            place = _ragged(tail, many)
            # swap the targets into the ends of their groups
            left[target] = True
            there = order[place]
            staying = there[~left[there]]
            was = inverse[target]
            freed = was[was < np.repeat(tail, many)]
            order[freed], inverse[staying] = staying, freed
            order[place], inverse[target] = target, place
            left[target] = False
            run = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (times[1:] != times[:-1]))))
            length = np.diff(np.append(run, len(of)))
            size[of[first]] -= many.astype(np.int32)
            size[place[run]] = length
            group[target] = np.repeat(place[run], length)
        end = head
        going = end > low
        end, low = end[going], low[going]

    out = np.empty(n, np.int32)
    out[base] = ends - 1
    free = np.arange(n, dtype=np.int32)  # the next place of the group that begins there
    done = np.zeros(n + 1, bool)
    done[ends - 1] = done[n] = True
    by = np.argsort(-sizes, kind="stable")
    base_by = base[by].astype(np.int32)
    live = np.searchsorted(-sizes[by], -np.arange(int(sizes.max(initial=0))), side="left")
    for i in range(len(live)):
        b = base_by[: int(live[i])]
        here = out[b + i]
        at = np.where(here > b, here - 1, n)
        at = at[~done[at]]
        while len(at):
            g = group[at]
            out[free[g]] = at
            free[g] += 1
            done[at] = True
            at = smaller[at]
            at = at[~done[at]]
    return out
