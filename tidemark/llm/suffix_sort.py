"""Suffix sorting by linear grouping.

First phase: suffixes start out grouped by their first symbol. Groups are taken in descending order. Of each
suffix in the group, the previous-smaller pointer finds the nearest suffix to its left in a lower group; that one's
prefix is followed by the group's prefix, once for each suffix pointing to it. So it moves behind the rest of its own group,
those with more pointers further. At the end each group holds the suffixes with one Lyndon prefix, and
groups are in lexicographic order. Second phase: in ascending order, each suffix that is final
puts the suffixes whose Lyndon prefix ends where it begins, found along the pointers, next in their
groups. No round renames symbols or recurses.
"""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of s, whose last symbol must be smaller than all others."""
    n = len(s)
    size = [0] * (max(s) + 1)
    for c in s:
        size[c] += 1
    begin, at = [], 0
    for k in size:
        begin.append(at)
        at += k
    last = [0] * n  # of the group that starts here
    for b, k in zip(begin, size):
        if k:
            last[b] = b + k - 1
    group = [begin[c] for c in s]  # of each suffix: where its group starts
    order, place, free = [0] * n, [0] * n, begin[:]
    for i, c in enumerate(s):
        k = free[c]
        order[k] = i
        place[i] = k
        free[c] = k + 1
    before = [-1] * n
    top = n - 1
    while top >= 0:
        low = group[order[top]]
        if low == top:
            i = order[top]
            p = i - 1
            while p >= 0 and group[p] > low:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = group[p]
                end = last[g]
                if end != g:
                    at = place[p]
                    other = order[end]
                    order[at], place[other] = other, at
                    order[end], place[p] = p, end
                    last[g] = end - 1
                    group[p] = last[end] = end
        else:
            hits: dict[int, int] = {}
            for i in sorted(order[low : top + 1]):
                p = i - 1
                while p >= 0 and group[p] >= low:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    hits[p] = hits.get(p, 0) + 1
            levels: dict[int, list[int]] = {}
            for p, k in hits.items():
                levels.setdefault(k, []).append(p)
            for k in sorted(levels, reverse=True):
                moved: dict[int, int] = {}
                for p in levels[k]:
                    g = group[p]
                    end = last[g]
                    at = place[p]
                    other = order[end]
                    order[at], place[other] = other, at
                    order[end], place[p] = p, end
                    last[g] = end - 1
                    moved[g] = moved.get(g, 0) + 1
                for g, m in moved.items():
                    first = last[g] + 1
                    if first == g:
                        last[g] = g + m - 1
                    else:
                        last[first] = first + m - 1
                        for at in range(first, first + m):
                            group[order[at]] = first
        top = low - 1
    order[0] = n - 1
    group[n - 1] = -1
    free = list(range(n))
    for i in order:
        j = i - 1
        while j >= 0:
            g = group[j]
            if g < 0:
                break
            group[j] = -1
            order[free[g]] = j
            free[g] += 1
            j = before[j]
    return order


def repeated_windows(fragments: list[bytes], width: int) -> list[list[int]]:
    """For each fragment the starts of its windows of ``width`` bytes that also start elsewhere in the fragments.

    Equal windows are neighbours in the order of the suffixes.
    """
    symbols: list[int] = []
    for f in fragments:
        symbols += [c + 2 for c in f]
        symbols.append(1)
    symbols.append(0)
    text, owner, begin = b"\0".join([*fragments, b""]), [], []
    at = 0
    whole = [-1] * len(symbols)
    for k, f in enumerate(fragments):
        begin.append(at)
        for i in range(at, at + len(f) - width + 1):
            whole[i] = k
        at += len(f) + 1
    out: list[list[int]] = [[] for _ in fragments]
    starts = [i for i in suffix_array(symbols) if whole[i] >= 0]
    prior, same = b"", False
    for x, i in enumerate(starts):
        window = text[i : i + width]
        again = window == prior
        if again:
            if not same:
                j = starts[x - 1]
                out[whole[j]].append(j - begin[whole[j]])
            out[whole[i]].append(i - begin[whole[i]])
        prior, same = window, again
    return out
