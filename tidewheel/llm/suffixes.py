"""Suffix arrays by linear grouping, and longest matches read from them."""

from __future__ import annotations


def suffix_array(s: list[int]) -> list[int]:
    """Order of the suffixes of ``s``, whose symbols are 0 or more; the end is below all.

    First phase: suffixes start grouped by first symbol, and groups are processed from the
    highest down. A group's suffixes point to the nearest earlier suffix of a lower group;
    those, by how many point to them, leave their group for new ones just above it, as their
    Lyndon prefix grows by the processed group's. Each suffix points once, so the moves are
    linear. When done, a group holds the suffixes with one longest Lyndon prefix.

    Second phase: going through the order from the least, the suffix before the current one
    and the chain of its pointers take the next place in their groups, until one is already
    placed. No names are assigned anew and nothing recurses.
    """
    n = len(s) + 1  # with the end
    alphabet = sorted(set(s))
    first = {c: i + 1 for i, c in enumerate(alphabet)}
    member = [first[c] for c in s] + [0]
    groups: list[list[int]] = [[] for _ in range(len(alphabet) + 1)]
    for i, g in enumerate(member):
        groups[g].append(i)
    below = list(range(-1, len(groups) - 1))  # the next lower group
    above_of: dict[int, int] = {g: g + 1 for g in range(len(groups) - 1)}
    passed = [False] * len(groups)
    pointer = [-1] * n
    g = len(groups) - 1
    while g >= 0:
        passed[g] = True
        own = [i for i in groups[g] if member[i] == g]
        if len(own) > 1:
            own.sort()
        groups[g] = own
        if len(own) == 1:  # as below, for one suffix
            j = own[0] - 1
            while j >= 0 and passed[member[j]]:
                j = pointer[j]
            pointer[own[0]] = j
            if j >= 0:
                h, new = member[j], len(groups)
                up = above_of.get(h)
                groups.append([j])
                passed.append(False)
                below.append(h)
                above_of[h] = new
                if up is not None:
                    below[up] = new
                    above_of[new] = up
                member[j] = new
            g = below[g]
            continue
        pointed: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and passed[member[j]]:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, k in pointed.items():
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            fresh: dict[int, int] = {}
            for j in by_count[k]:
                h = member[j]
                if h not in fresh:
                    new = len(groups)
                    groups.append([])
                    passed.append(False)
                    up = above_of.get(h)
                    below.append(h)
                    above_of[h] = new
                    if up is not None:
                        below[up] = new
                        above_of[new] = up
                    fresh[h] = new
                member[j] = fresh[h]
                groups[fresh[h]].append(j)
        g = below[g]
    place, at, g = [0] * len(groups), 0, 0
    while g is not None:
        live = groups[g]
        place[g] = at
        at += len(live)
        g = above_of.get(g)
    order, placed = [-1] * n, [False] * n
    order[0], placed[n - 1] = n - 1, True
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            h = member[j]
            order[place[h]] = j
            place[h] += 1
            placed[j] = True
            j = pointer[j]
    return order[1:]


def longest_matches(s: list[int]) -> list[int]:
    """For each suffix, the most leading symbols that it shares with any other suffix."""
    n, order = len(s), suffix_array(s)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    best, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if not r:
            h = 0
            continue
        j = order[r - 1]
        while i + h < n and j + h < n and s[i + h] == s[j + h]:
            h += 1
        if h > best[i]:
            best[i] = h
        if h > best[j]:
            best[j] = h
        if h:
            h -= 1
    return best
