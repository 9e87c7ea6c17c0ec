"""Suffix arrays by linear grouping.

The first phase puts suffixes into groups by their Lyndon prefix. Groups are
taken from the highest down; each member of the group points to the nearest
suffix before it that is in a lower group (its previous smaller one, found by
jumping along pointers already known). Suffixes pointed to share that member's
prefix behind their own, so they leave their groups for new ones right above:
the more members point to one, the higher.

The second phase goes up through the order as it fills: the suffix before one
just placed takes the next place of its group, and so do its own previous
smaller ones in turn, until one has its place already. Nothing is renamed and no
shorter text is sorted on the way.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes of a sequence of numbers, in order (a prefix of another comes first)."""
    low = min(text, default=0) - 1
    symbols = [*text, low]  # the end, less than any other
    order, start, before = _groups(symbols)
    return _emitted(start, before, len(symbols))[1:]


def _groups(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffixes in order of their groups, each one's group (the place it begins at), each one's previous smaller suffix."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place, start, size, before = [0] * n, [0] * n, [0] * n, [-1] * n
    begin = 0
    for at, suffix in enumerate(order):
        place[suffix] = at
        if at and symbols[suffix] != symbols[order[at - 1]]:
            begin = at
        start[suffix] = begin
        size[begin] += 1
    end = n
    while end:
        group = start[order[end - 1]]
        members = order[group:end]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for suffix in members:
            j = suffix - 1
            while j >= 0 and start[j] >= group:
                j = before[j]
            before[suffix] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = group
        if len(pointed) == 1:
            (suffix,) = pointed
            moves = [(1, start[suffix], [suffix])]
        else:
            together: dict[tuple[int, int], list[int]] = {}
            for suffix, times in pointed.items():
                together.setdefault((times, start[suffix]), []).append(suffix)
            moves = [(t, g, s) for (t, g), s in sorted(together.items(), key=lambda x: -x[0][0])]
        for _, old, suffixes in moves:
            if size[old] == len(suffixes):
                continue  # the whole group moves, and nothing comes between
            left = size[old] - len(suffixes)
            new = old + left
            tail = new
            for suffix in suffixes:  # to the end of the old group's places
                at, other = place[suffix], order[tail]
                order[at], order[tail] = other, suffix
                place[other], place[suffix] = at, tail
                tail += 1
                start[suffix] = new
            size[old], size[new] = left, len(suffixes)
    return order, start, before


def _emitted(start: list[int], before: list[int], n: int) -> list[int]:
    free = list(range(n))  # the next free place of the group that begins there
    out, placed = [-1] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            group = start[j]
            out[free[group]] = j
            free[group] += 1
            placed[j] = True
            j = before[j]
    return out


def common_prefixes(text: Sequence[int], order: list[int]) -> list[int]:
    """How much each suffix in order shares with the one before it."""
    n, out, h = len(order), [0] * len(order), 0
    place = [0] * n
    for at, suffix in enumerate(order):
        place[suffix] = at
    for i in range(n):
        at = place[i]
        if not at:
            h = 0
            continue
        j = order[at - 1]
        stop = n - max(i, j)
        while h < stop and text[i + h] == text[j + h]:
            h += 1
        out[at] = h
        if h:
            h -= 1
    return out
