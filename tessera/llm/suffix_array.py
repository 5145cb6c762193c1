"""Suffix arrays by linear grouping: one text at a time, or many short texts in step.

Phase 1 gives each suffix the group of its longest Lyndon prefix. Groups start as first letters and are processed
in descending order. For each suffix of the group at hand, the pointer to the previous smaller suffix is found by
following pointers already set; the suffixes pointed at have their prefixes extended by the group's, as often as
the group points at them, and move, within their own group, behind those that are not extended.

Phase 2 emits the order. Suffixes of a group differ in the suffix that follows their common prefix, the next
smaller one, so walking the array upwards and, from each suffix's left neighbour, along the pointers puts every
suffix at the next free place of its group. Nothing is renamed or sorted recursively.

A group is a stretch of places and is known by its first one; the last place of each stretch knows the first, so the next group
to process is found at once. Suffixes move by swapping places within their stretch, so a move costs the same
however large the group is. A group of m suffixes points at others with less than sqrt(2 m) different frequencies, so
ordering these costs no more than the group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: bytes) -> list[int]:
    """The starts of all suffixes in their order, in time that grows with the text's length."""
    n = len(text)
    size, head = [0] * (n + 1), [0] * (n + 1)
    counts = [0] * 257
    for letter in text:
        counts[letter + 1] += 1
    first = counts[:256]
    for letter in range(1, 256):
        first[letter] += first[letter - 1]
    for letter in range(256):
        if counts[letter + 1]:
            size[first[letter]] = counts[letter + 1]
            head[first[letter] + counts[letter + 1] - 1] = first[letter]
    group = [first[letter] for letter in text]
    place, order = [0] * n, [0] * n
    free = first[:]
    for i, letter in enumerate(text):
        place[i] = free[letter]
        order[free[letter]] = i
        free[letter] += 1

    before = list(range(-1, n - 1))
    end = n
    while end > 0:
        start = head[end - 1]
        times: dict[int, int] = {}
        for i in order[start:end]:
            path = [i]
            j = before[i]
            while j >= 0 and group[j] >= start:
                if group[j] == start:
                    path.append(j)
                j = before[j]
            for k in path:
                before[k] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved: dict[int, dict[int, list[int]]] = {}
        for j, k in times.items():
            moved.setdefault(group[j], {}).setdefault(k, []).append(j)
        for old, parts in moved.items():
            at = old + size[old]
            for k in sorted(parts, reverse=True):
                for j in parts[k]:
                    at -= 1
                    other, there = order[at], place[j]
                    order[there], place[other] = other, there
                    order[at], place[j] = j, at
                for j in parts[k]:
                    group[j] = at
                size[at] = len(parts[k])
                head[at + size[at] - 1] = at
            if at > old:
                size[old] = at - old
                head[at - 1] = old
        end = start

    out = [0] * n
    free = list(range(n))
    placed = [False] * n

    def walk(s: int) -> None:
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = before[s]

    walk(n - 1)
    for r in range(n):
        walk(out[r] - 1)
    return out


def stretches(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end."""
    sizes = ends - starts
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def flat_suffix_arrays(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix arrays of many texts one after the other, as starts in the joined texts, and the texts' lengths.

    In step: every round processes the highest group left of each text. The work is that of the texts one by one; a
    batch has as many rounds as its text with the most groups.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    bases = ends - lengths
    total = int(lengths.sum())
    letters = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    keys = np.repeat(np.arange(len(texts)), lengths) << 8 | letters
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if total else np.zeros(0, np.int64)
    widths = np.diff(np.concatenate([new, [total]]))
    size, head = np.zeros(total, np.int64), np.zeros(total, np.int64)
    size[new] = widths
    head[new + widths - 1] = new
    group, place = np.empty(total, np.int64), np.empty(total, np.int64)
    group[order] = np.repeat(new, widths)
    place[order] = np.arange(total)
    before = np.arange(-1, total - 1)
    before[bases[lengths > 0]] = -1
    chosen = np.zeros(total, bool)

    low, high = bases[lengths > 0], ends[lengths > 0]
    while len(low):
        start = head[high - 1]
        here = order[stretches(start, high)]
        least = np.repeat(start, high - start)
        left = start > low
        low, high = low[left], start[left]
        j = before[here]
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            todo = todo[group[j[todo]] >= least[todo]]
            if not len(todo):
                break
            j[todo] = before[j[todo]]
            before[here[todo]] = j[todo]
            todo = todo[j[todo] >= 0]
        before[here] = j
        targets = np.sort(j[j >= 0])
        if not len(targets):
            continue
        first = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
        times = np.diff(np.concatenate([first, [len(targets)]]))
        targets = targets[first]
        old = group[targets]
        by_group = np.lexsort((times, old))
        targets, times, old = targets[by_group], times[by_group], old[by_group]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new_part = new_old | np.concatenate([[True], times[1:] != times[:-1]])
        first_old, first_part = np.flatnonzero(new_old), np.flatnonzero(new_part)
        moved = np.diff(np.concatenate([first_old, [len(old)]]))
        count_part = np.diff(np.concatenate([first_part, [len(old)]]))
        # The targets take the last places of their groups; who stands there takes the places that they leave.
        tail = old + size[old] - np.repeat(moved, moved)
        slots = tail + np.arange(len(old)) - np.repeat(first_old, moved)
        parts = np.repeat(slots[first_part], count_part)
        theirs = place[targets]
        chosen[targets] = True
        occupants = order[slots]
        displaced = occupants[~chosen[occupants]]
        chosen[targets] = False
        vacated = theirs[theirs < tail]
        order[vacated], place[displaced] = displaced, vacated
        order[slots], place[targets] = targets, slots
        group[targets] = parts
        kept = old[first_old]
        rest = size[kept] - moved
        size[kept] = rest
        head[(kept + rest - 1)[rest > 0]] = kept[rest > 0]
        size[slots[first_part]] = count_part
        head[slots[first_part] + count_part - 1] = slots[first_part]

    out = np.full(total, -1, np.int64)
    free = np.arange(total)
    placed = np.zeros(total, bool)

    def walk(s: np.ndarray) -> None:
        while len(s):
            s = s[~placed[s]]
            placed[s] = True
            cell = group[s]
            out[free[cell]] = s
            free[cell] += 1
            s = before[s]
            s = s[s >= 0]

    walk(ends[lengths > 0] - 1)
    by_length = np.argsort(-lengths, kind="stable")
    base, long = bases[by_length], lengths[by_length]
    for r in range(int(lengths.max(initial=0))):
        alive = int(np.searchsorted(-long, -r, side="left"))
        now = out[base[:alive] + r]
        ok = now > base[:alive]
        walk(now[ok] - 1)
    return out, lengths


def suffix_arrays(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix arrays of many texts in step, as rows of one array, and the texts' lengths; rows are filled with -1."""
    flat, lengths = flat_suffix_arrays(texts)
    out = np.full((len(texts), int(lengths.max(initial=0))), -1)
    row = np.repeat(np.arange(len(texts)), lengths)
    base = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, np.arange(len(flat)) - base] = flat - base
    return out, lengths
