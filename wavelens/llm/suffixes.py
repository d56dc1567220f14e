"""Suffix arrays of byte strings in numpy: Larsson-Sadakane refinement and Kasai's
common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes. Suffixes start sorted by one symbol; every round doubles the sorted length by
    sorting only the groups that are not yet single, by the rank ``h`` further on."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    # rank: number of the group's last member (Larsson and Sadakane's group numbers)
    new = np.append(text[order][1:] != text[order][:-1], True)
    last = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(last, np.diff(np.append(-1, last)))
    h = 1
    while h < n:
        group = rank[order]
        single = np.ones(n, bool)
        single[1:] &= group[1:] != group[:-1]
        single[:-1] &= group[:-1] != group[1:]
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        at = order[open_]
        key = group[open_] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at                       # groups keep their places
        edge = np.append(key[1:] != key[:-1], True)
        ends = np.flatnonzero(edge)
        rank[at] = np.repeat(open_[ends], np.diff(np.append(-1, ends)))
        h *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, step: int = 16) -> np.ndarray:
    """Common prefix of each suffix (in sorted order) with the one before it, counted up
    to ``depth``. Kasai: in text order the length falls by at most one from a suffix
    to the next, so every ``step``-th is counted from nothing and those between
    from its bound. (The bound needs the full order, not one up to ``depth``.)"""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    length = np.zeros(n, np.int64)

    def extend(i: np.ndarray) -> None:
        i = i[before[i] >= 0]
        while len(i):
            a, b = i + length[i], before[i] + length[i]
            ok = (length[i] < depth) & (a < n) & (b < n)
            ok[ok] = text[a[ok]] == text[b[ok]]
            i = i[ok]
            length[i] += 1

    extend(np.arange(0, n, step))
    for k in range(1, step):
        i = np.arange(k, n, step)
        length[i] = np.where(before[i] >= 0, np.maximum(length[i - 1] - 1, 0), 0)
        extend(i)
    return length[order]
