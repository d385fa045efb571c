"""Common prefixes of sorted suffixes by breadth-first backward extension on a Burrows-Wheeler transform.

``shared_below`` finds, for neighbours in suffix order, whether they share fewer than ``depth`` symbols. The interval of
every string that occurs is extended backward by every symbol that stands before it; strings of one
length are extended together, so each boundary gets its value the first time an interval ends there, values come in
increasing order, and the search stops at ``depth``: boundaries without a value share at least that much.
"""

from __future__ import annotations

import numpy as np


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by the first ``depth`` symbols at least, by prefix doubling."""
    rank = text.astype(np.uint64)
    done = 1
    while done < depth:
        after = np.zeros(len(rank), dtype=np.uint64)
        after[: len(rank) - done] = rank[done:] + np.uint64(1)
        rank = np.unique(rank << np.uint64(32) | after, return_inverse=True)[1].astype(np.uint64)
        done *= 2
    return np.argsort(rank, kind="stable")


def shared_below(text: np.ndarray, order: np.ndarray, depth: int, stop_symbol: int = 0) -> np.ndarray:
    """For every place i in ``order``, whether suffixes i-1 and i share fewer than ``depth`` symbols.

    Strings are not extended by ``stop_symbol``, so the answer holds for suffixes without it in their first ``depth`` symbols.
    """
    n = len(text)
    before = text[order - 1].astype(np.int64)
    before[order == 0] = stop_symbol
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, dtype=np.int64)  # place of the suffix that is one symbol longer
    step[by_symbol] = np.arange(n)
    changes = np.flatnonzero(np.diff(before)) + 1
    same_until = np.append(changes, n)[np.searchsorted(changes, np.arange(n), side="right")]

    known = np.zeros(n + 1, dtype=bool)
    known[0] = known[n] = True
    edges = np.flatnonzero(np.concatenate([[True], text[order][1:] != text[order][:-1], [True]]))
    low, high = edges[:-1], edges[1:]
    known[edges] = True
    symbol = text[order][low]
    low, high = low[symbol != stop_symbol], high[symbol != stop_symbol]
    for _ in range(1, depth):
        if not len(low):
            break
        plain = same_until[low] >= high
        first, last = low[plain], high[plain] - 1
        low, high = low[~plain], high[~plain]
        if len(low):
            size = high - low
            owner = np.repeat(np.arange(len(low)), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
            key = owner << 32 | before[place]
            by_key = np.argsort(key, kind="stable")
            key, place = key[by_key], place[by_key]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first = np.concatenate([first, place[starts]])
            last = np.concatenate([last, place[np.append(starts[1:], len(key)) - 1]])
        inside = before[first] != stop_symbol
        low, high = step[first[inside]], step[last[inside]] + 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
    return known[:n]


def repeated_windows(text: np.ndarray, starts: np.ndarray, weights: np.ndarray, depth: int) -> np.ndarray:
    """For every start whether the ``depth`` symbols from there occur at another start too, or at one of weight over 1."""
    order = sort_suffixes(text, depth)
    group = np.empty(len(text), dtype=np.int64)
    group[order] = np.cumsum(shared_below(text, order, depth))
    own = group[starts]
    return np.bincount(own, weights)[own] > 1 if len(own) else np.zeros(0, bool)
