"""Hashed word and character n-gram features of texts, and sums of learned weights over them.

Words are taken as they are written, alone and in pairs of neighbours (a word twice in a row is the same pair
whichever word it is); the character n-grams are those of 3 and 4 code points whose inner ones are
not white space, so white space at either end marks the edge of a word. Words, pairs, 3-grams and
4-grams each have a quarter of the table of ``2 ** BITS`` buckets.
"""

from __future__ import annotations

import numpy as np

from accordant.llm.shared import IS_BREAK, find_words, mix

#: Buckets: a power of two.
BITS = 17
_SPREAD = np.uint32(0x9E3779B1)


def buckets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs, 3-grams and 4-grams: (bucket of each, offsets of each text's share)."""
    size = 1 << (BITS - 2)
    words = find_words(data, offsets, lower=False)
    out = [((words.code >> np.uint64(66 - BITS)).astype(np.int32), np.searchsorted(words.start, offsets))]
    first = np.flatnonzero(words.doc[1:] == words.doc[:-1])
    left, right = words.code[first], words.code[first + 1]
    pair = np.where(left == right, np.uint64(0), mix(left * np.uint64(0x9FB21C651E98DF25) + right))
    out.append(((pair >> np.uint64(66 - BITS)).astype(np.int32) + size, np.searchsorted(words.start[first], offsets)))
    # code points and where each text begins among them
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    edges_of = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    blank = (points <= 32) & IS_BREAK[np.minimum(points, 255)]
    points = np.where(blank, np.uint32(32), points)
    for n in (3, 4):
        count = max(0, len(points) - n + 1)
        code = np.zeros(count, dtype=np.uint32)
        inner = np.ones(count, dtype=bool)
        for k in range(n):
            code = code * np.uint32(0x01000193) + points[k : k + count]
            if 0 < k < n - 1:
                inner &= ~blank[k : k + count]
        for edge in edges_of[1:-1]:  # none may reach into the next text
            inner[max(0, edge - n + 1) : edge] = False
        at = np.flatnonzero(inner)
        hashed = code[at] * _SPREAD
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x85EBCA77)
        out.append(((hashed >> np.uint32(34 - BITS)).astype(np.int32) + (size * (n - 1)), np.searchsorted(at, edges_of)))
    return out


def sparse_rows(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every text: its distinct buckets and their weights. Each of the four kinds sums to 1/4."""
    parts = buckets(data, offsets)
    rows = []
    for i in range(len(offsets) - 1):
        index, weight = [], []
        for bucket, edges in parts:
            own = bucket[edges[i] : edges[i + 1]]
            if len(own):
                values, counts = np.unique(own, return_counts=True)
                index.append(values)
                weight.append((counts / (4.0 * len(own))).astype(np.float32))
        none = np.zeros(0)
        rows.append((np.concatenate(index or [none]).astype(np.int32), np.concatenate(weight or [none]).astype(np.float32)))
    return rows


def weighted_sums(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every text the sum of table[bucket] * weight over its features, without listing them."""
    total = np.zeros(len(offsets) - 1)
    for bucket, edges in buckets(data, offsets):
        sums = np.zeros(len(bucket) + 1)
        np.cumsum(table[bucket], out=sums[1:])
        n = edges[1:] - edges[:-1]
        total += (sums[edges[1:]] - sums[edges[:-1]]) / (4.0 * np.maximum(n, 1))
    return total
