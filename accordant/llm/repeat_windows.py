"""Where equal strings of a fixed number of symbols, bytes or words, can start: content-defined anchors, cores and flanks, in numpy.

A string of ``length`` symbols has as its anchor the leftmost of its grams with the least hash, which its own
symbols settle. Neighbouring starts mostly have the same anchor and make up a run. The starts of a run are dealt into bins
by their distance from the anchor; all strings of a bin share the same middle part, its core, so equal strings
have equal cores, and differ from other strings of the bin in fewer symbols than a bin has on either side, the flanks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from accordant.llm.shared import mix, powers


class Scale(NamedTuple):
    """Bytes of a symbol, symbols of a gram at least and starts of a bin."""

    unit: int
    least: int
    bin: int

    def gram(self, length: int) -> int:
        """Symbols of a gram: a quarter of a string, for the shorter a gram, the more often strings share it that share nothing else."""
        return max(self.least, length // 4)


#: Texts as bytes, and as 64-bit hashes of their words.
BYTES, WORDS = Scale(1, 32, 64), Scale(8, 4, 8)

_rng = np.random.default_rng(97)
_CODES = _rng.integers(1, 2**64, size=(2, 256), dtype=np.uint64)
_BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)


def sums(data: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    values = _CODES[which][data] if data.dtype == np.uint8 else mix(data ^ _CODES[which][0])
    np.cumsum(values * powers(_BASES[which], len(data)), out=out[1:])
    return out


def hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(_INVERSES[which], len(total))[start] + (end - start).astype(np.uint64))


class Runs(NamedTuple):
    """Runs of starts: text number, first start, start after the last, anchor (positions in the whole data), hash of the anchor's gram."""

    doc: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    anchor: np.ndarray
    code: np.ndarray


def _least_before(values: np.ndarray, width: int) -> np.ndarray:
    """Least of values[i:i+width] for every i with a whole window."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


def find_runs(data: np.ndarray, offsets: np.ndarray, length: int, total: np.ndarray, gram: int) -> Runs:
    """Runs of all strings of ``length`` symbols that lie in one text. total: sums(data, 0)."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none.astype(np.uint64))
    grams = np.arange(len(data) - gram + 1)
    code = hashes(total, grams, grams + gram, 0)
    bits = max(1, int(len(data)).bit_length())
    packed = (code >> np.uint64(bits)) << np.uint64(bits) | grams.astype(np.uint64)
    anchor = (_least_before(packed, length - gram + 1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= offsets[doc + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    first = np.flatnonzero(new)
    return Runs(doc[first], first, np.flatnonzero(last) + 1, anchor[first], code[anchor[first]])


class Bins(NamedTuple):
    """Parts of runs: run number, first start, start after the last, bounds of the core, two hashes of the core."""

    run: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    core: np.ndarray
    core_end: np.ndarray
    high: np.ndarray
    low: np.ndarray


def deal_into_bins(runs: Runs, length: int, totals: tuple[np.ndarray, np.ndarray], size: int) -> Bins:
    farthest, nearest = (runs.anchor - runs.first) // size, (runs.anchor - runs.stop + 1) // size
    many = farthest - nearest + 1
    run = np.repeat(np.arange(len(many)), many)
    number = farthest[run] - (np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many))
    core = runs.anchor[run] - size * number
    first = np.maximum(runs.first[run], core - size + 1)
    stop = np.minimum(runs.stop[run], core + 1)
    end = core + length - size + 1
    # the number of the bin is part of what has to be equal
    return Bins(run, first, stop, core, end, mix(hashes(totals[0], core, end, 0) + number.astype(np.uint64)), hashes(totals[1], core, end, 1))
