"""Token ids of whole texts with a tokenizer file of the tokenizers library.

Texts are full of repeated words, and a byte-level BPE with the usual pattern never merges across the start of a run of white
space. So a text is cut before its single spaces and each distinct piece is encoded once in a while; the ids of a text are those
of its pieces in order, equal to those of the whole text. A text with runs of white space that could make a
difference is encoded whole, and so are all texts if the tokenizer file says anything but such a BPE.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space for which a cut before it might not be one for the tokenizer's pattern.
_RARE_BLANK = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -‏    　﻿]"
#: Pieces encoded as one text; more at once take longer each.
JOINED = 500
#: Distinct pieces that a process remembers; beyond that it starts anew.
REMEMBERED = 300_000
#: Bytes of text encoded at once; a single longer text is encoded alone.
ENCODE_BYTES = 4 << 20

_encoders: dict[str, Encoder] = {}


def encode_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of slices of about ``ENCODE_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENCODE_BYTES, side="right")))
        yield at, to
        at = to


class _Table:
    """Ids of strings that are known by a number."""

    def __init__(self) -> None:
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the strings one after the other, how many each has)."""
        size = self.size[number]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[number] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


class Encoder:
    """Encodes with the tokenizer file at ``path``, without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        model, before = self.tokenizer.model, self.tokenizer.pre_tokenizer
        plain = isinstance(model, BPE) and model.dropout is None and self.tokenizer.normalizer is None
        self.cuts = plain and isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join(["  ", "\n ", "[ \n]$", _RARE_BLANK, *special])
        #: Bytes that each id of a byte-level BPE stands for: its name has a character for each.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for name, i in vocabulary.items():
            self.bytes_of[i] = len(name)
        self.forget()

    def forget(self) -> None:
        """Gives up what is remembered; a task does so at its end, for its process may go on with other work."""
        self.after_space: dict[str, int] = {}
        self.at_start: dict[str, int] = {}
        self.table = _Table()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _number(self, pieces: list[str], space: str) -> np.ndarray:
        """Numbers of the pieces, each after ``space``; new ones are encoded."""
        known = self.after_space if space else self.at_start
        new = list(dict.fromkeys(x for x in pieces if x not in known))
        if new:
            self._learn(new, space, known)
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def _learn(self, new: list[str], space: str, known: dict[str, int]) -> None:
        """Encodes new pieces.

        Pieces after a space are encoded as one text, and the bytes that ids stand for tell where each ends; others by themselves."""
        if space:
            joined = self._ids([" " + " ".join(new[k : k + JOINED]) for k in range(0, len(new), JOINED)])
            ids = np.concatenate([np.array(x, dtype=np.uint32) for x in joined])
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, new)), dtype=np.int64, count=len(new)) + 1)
            self._add(new, known, ids, np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="left") + 1, prepend=0))
        else:
            each = self._ids(new)
            self._add(new, known, np.fromiter(itertools.chain.from_iterable(each), dtype=np.uint32), np.fromiter(map(len, each), dtype=np.int64, count=len(each)))

    def _add(self, new: list[str], known: dict[str, int], flat: np.ndarray, size: np.ndarray) -> None:
        known.update(zip(new, range(len(self.table.size), len(self.table.size) + len(new)), strict=True))
        self.table.add(flat, size)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text; null is an empty text."""
        texts = pc.fill_null(texts, "")
        apart = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(apart):
            out[i] = np.array(self._ids([texts[i].as_py()])[0], dtype=np.uint32)
        cut = np.flatnonzero(~apart)
        if not len(cut):
            return out
        if len(self.after_space) > REMEMBERED:
            self.forget()
        words = pc.split_pattern(texts.take(pa.array(cut)), " ")
        edges = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        number = self._number(coded.dictionary.to_pylist(), " ")[at]
        number[edges[:-1]] = self._number(words.flatten().take(pa.array(edges[:-1])).to_pylist(), "")  # no space before them
        all_ids, each = self.table.gather(number)
        text_edges = np.concatenate([[0], np.cumsum(each)])[edges]
        for k, i in enumerate(cut):
            out[i] = all_ids[text_edges[k] : text_edges[k + 1]]
        return out


def encoder(path: str) -> Encoder:
    """The encoder of this process for the file at ``path``."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
