"""Exact token ids of texts, with each distinct unit encoded once.

A text is cut into *units*: before every space that follows a character which isn't white, and
for tokenizers whose pre-tokens are runs of letters, of digits or of other signs, between ASCII
characters of two of these kinds (signs that may join a pre-token with letters, ``'`` and ``|``,
aside).  No pre-token reaches over such a cut, and neither normalisation nor merges do, so the
ids of a text are those of its units in order.  ``tests/llm`` compares them with the tokenizer's own.

Arrow finds the distinct units of a block by their bytes, so no hash stands for a text.  A worker
keeps what it has encoded; memory is bounded by ``MOST_UNITS`` and ``MOST_BYTES``, beyond which the
table is forgotten, and a text longer than a block is encoded in parts that end where units do.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .text import ASCII_LOWER, BLOCK_BYTES, KEPT, U, prefix_hash, span_hash, text_bytes

#: The table of known units is forgotten beyond these; it only saves time.
MOST_UNITS = 700_000
MOST_BYTES = 16 << 20

#: ASCII white space, and the last byte of every other white-space character.
_WHITE = np.zeros(256, bool)
_WHITE[9:14] = _WHITE[28:33] = True
_WHITE_END = np.zeros(256, bool)
_WHITE_END[[*range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
#: Bytes with which those characters begin: two before the last one, or one.
_WHITE_LEAD = np.zeros(256, bool)
_WHITE_LEAD[[0xE1, 0xE2, 0xE3]] = True

#: ASCII letters, digits and signs; 0 for what is none of them, or joins them.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"]] = 3

_LETTERS = re.compile(rb" ?[a-zA-Z]+").fullmatch


def unit_starts(data: np.ndarray, offsets: np.ndarray, by_kind: bool = True) -> np.ndarray:
    """Where the units of a block of texts begin; every text that isn't empty begins one."""
    first = np.zeros(len(data) + 1, bool)
    if by_kind and len(data):
        kind = _KIND[data]
        first[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)
    space = np.flatnonzero(data == 32)
    space = space[space > 0]
    last = data[space - 1]
    white = _WHITE[last]
    odd = np.flatnonzero(_WHITE_END[last])  # perhaps the end of a longer white-space character
    white[odd] = _WHITE_LEAD[data[np.maximum(space[odd] - 3, 0)]] | (data[np.maximum(space[odd] - 2, 0)] == 0xC2)
    first[space[~white]] = True
    first[offsets[:-1]] = True
    return np.flatnonzero(first[:-1])


def parts(data: np.ndarray, limit: int = BLOCK_BYTES, by_kind: bool = True) -> Iterator[tuple[int, int]]:
    """Ranges of one long text that end where units end, of at most ``limit`` bytes or one longer unit."""
    starts = np.append(unit_starts(data, np.array([0, len(data)]), by_kind), len(data))
    at = 0
    while at < len(data):
        i = int(np.searchsorted(starts, at + limit, "right")) - 1
        end = int(starts[i]) if starts[i] > at else int(starts[np.searchsorted(starts, at, "right")])
        yield at, end
        at = end


class Rows:
    """Arrays of different lengths, one after another, to be taken by number."""

    def __init__(self, kind: type) -> None:
        self.flat, self.begin, self.size = np.zeros(1024, kind), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.used, self.rows = 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = self._room(self.flat, self.used + len(flat))
        self.begin, self.size = (self._room(x, self.rows + len(sizes)) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        new = slice(self.rows, self.rows + len(sizes))
        self.size[new] = sizes
        self.begin[new] = self.used + np.cumsum(sizes) - sizes
        self.used, self.rows = self.used + len(flat), self.rows + len(sizes)

    @staticmethod
    def _room(x: np.ndarray, needed: int) -> np.ndarray:
        """``x``, a quarter larger than needed where it is too small."""
        if needed <= len(x):
            return x
        out = np.zeros(needed + needed // 4, x.dtype)
        out[: len(x)] = x
        return out

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers one after another, and where each begins (one more than arrays)."""
        sizes = self.size[which].astype(np.int64)
        at = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[np.repeat(self.begin[which] - at[:-1], sizes) + np.arange(at[-1])], at


class Units:
    """Numbers the distinct units that a worker has met; ``learn`` computes what is kept of new ones.

    A hash only says where to look: a unit is known if its bytes are those kept under its hash.
    """

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, U), np.zeros(0, np.int32)  # by hash
        self.bytes = Rows(np.uint8)

    def learn(self, new: list[bytes]) -> None:
        raise NotImplementedError

    def numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each unit; valid until the next call."""
        if self.bytes.rows > MOST_UNITS or self.bytes.used > MOST_BYTES:
            self.forget()
        if not len(starts):
            return np.zeros(0, np.int64)
        at = np.append(starts, len(data)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        flat, at = text_bytes(units.dictionary)
        size = np.diff(at)
        h = span_hash(prefix_hash(flat), at[:-1], at[1:])
        number, known = self._find(h, flat, size)
        new = np.flatnonzero(~known)
        if len(new):
            number[new] = self.bytes.rows + np.arange(len(new))
            self.learn(units.dictionary.take(pa.array(new)).to_pylist())
            self.bytes.add(flat[np.repeat(~known, size)], size[new])
            first, at_first = np.unique(h[new], return_index=True)
            place = np.searchsorted(self.keys, first)
            taken = place < len(self.keys)
            taken[taken] = self.keys[place[taken]] == first[taken]
            self.keys = np.insert(self.keys, place[~taken], first[~taken])
            self.slots = np.insert(self.slots, place[~taken], number[new[at_first[~taken]]])
        return number[units.indices.to_numpy()]

    def _find(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each unit whose bytes are kept under its hash, and which those are."""
        place = np.searchsorted(self.keys, h)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == h[known]
        number = np.full(len(h), -1)
        number[known] = self.slots[place[known]]
        known[known] = self.bytes.size[number[known]] == size[known]
        kept, at = self.bytes.take(number[known])
        wrong = kept != flat[np.repeat(known, size)]
        known[np.flatnonzero(known)[np.unique(np.searchsorted(at, np.flatnonzero(wrong), "right") - 1)]] = False
        return number, known


class Encoder(Units):
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        #: Whether the ids depend neither on the case of A-Z nor on spaces.
        self.folds = self.tokenizer.encode(" Ab", add_special_tokens=False).ids == self.tokenizer.encode("ab", add_special_tokens=False).ids
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.ids = Rows(np.uint32)

    def learn(self, new: list[bytes]) -> None:
        space, model = "" if self.folds else "\u0120", self.tokenizer.model  # what a vocabulary of bytes writes for a space
        ids: list[list[int]] = []
        for w in new:
            if _LETTERS(w):  # one pre-token
                ids.append([t.id for t in model.tokenize(w.decode().replace(" ", space))])
            else:
                ids.append(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids)
        self.ids.add(np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, and where each row's begin (one more than rows)."""
        if len(offsets) == 2 and len(data) > BLOCK_BYTES:
            ids = np.concatenate([self._encode(data[s:e], np.array([0, e - s]))[0] for s, e in parts(data)])
            return ids, np.array([0, len(ids)])
        return self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.folds:
            data = ASCII_LOWER[data]
        starts = unit_starts(data, offsets)
        which = self.numbers(data, starts)
        ids, at = self.ids.take(which)
        return ids, at[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    return Encoder(path)


KEPT.append(encoder.cache_clear)
