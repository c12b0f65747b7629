"""Vectorised kernels over Arrow string columns: bytes, words, shingles, rolling hashes.

Every kernel works on a *block*: the UTF-8 bytes of some consecutive rows in one array,
with row offsets.  A null text counts as empty.  Blocks are cut at row ends and hold at
most ``BLOCK_BYTES`` unless a single row is longer, so memory follows the block.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK_BYTES = (1 << 20) - 64  # so that the tables of powers stay at 2**20 entries
U = np.uint64
PLACE_BITS = 28
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: Lower-cases A-Z only; other bytes stay.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: After ASCII_LOWER: digits, a-z and every byte of a non-ASCII character belong to words.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


#: Empties what an operator keeps in a Python worker to save time.
KEPT: list[Callable[[], None]] = []
_owner = ""


def take_over(operator: str) -> None:
    """Called by the tasks of an operator: what another one kept in this worker goes, as workers live on."""
    global _owner
    if _owner != operator:
        for empty in KEPT:
            empty()
        _owner = operator
        gc.collect()
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and its row offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def overlapping_blocks(offsets: np.ndarray, overlap: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, first byte, last byte) of blocks of at most ``limit`` bytes.

    A longer row makes several blocks that overlap by ``overlap`` bytes, so that every window of
    one byte more lies in exactly one of them.
    """
    for a, b in blocks(offsets, limit):
        begin, end = int(offsets[a]), int(offsets[b])
        if end - begin <= limit:
            yield a, b, begin, end
            continue
        for s in range(begin, end - overlap, limit - overlap):
            yield a, b, s, min(end, s + limit)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that close values land far apart."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, U), np.empty(n, U)
    up[0] = down[0] = 1
    k, b, inv = 1, _BASE, _BASE_INV
    while k < n:  # doubles the filled part
        m = min(k, n - k)
        up[k : k + m] = up[:m] * U(pow(b, k, 1 << 64))
        down[k : k + m] = down[:m] * U(pow(inv, k, 1 << 64))
        k += m
    return up, down


KEPT.append(_powers.cache_clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(size)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p[i]: a polynomial over the first i bytes; ``span_hash`` compares any two spans by it."""
    up, _ = powers(len(data) + 1)
    p = np.empty(len(data) + 1, U)
    p[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end), the same wherever the span stands.

    Long texts can be made that collide (it is a polynomial modulo 2**64), so it stands for short
    windows or tells where to look; where a hash stands for a word, ``span_names`` is used.
    """
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def span_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic hash of the bytes of spans that don't overlap.

    Unlike ``span_hash`` it has no texts made to collide; Arrow finds the distinct spans by their bytes.
    """
    if not len(start):
        return np.zeros(0, U)
    edge = np.zeros(len(data) + 1, bool)
    edge[start] = edge[end] = edge[0] = True
    cuts = np.append(np.flatnonzero(edge[:-1]), len(data))
    tiles = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    which = tiles.indices.to_numpy()[np.searchsorted(cuts, start)]
    names = np.zeros(len(tiles.dictionary), U)
    asked = np.unique(which)
    names[asked] = np.frombuffer(b"".join(blake2b(w, digest_size=8).digest() for w in tiles.dictionary.take(pa.array(asked)).to_pylist()), "<u8")
    return names[which]


def word_spans(lowered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of a block; words end where rows end."""
    inside = IN_WORD[lowered]
    edge = np.zeros(len(lowered) + 1, bool)
    edge[offsets] = True  # a row starts or ends here
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    after = np.concatenate((inside[1:], [False])) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive words of one row, and the index of its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(n, U)
    for j in range(k):
        h = h * U(0xFF51AFD7ED558CCD) + words[j : j + n]
    first = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(h[first]), first


def row_starts(rows: np.ndarray) -> np.ndarray:
    """Where each run of equal row numbers begins."""
    return np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of the smallest (the first of equal ones).

    A hash gives its high bits and its place the low ones, so one minimum finds both; smaller
    windows double up until two of them cover the full width.  Which place wins depends on
    the window's content alone.
    """
    if len(values) >> PLACE_BITS:  # parts that overlap by a window
        step = (1 << PLACE_BITS) - width
        return np.concatenate([window_argmin(values[s : s + step + width - 1], width) + s for s in range(0, len(values) - width + 1, step)])
    bits = U(PLACE_BITS)  # the same for all blocks, or equal windows could choose differently
    low = (U(1) << bits) - U(1)
    best, have = (values & ~low) | np.arange(len(values), dtype=U), 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    return (best[: len(values) - width + 1] & low).astype(np.int64)
