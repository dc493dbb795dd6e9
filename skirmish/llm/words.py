"""Vectorised words and window hashes over the UTF-8 bytes of many texts.

All functions work on one *block*: the concatenated bytes of some documents
and the offsets between them. Words never cross documents. Hashes are 64-bit
polynomial sums over mixed byte values, normalised to the word's start and
mixed again, so equal words (or windows) have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from skirmish.llm.common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)            # odd: has an inverse modulo 2**64
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
BLOCK_BYTES = 1 << 20
SPACE = np.ones(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = False           # word bytes: all but white space
WORD = np.zeros(256, dtype=bool)                 # 0-9, a-z, A-Z and all beyond ASCII
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
FOLDED = EXACT.copy()                            # A-Z count as a-z
FOLDED[65:91] = EXACT[97:123]

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 … BASE**(n-1) (or of its inverse), kept per worker."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK_BYTES)
        step = np.full(size, BASE_INV if inverse else BASE, dtype=np.uint64)
        step[0] = 1
        have = _powers[key] = np.multiply.accumulate(step)
    return have[:n]


def window_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[starts[i]:ends[i]] for all i."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(n), out=total[1:])
    return mix64((total[ends] - total[starts]) * powers(n + 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of an Arrow string
    column; a block has whole texts and about ``block_bytes`` (one text may
    be longer). Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + block_bytes, side="right")) - 1)
        j = min(j, len(texts))
        yield i, j, data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j
    pa.default_memory_pool().release_unused()        # of earlier batches; a worker lives through many stages


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each one's document."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = table[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = EXACT) -> np.ndarray:
    return window_sums(values[buf], starts, ends)


def word_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Index of each document's first word (and the end): n_docs + 1 values."""
    return np.searchsorted(doc, np.arange(n_docs + 1))
