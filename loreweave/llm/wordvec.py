"""Vectorised word hashing over Arrow text buffers.

Texts stay in their Arrow buffer as UTF-8 bytes.  A look-up table says which
byte belongs to a word; all words are then hashed together, eight bytes at a
time: each step adds the next eight bytes of every word that has them to its
state and mixes it.  A step is one-to-one, so words of up to eight bytes and the
same length never collide; longer ones do with the chance of a random 64-bit
hash.  Words beyond ``LONG_WORD`` bytes are hashed by BLAKE2b.  No Python object
is made for any other word.

Separators must be ASCII bytes; every byte of 0x80 and above then belongs to a
word, so working on bytes equals working on code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in blocks of whole documents of about this many bytes.
BLOCK_BYTES = 2 << 20
#: Byte windows of a block are made in segments of about this many bytes.
SEGMENT_BYTES = 1 << 19
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256

_BASE = 0x9E3779B97F4A7C15  # odd, thus invertible modulo 2**64
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sequence(seed: int, n: int) -> np.ndarray:
    start = (seed * 0xD1342543DE82EF95 + 1) & _MASK
    return mix64(np.uint64(start) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE))


def _byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words split at blanks only (space, tab, line feed to carriage return).
BLANK_WORDS = ~_byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words of lower-case letters, digits and everything beyond ASCII.
ALNUM_WORDS = _byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents: (first row, end row, bytes, offsets from 0).

    A document larger than ``max_bytes`` makes a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offset_buffer, data = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + max_bytes, side="right")) - 1)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


#: Keeps the first k bytes of eight, for k from 0 to 8.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _hashes(low: np.ndarray, first: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each run of bytes; ``low`` has eight bytes to spare at its end."""
    eight = np.ndarray(len(low) - 7, dtype="<u8", buffer=low, strides=(1,))
    state = mix64(length.astype(np.uint64) * np.uint64(_BASE) ^ np.uint64(seed))
    alive = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(alive):
        left = length[alive] - at
        state[alive] = mix64((state[alive] ^ (eight[first[alive] + at] & _KEEP[np.minimum(left, 8)])) + np.uint64(_BASE))
        at += 8
        alive = alive[left > 8]
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        state[k] = int.from_bytes(hashlib.blake2b(low[first[k] : first[k] + length[k]], digest_size=8, key=seed.to_bytes(8, "little") if seed else b"").digest(), "little")
    return state


def word_hashes(raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block: (hash, first byte, end byte, words per document); A-Z count as a-z."""
    n = len(raw)
    docs = len(offsets) - 1
    inside = word_bytes[raw]
    doc_start = np.zeros(n + 1, dtype=bool)
    doc_start[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | doc_start[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | doc_start[1:n]
    first = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    low = np.zeros(n + 8, dtype=np.uint8)
    low[:n] = _LOWER[raw]
    bounds = np.searchsorted(first, offsets)
    return _hashes(low, first, end - first, seed), first, end, np.diff(bounds) if docs else np.zeros(0, np.int64)


#: Odd multipliers of the places in a window of words.
PLACES = _sequence(11, 4096) | np.uint64(1)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of word hashes; its length counts."""
    n = len(words)
    places = PLACES if n <= len(PLACES) else _sequence(11, n) | np.uint64(1)
    with np.errstate(over="ignore"):
        return mix64(np.atleast_1d((words * places[:n]).sum(dtype=np.uint64) + np.uint64(n) * np.uint64(_BASE)))[0]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, equal to ``sequence_hash`` of it."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, (width * _BASE) & _MASK, dtype=np.uint64)
    for k in range(width):
        total += words[k : k + n] * PLACES[k]
    return mix64(total)
