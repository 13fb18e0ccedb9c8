"""Counting quotient filters: lossless, compact, sorted tables of counts of packed word-id n-grams.

An n-gram is two halves of packed ids.  A Feistel network permutes the pair of
halves, which spreads n-grams evenly and can be undone.  The front bits of the
permuted pair are the cell, the next ones the quotient, and all others the
remainder, which is kept in full; so a filter gives back its n-grams exactly.

A filter has one bit for each quotient that occurs, one bit for each entry that
ends its quotient's run, the remainders as planes of bits, one bit for each
count above 1 and a byte for those (255: the count follows in a list).  Entries are in order of the permuted
pair, so filters of one cell merge in order and their counts add up.
"""

from __future__ import annotations

import struct

import numpy as np

from .wordvec import mix64

_HEAD = struct.Struct("<IBBII")
_MANY = 255
_KEYS = [np.uint64(k) for k in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]

Halves = tuple[np.ndarray, np.ndarray]


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permuted(left: np.ndarray, right: np.ndarray, bits: tuple[int, int]) -> Halves:
    """A pair of halves of ``bits`` to another pair, one to one."""
    for i, key in enumerate(_KEYS):
        if i % 2:
            right = right ^ (mix64(left + key) & _mask(bits[1]))
        else:
            left = left ^ (mix64(right + key) & _mask(bits[0]))
    return left, right


def restored(left: np.ndarray, right: np.ndarray, bits: tuple[int, int]) -> Halves:
    """The pair that ``permuted`` made this one of."""
    for i, key in reversed(list(enumerate(_KEYS))):
        if i % 2:
            right = right ^ (mix64(left + key) & _mask(bits[1]))
        else:
            left = left ^ (mix64(right + key) & _mask(bits[0]))
    return left, right


def tallied(left: np.ndarray, right: np.ndarray, bits: tuple[int, int], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the sum of their counts (without counts each is 1)."""
    if not len(left):
        return left, right, np.zeros(0, dtype=np.int64)
    if sum(bits) <= 64:
        whole = (left << np.uint64(bits[1])) | right
        if counts is None:
            whole.sort()
        else:
            order = np.argsort(whole, kind="stable")
            whole, counts = whole[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
        left, right = whole[new] >> np.uint64(bits[1]), whole[new] & _mask(bits[1])
        size = len(whole)
    else:
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        counts = None if counts is None else counts[order]
        new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        size = len(left)
        left, right = left[new], right[new]
    return left, right, np.diff(np.append(new, size)) if counts is None else np.add.reduceat(counts, new)


def _planes(values: np.ndarray, bits: int) -> bytes:
    """Each bit of all values, then the next bit."""
    return b"".join(np.packbits((values >> np.uint64(k) & np.uint64(1)).astype(bool)).tobytes() for k in range(bits))


class _Reader:
    def __init__(self, data: bytes | memoryview) -> None:
        self.data, self.at = memoryview(data), 0

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.take("u1", -(-n // 8)), count=n)

    def planes(self, n: int, bits: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.uint64)
        for k in range(bits):
            out |= self.bits(n).astype(np.uint64) << np.uint64(k)
        return out


def filter_of(left: np.ndarray, right: np.ndarray, counts: np.ndarray, bits: tuple[int, int], cell_bits: int) -> bytes:
    """The filter of distinct permuted pairs in order, all of one cell (the front ``cell_bits`` of the left half)."""
    n = len(left)
    inner = bits[0] - cell_bits
    quotient_bits = min(inner, max(n, 1).bit_length() - 1)
    rest = inner - quotient_bits
    own = left & _mask(inner)
    quotient = (own >> np.uint64(rest)).astype(np.int64)
    present = np.zeros(1 << quotient_bits, dtype=bool)
    present[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)[:n]
    more = counts[counts > 1]
    large = more[more >= _MANY]
    return b"".join((
        _HEAD.pack(n, quotient_bits, cell_bits, len(more), len(large)), np.packbits(present).tobytes(), np.packbits(ends).tobytes(), np.packbits(counts > 1).tobytes(),
        np.minimum(more, _MANY).astype(np.uint8).tobytes(), large.astype("<u8").tobytes(), _planes(own & _mask(rest), rest), _planes(right, bits[1]),
    ))


def entries(data: bytes | memoryview, cell: int, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The permuted pairs and counts of a filter, in order."""
    read = _Reader(data)
    n, quotient_bits, cell_bits, n_more, n_large = _HEAD.unpack(read.take("u1", _HEAD.size))
    present, ends = read.bits(1 << quotient_bits), read.bits(n)
    counts = read.bits(n).astype(np.int64) + 1
    more = read.take("u1", n_more).astype(np.int64)
    more[more == _MANY] = read.take("<u8", n_large)
    counts[counts > 1] = more
    inner = bits[0] - cell_bits
    rest = inner - quotient_bits
    low, right = read.planes(n, rest), read.planes(n, bits[1])
    quotient = np.flatnonzero(present)[np.cumsum(ends) - ends].astype(np.uint64) if n else np.zeros(0, np.uint64)
    return (np.uint64(cell) << np.uint64(inner)) | (quotient << np.uint64(rest)) | low, right, counts


def cells(left: np.ndarray, right: np.ndarray, counts: np.ndarray, bits: tuple[int, int], cell_bits: int) -> tuple[list[int], list[bytes]]:
    """Permuted pairs in order as one filter for each cell that has any."""
    if not len(left):
        return [], []
    cell = (left >> np.uint64(bits[0] - cell_bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    ends = np.append(starts[1:], len(left)).tolist()
    return cell[starts].tolist(), [filter_of(left[a:b], right[a:b], counts[a:b], bits, cell_bits) for a, b in zip(starts.tolist(), ends, strict=True)]


def merged(filters: list[tuple[bytes | memoryview, int]], bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of some filters with their cells: permuted pairs in order and their counts."""
    read = [entries(data, cell, bits) for data, cell in filters]
    return tallied(*(np.concatenate([r[k] for r in read]) for k in (0, 1)), bits, np.concatenate([r[2] for r in read]))
