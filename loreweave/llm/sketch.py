"""Counts of hashes over all rows, in a table of fixed size.

A count is that of all hashes which share its place, so it is never too small,
and 1 means that nobody shares the hash.  Tasks send partial tables in rows of
``ROW`` places; their sums come to the driver: 2 MB whatever the data's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS, ROW = 18, 1024
SCHEMA = "at long, counts binary"


def places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _rows(at: np.ndarray, counts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts, pa.binary())], names=["at", "counts"])


def _sum(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ROW, dtype=np.int64)
    for batch in batches:
        for s in batch.column(1):
            total += np.frombuffer(s.as_buffer(), np.int64)
    yield _rows(np.array([key[0].as_py()]), [total.tobytes()])


def count_hashes(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The table of counts; ``hashes_of`` gives the hashes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            for hashes in hashes_of(batch):
                counts += np.bincount(places(hashes), minlength=len(counts))
        if counts.any():
            yield _rows(np.arange(len(counts) // ROW), [r.tobytes() for r in counts.reshape(-1, ROW)])

    counts = np.zeros(1 << BITS, dtype=np.int64)
    for row in rows.mapInArrow(run, SCHEMA).groupBy("at").applyInArrow(_sum, SCHEMA).collect():
        counts[row["at"] * ROW : (row["at"] + 1) * ROW] = np.frombuffer(row["counts"], np.int64)
    return counts


# -- membership ---------------------------------------------------------------------
#: Bytes of a row of a bit table; its bits are chosen by the number of members, between these.
BIT_ROW, LEAST_BITS, MOST_BITS = 1024, 16, 28


def _any(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BIT_ROW, dtype=np.uint8)
    for batch in batches:
        for s in batch.column(1):
            total |= np.frombuffer(s.as_buffer(), np.uint8)
    yield _rows(np.array([key[0].as_py()]), [total.tobytes()])


class BitTable:
    """Which hashes may be members: every member is in, and a few others (at most 32 MB)."""

    def __init__(self, bits: int, table: np.ndarray) -> None:
        self.bits, self.table = bits, table

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_table(rows: DataFrame, column: str, members: int) -> BitTable:
    """The table of a column of hashes (long), of which there are about ``members``."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(16 * max(members, 1)).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            row = at // (8 * BIT_ROW)
            for r in np.unique(row).tolist():
                held = mine.setdefault(r, np.zeros(BIT_ROW, dtype=np.uint8))
                inside = at[row == r] % (8 * BIT_ROW)
                np.bitwise_or.at(held, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        if mine:
            yield _rows(np.array(list(mine)), [v.tobytes() for v in mine.values()])

    table = np.zeros(max((1 << bits) // 8, BIT_ROW), dtype=np.uint8)
    for r in rows.select(column).mapInArrow(run, SCHEMA).groupBy("at").applyInArrow(_any, SCHEMA).collect():
        table[r["at"] * BIT_ROW : (r["at"] + 1) * BIT_ROW] = np.frombuffer(r["counts"], np.uint8)
    return BitTable(bits, table)
