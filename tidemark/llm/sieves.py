"""Sieves: bit tables of a fixed size that tell which 64-bit hashes a table surely lacks.

A sieve keeps rows out of a join or a count that could not matter there; what passes by chance
is refused by the exact step that follows. The driver only ever holds the bits (8 MB by
default), whatever the size of the table; a table of far more rows than bits passes everything,
which costs time and no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 26
PAGE = 15  # a page of this many bits is put together by one task


def sieve(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """2 ** bits bits, set at the top bits of the hashes (a table of one long column)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> PAGE).astype(np.int32)), pa.array((at & ((1 << PAGE) - 1)).astype(np.int32))], names=["page", "bit"])

    def pack(rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << PAGE, np.uint8)
        own[rows.column("bit").to_numpy()] = 1
        return pa.table({"page": rows.column("page").slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    placed = hashes.na.drop().mapInArrow(place, "page int, bit int").distinct()
    pages = placed.groupBy("page").applyInArrow(pack, "page int, bits binary").toArrow()
    out = np.zeros((1 << (bits - PAGE), 1 << (PAGE - 3)), np.uint8)
    for page, own in zip(pages.column("page").to_pylist(), pages.column("bits").to_pylist(), strict=True):
        out[page] = np.frombuffer(own, np.uint8)
    return out.ravel()


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the table."""
    at = hashes >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
