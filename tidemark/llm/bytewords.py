"""Words, lines and their hashes over the byte buffers of Arrow text columns.

All functions work on one flat byte array holding many texts one after another, with
`offsets` (one more than texts) marking where each begins. Nothing here makes a Python
object per word, and memory is a fixed multiple of the chunk's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 1 << 20  # work arrays take some fifty times as much


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd step modulo 2**64, and of its inverse."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows holding about `limit` bytes; a longer text is a run of its own.

    A null text is an empty one.
    """
    text = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if not len(text):
        return
    _, where, data = text.buffers()
    offsets = np.frombuffer(where, np.int64, len(text) + 1 + text.offset)[text.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(text))
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each pair of offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of `inside` that cross no text border: (starts, ends, offsets of the texts in runs)."""
    n = len(inside)
    border = offsets[1:-1]
    border = border[(border > 0) & (border < n)]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[border] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[border - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the range lies; `fold` takes A-Z as a-z."""
    up, down = _powers(max(CHUNK_BYTES, 1 << int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * up[: len(data)], out=total[1:])
    own = (total[ends] - total[starts]) * down[starts]
    return mix(own + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of `[^\\x20\\x09-\\x0D]`: (starts, ends, offsets of the texts in words)."""
    return spans(~SPACE[data], offsets)


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words, at its first word, and whether it lies within one text."""
    n = len(hashes)
    whole = np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    if n >= size:
        m = n - size + 1
        for k in range(size):
            out[:m] = out[:m] * np.uint64(_STEP) + hashes[k : m + k]
        out[:m] = mix(out[:m])
        counts = np.diff(offsets)
        left = np.repeat(offsets[1:], counts) - np.arange(n)
        whole = left >= size
    return out, whole
