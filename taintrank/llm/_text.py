"""Whole-text helpers that run inside Arrow tasks: one numpy pass over the UTF-8 bytes of many documents.

Words are maximal runs of bytes outside space and 0x09-0x0D (the same runs as
``[^\\x20\\x09-\\x0D]+`` on code points, because those bytes never occur inside
a multi-byte UTF-8 character). Word hashes are 64-bit: a sum of one random value per byte
value times a power of an odd multiplier, so equal words have equal hashes
wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_MUL = 0x9E3779B97F4A7C15
_MUL_INV = pow(_MUL, -1, 2**64)
_WINDOW = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, m, np.uint64))), dtype=np.uint64)
                      for m in (_MUL, _MUL_INV)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Documents ``lo..hi`` of an Arrow batch as one byte buffer."""

    lo: int
    hi: int
    data: np.ndarray      # uint8
    offsets: np.ndarray   # int64, hi - lo + 1 entries

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array, max_bytes: int = 1 << 19) -> Iterator[Block]:
    """Cut a string column into blocks of about ``max_bytes`` (at least one document each); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Block(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    starts: np.ndarray    # byte positions in the block
    ends: np.ndarray
    bounds: np.ndarray    # document i has words bounds[i]..bounds[i+1]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(block: Block) -> Words:
    data, offsets = block.data, block.offsets
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:n + 1] = ~_SPACE[data]
    first = np.zeros(n + 2, bool)
    first[offsets + 1] = True                      # a document boundary stands before this byte
    starts = np.flatnonzero(inside[1:n + 1] & (~inside[:n] | first[1:n + 1]))
    ends = np.flatnonzero(inside[1:n + 1] & (~inside[2:] | first[2:])) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def word_hashes(block: Block, w: Words, fold: bool = False) -> np.ndarray:
    """One 64-bit hash per word; ``fold`` lower-cases A-Z first."""
    n = len(block.data)
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_FOLDED if fold else _BYTE)[block.data] * power[:n], out=total[1:], dtype=np.uint64)
    return mix((total[w.ends] - total[w.starts]) * inverse[w.starts])


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes (callers drop windows that cross documents)."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, size, np.uint64)
    for j in range(size):
        out += h[j:j + m] * _WINDOW[j]
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole short word sequence (fewer words than one window)."""
    return mix((np.uint64(len(h)) + (h * _WINDOW[:len(h)]).sum(dtype=np.uint64)).reshape(1))[0]


def replace_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = keep + list(new)
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep]
                                      + list(new.values()), names=names)
